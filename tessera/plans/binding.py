"""The domain's relations as views of the test tables.

Each view is SQL that Spark and the checking engine both read; names in braces are tables or other views.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

VIEWS = {
    "kg_nodes": """
        SELECT concat('r:', r_regionkey) AS id, r_name AS label, 'Region' AS entity_type, 1.0e0 AS confidence FROM {region}
        UNION ALL SELECT concat('n:', n_nationkey), n_name, 'Nation', 1.0e0 FROM {nation}
        UNION ALL SELECT concat('c:', c_custkey), c_name, c_mktsegment, 0.9e0 FROM {customer}
        UNION ALL SELECT concat('s:', s_suppkey), s_name, 'Supplier', 0.95e0 FROM {supplier}
        UNION ALL SELECT concat('p:', p_partkey), p_name, p_type, p_size / 50.0e0 FROM {part}""",
    "kg_edges": """
        SELECT concat('n:', n_nationkey) AS src, concat('r:', n_regionkey) AS dst, 'IN_REGION' AS rel, 1.0e0 AS confidence FROM {nation}
        UNION ALL SELECT concat('c:', c_custkey), concat('n:', c_nationkey), 'IN_NATION', 1.0e0 FROM {customer}
        UNION ALL SELECT concat('s:', s_suppkey), concat('n:', s_nationkey), 'IN_NATION', 1.0e0 FROM {supplier}
        UNION ALL SELECT concat('p:', l_partkey), concat('s:', l_suppkey), 'SUPPLIED_BY', 1 - avg(l_discount)
                  FROM {lineitem} GROUP BY l_partkey, l_suppkey""",
    "class_tree": """
        SELECT DISTINCT concat(p_brand, '/', p_type) AS child, p_type AS parent FROM {part}
        UNION SELECT DISTINCT p_type, 'Part' FROM {part}
        UNION SELECT n_name, r_name FROM {nation} JOIN {region} ON n_regionkey = r_regionkey
        UNION SELECT r_name, 'World' FROM {region}
        UNION SELECT 'Part', 'Thing' FROM {part}
        UNION SELECT 'World', 'Thing' FROM {region}""",
    "entities": """
        SELECT concat('p:', p_partkey) AS id, p_partkey AS seq, p_name AS label, p_type AS entity_type, p_size / 50.0e0 AS confidence,
               count(l_orderkey) AS frequency
        FROM {part} LEFT JOIN {lineitem} ON l_partkey = p_partkey GROUP BY p_partkey, p_name, p_type, p_size""",
    "ontology_classes": """
        SELECT DISTINCT concat('urn:class#', p_type) AS uri, p_type AS label, 'urn:class#Part' AS parent_uri FROM {part}
        WHERE p_type NOT IN ('PROMO', 'STANDARD')""",
    "vectors": "SELECT vec_id AS id, label, embedding FROM {embeddings}",
    "decisions": """
        SELECT o_custkey AS proposal, o_orderpriority AS reviewer, o_orderkey AS seq,
               CASE o_orderstatus WHEN 'F' THEN 'accept' WHEN 'O' THEN 'reject' ELSE 'revise' END AS decision,
               CAST(o_totalprice / 500000 AS DOUBLE) AS confidence FROM {orders}""",
    "proposals": """SELECT c_custkey AS id, c_name AS label, c_mktsegment AS parent, c_acctbal AS weight FROM {customer}
        UNION ALL SELECT -1 - s_suppkey, s_name, 'SUPPLIER', s_acctbal FROM {supplier}""",
    "signals": """
        SELECT event_id AS seq, ts, concat('u', user_id) AS element, CASE WHEN user_id % 3 = 0 THEN 'property' ELSE 'class' END AS element_type,
               CASE event_type WHEN 'purchase' THEN 'accepted' WHEN 'error' THEN 'rejected' ELSE 'revised' END AS decision,
               CASE WHEN event_id % 4 = 0 THEN NULL ELSE concat(event_type, ' ', props) END AS rationale,
               user_id % 7 + 1 AS phase, value FROM {events}""",
    "messages": """
        SELECT conv_id AS debate, turn AS seq, role, CASE role WHEN 'user' THEN 'proposal' ELSE 'review' END AS message_type,
               CASE WHEN role = 'user' OR length(text) % 5 = 0 THEN NULL ELSE length(text) % 2 = 0 END AS approves,
               CASE WHEN role = 'user' OR length(text) % 7 > 0 THEN 0 ELSE 1 END AS issues, text AS reasoning FROM {conversations}""",
    "results": """
        SELECT concat(l_returnflag, l_linestatus) AS system, l_orderkey % 500 AS test_case, concat('L', l_orderkey % 4) AS level,
               avg(l_quantity) / 50 AS semantic, avg(l_discount) * 10 AS hallucination, avg(l_tax) * 10 AS coverage
        FROM {lineitem} GROUP BY 1, 2, 3""",
    "triples": """
        SELECT CASE WHEN p_size % 2 = 0 THEN 'urn:graph:seed' ELSE concat('urn:graph:ext-v', p_size % 3 + 1) END AS graph,
               concat('urn:part#', p_partkey) AS s, 'rdf:type' AS p, concat('urn:class#', p_type) AS o FROM {part}
        UNION ALL SELECT CASE WHEN p_size % 2 = 0 THEN 'urn:graph:seed' ELSE concat('urn:graph:ext-v', p_size % 3 + 1) END,
               concat('urn:part#', p_partkey), 'rdfs:label', p_name FROM {part}
        UNION ALL SELECT 'urn:graph:seed', concat('urn:class#', child), 'rdfs:subClassOf', concat('urn:class#', parent) FROM {class_tree}
        UNION ALL SELECT DISTINCT 'urn:graph:seed', concat('urn:class#', child), 'rdf:type', 'owl:Class' FROM {class_tree}
        UNION ALL SELECT DISTINCT 'urn:graph:seed', concat('urn:class#', child), 'rdfs:label', child FROM {class_tree}""",
    "onto": """
        SELECT s, p, o FROM {triples} WHERE graph = 'urn:graph:seed' AND s LIKE 'urn:class#%'
        UNION SELECT concat('urn:class#', n_name), 'skos:altLabel', concat('Land of ', n_name) FROM {nation}
        UNION SELECT concat('urn:class#', n_name), 'rdfs:comment', concat('Nation ', n_nationkey, ' of region ', n_regionkey) FROM {nation}
        UNION SELECT concat('urn:class#', r_name), 'rdfs:subClassOf', concat('_:b', r_regionkey) FROM {region}
        UNION SELECT 'urn:class#LARGE', 'owl:disjointWith', 'urn:class#SMALL' FROM {part}
        UNION SELECT concat('urn:prop#', p_brand), 'rdf:type', 'owl:ObjectProperty' FROM {part}
        UNION SELECT concat('urn:prop#', p_brand), 'rdfs:label', lower(p_brand) FROM {part} WHERE p_brand <> 'Brand#7'
        UNION SELECT concat('urn:prop#', p_brand), 'rdfs:domain', concat('urn:class#', p_type) FROM {part} WHERE p_size > 35
        UNION SELECT concat('urn:prop#', p_brand), 'rdfs:range', concat('urn:class#', n_name) FROM {part} JOIN {nation} ON n_nationkey = p_partkey % 25 WHERE p_size > 40
        UNION SELECT concat('urn:prop#', p_brand), 'owl:inverseOf', concat('urn:prop#inverse', p_brand) FROM {part} WHERE p_brand LIKE 'Brand#1%'
        UNION SELECT concat('urn:attr#', split_part(p_name, ' ', 1)), 'rdf:type', 'owl:DatatypeProperty' FROM {part}
        UNION SELECT concat('urn:attr#', split_part(p_name, ' ', 1)), 'rdfs:label', split_part(p_name, ' ', 1) FROM {part}
        UNION SELECT concat('urn:attr#', split_part(p_name, ' ', 1)), 'rdfs:domain', concat('urn:class#', p_type) FROM {part} WHERE p_size > 30
        UNION SELECT concat('urn:attr#', split_part(p_name, ' ', 1)), 'rdfs:range',
              CASE length(split_part(p_name, ' ', 1)) WHEN 3 THEN 'xsd:date' WHEN 4 THEN 'xsd:float' WHEN 5 THEN 'xsd:integer' ELSE 'xsd:string' END FROM {part}
        UNION SELECT concat('urn:attr#', split_part(p_name, ' ', 1)), 'owl:cardinality', CASE WHEN length(p_name) % 2 = 0 THEN '1' ELSE '0' END FROM {part}
              WHERE p_name IN ('cold widget', 'large bolt', 'small widget', 'hot gear', 'red gear')""",
}


def spelled(text: str) -> str:
    """The text with views spelled out, for an engine that has the tables as views."""
    return re.sub(r"\{(\w+)\}", lambda m: f"({spelled(VIEWS[m[1]])}) AS v_{m[1]}" if m[1] in VIEWS else m[1], text)


PARTITION_BYTES, SPLIT_BYTES = 4 << 20, 32 << 20  # of a table's file: to a partition of a shuffle, and read by one task
JOINED_BYTES = 4 << 20  # of small shuffle partitions that go to one task together


def sized(spark: SparkSession, path: str) -> None:
    """Give shuffles a partition for every PARTITION_BYTES of a table, so that what a task aggregates doesn't grow with the table; a session
    that has more keeps them. Tasks read at most SPLIT_BYTES, and of a shuffle JOINED_BYTES where partitions are put together."""
    file = spark._jvm.org.apache.hadoop.fs.Path(path)
    size = file.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(file).getLength()
    if size // PARTITION_BYTES > int(spark.conf.get("spark.sql.shuffle.partitions")):
        spark.conf.set("spark.sql.shuffle.partitions", str(size // PARTITION_BYTES))
    if size > SPLIT_BYTES and spark.conf.get("spark.sql.files.maxPartitionBytes") in ("134217728", "134217728b", "128MB"):  # the default
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(SPLIT_BYTES))
    if spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes") in ("67108864", "67108864b", "64MB"):  # the default
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", str(JOINED_BYTES))


DEALT = {("kg_edges", "lineitem"): ["l_partkey", "l_suppkey"]}  # what a view groups a table by, into about as many groups as rows


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table or view of the tables in a folder. A table that a view groups into about as many groups as it has rows is dealt by them
    first: a task that reads a file would hold the groups of all rows that it reads, so of a whole row group."""
    if name in TABLES:
        path = f"{sf_dir}/{name}.parquet"
        sized(spark, path)
        return spark.read.parquet(path)
    text = VIEWS[name]
    needs = {n: view(spark, sf_dir, n) for n in set(re.findall(r"\{(\w+)\}", text))}
    dealt = {n: df.repartition(*DEALT[name, n]) if (name, n) in DEALT else df for n, df in needs.items()}
    return spark.sql(text, **dealt)
