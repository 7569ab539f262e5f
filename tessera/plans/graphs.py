"""Graph queries over the bound knowledge graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import graph
from tessera.plans.binding import view
from tessera.plans.registered import query, rounded

STEPS = "e AS (SELECT * FROM {kg_edges}), b AS (SELECT src AS a, dst AS z FROM e UNION SELECT dst, src FROM e)"
SEEDS = "VALUES ('n:3'), ('n:7')"


def seeds(spark):
    return spark.createDataFrame([("n:3",), ("n:7",)], "id string")


HOPS = f"""WITH RECURSIVE {STEPS}, h(id, hop) AS (SELECT col0, 0 FROM ({SEEDS}) AS s UNION SELECT z, hop + 1 FROM h JOIN b ON id = a WHERE hop < 3),
    f AS (SELECT id, min(hop) AS hop FROM h GROUP BY id)"""


@query(HOPS + "SELECT * FROM f")
def k_hop(spark, sf_dir):
    """Hops from two nations."""
    return graph.hops(view(spark, sf_dir, "kg_edges"), seeds(spark), 3)


@query(HOPS + ", r AS (SELECT *, row_number() OVER (ORDER BY id) AS n FROM f WHERE hop > 0 AND hop <= 2) SELECT id, hop FROM r WHERE n <= 50 UNION ALL SELECT id, hop FROM f WHERE hop = 0")
def neighbourhood(spark, sf_dir):
    """At most fifty neighbours by id, and the seeds."""
    return graph.neighbourhood(view(spark, sf_dir, "kg_edges"), seeds(spark), 2, 50)


@query(HOPS + "SELECT id, hop, round(pow(0.85, hop), 4) AS score FROM f ORDER BY hop, id LIMIT 20")
def ppr_decay(spark, sf_dir):
    """Damping by hop; the top twenty are the feature."""
    return graph.hop_decay(view(spark, sf_dir, "kg_edges"), seeds(spark)).select("id", "hop", rounded("score"))


LAYERS = f"WITH {STEPS}, s0 AS (SELECT 'n:3' AS id, 0 AS length, 'n:3' AS path)" + "".join(
    f", s{k} AS (SELECT z AS id, {k} AS length, min(concat(path, '>', z)) AS path FROM s{k - 1} JOIN b ON id = a WHERE z NOT IN ({' UNION ALL '.join(f'SELECT id FROM s{j}' for j in range(k))}) GROUP BY z)" for k in range(1, 5)
)


@query(LAYERS + " UNION ALL ".join(f" SELECT * FROM s{k}" for k in range(5)))
def shortest_path(spark, sf_dir):
    """Shortest paths from a nation."""
    return graph.shortest_paths(view(spark, sf_dir, "kg_edges"), "n:3", 4)


RANKS = f"WITH {STEPS}, st AS (SELECT a, z, 1.0e0 / count(*) OVER (PARTITION BY a) AS share FROM b WHERE a <> z), sd AS (SELECT col0 AS id, 0.5e0 AS base FROM ({SEEDS}) AS s), r0 AS (SELECT id, base AS rank FROM sd)" + "".join(
    f", r{k} AS MATERIALIZED (SELECT id, sum(v) AS rank FROM (SELECT z AS id, 0.85e0 * rank * share AS v FROM r{k - 1} JOIN st ON id = a UNION ALL SELECT id, 0.15e0 * base FROM sd) AS x GROUP BY id)" for k in range(1, 21)
)


@query(RANKS + " SELECT id, round(rank, 6) AS rank FROM r20")
def pagerank(spark, sf_dir):
    """Personalised PageRank; twenty rounds."""
    ranks = graph.pagerank(view(spark, sf_dir, "kg_edges"), seeds(spark))
    return ranks.select("id", rounded("rank", 6))


TREE = "WITH RECURSIVE t AS (SELECT * FROM {class_tree}), u(node, ancestor, depth) AS (SELECT child, parent, 1 FROM t UNION SELECT u.node, t.parent, depth + 1 FROM u JOIN t ON u.ancestor = t.child )"


@query(TREE + "SELECT node, ancestor, min(depth) AS depth FROM u GROUP BY node, ancestor")
def transitive_closure(spark, sf_dir):
    """Every class with all its ancestors."""
    return graph.closure(view(spark, sf_dir, "class_tree"))


@query("""WITH RECURSIVE t AS (SELECT * FROM {class_tree}), d(node, depth) AS (SELECT 'Thing', 0 UNION SELECT child, depth + 1 FROM d JOIN t ON parent = node WHERE depth < 50)
    SELECT node, min(depth) AS depth FROM d GROUP BY node""")
def descendants(spark, sf_dir):
    """What lies below a class, itself included."""
    return graph.descendants(view(spark, sf_dir, "class_tree"), "Thing")


LONGEST = """WITH RECURSIVE t AS (SELECT * FROM {class_tree}), u(node, ancestor, depth) AS (SELECT child, parent, 1 FROM t UNION SELECT u.node, t.parent, depth + 1 FROM u JOIN t ON u.ancestor = t.child) """


@query(LONGEST + "SELECT max(depth) + 1 AS max_depth FROM u")
def chain_depth(spark, sf_dir):
    """Nodes on the longest chain."""
    return graph.chain_depth(view(spark, sf_dir, "class_tree"))


@query("SELECT round(count(*) / count(DISTINCT parent), 4) AS branching FROM {class_tree}")
def mean_branching(spark, sf_dir):
    """I13."""
    return graph.branching(view(spark, sf_dir, "class_tree")).select(rounded("branching"))


@query(LONGEST + """, n AS (SELECT child AS node FROM t UNION SELECT parent FROM t), d AS (SELECT node, max(depth) AS depth FROM u GROUP BY node),
    r AS (SELECT n.node, coalesce(depth, 0) AS depth, n.node IN (SELECT parent FROM t) AS inner_node FROM n LEFT JOIN d USING (node))
    SELECT count(*) AS classes, count_if(depth = 0) AS roots, count_if(NOT inner_node) AS leaves, round(count_if(NOT inner_node) / count(*), 4) AS leaf_ratio,
           max(depth) AS max_depth, round(avg(depth), 4) AS mean_depth, median(depth) AS median_depth, round(stddev_samp(depth), 4) AS sd_depth FROM r""")
def hierarchy_structure(spark, sf_dir):
    """Depth and leaf statistics."""
    found = graph.structure(view(spark, sf_dir, "class_tree"))
    return found.select("classes", "roots", "leaves", rounded("leaf_ratio"), "max_depth", rounded("mean_depth"), "median_depth", rounded("sd_depth"))


PATHS = """, w(path, last, n) AS (SELECT ['s:1'], 's:1', 0 UNION ALL SELECT list_append(path, z), z, n + 1 FROM w JOIN b ON last = a WHERE n < %d AND NOT list_contains(path, z) AND last <> 's:2')
    SELECT array_to_string(path, '>') AS path FROM w WHERE last = 's:2'"""


@query(f"WITH RECURSIVE {STEPS}" + PATHS % 3)
def connecting_paths(spark, sf_dir):
    """All short paths between two suppliers."""
    return graph.simple_paths(view(spark, sf_dir, "kg_edges"), "s:1", "s:2", 3).select(F.array_join("path", ">").alias("path"))


ENTITIES = ["s:1", "s:2", "s:3", "n:1", "n:4", "r:0"]
PAIRED = f"""WITH {STEPS}, k AS (SELECT unnest({ENTITIES}) AS id), x AS (SELECT id AS s, a, z FROM b JOIN k ON a = id WHERE a <> z), y AS (SELECT id AS t, a, z FROM b JOIN k ON z = id WHERE a <> z),
    w AS (SELECT x.s AS source, y.t AS target, [s, t] AS path FROM x JOIN y ON x.a = y.a AND x.z = y.z WHERE s < t
    UNION ALL SELECT s, t, [s, x.z, t] FROM x JOIN y ON x.z = y.a WHERE s < t AND x.z NOT IN (s, t)
    UNION ALL SELECT s, t, [s, x.z, y.a, t] FROM x JOIN b ON x.z = b.a JOIN y ON b.z = y.a WHERE s < t AND b.a <> b.z AND x.z NOT IN (s, t) AND y.a NOT IN (s, t))"""


def entities(spark):
    return spark.createDataFrame([(x,) for x in ENTITIES], "id string")


@query(PAIRED + " SELECT source, target, array_to_string(path, '>') AS path FROM w")
def connecting_pairs(spark, sf_dir):
    """All short paths between all pairs of six entities."""
    return graph.connecting_paths(view(spark, sf_dir, "kg_edges"), entities(spark), 3).select("source", "target", F.array_join("path", ">").alias("path"))


@query(PAIRED + ", i AS (SELECT path, unnest(range(1, len(path))) AS i FROM w), d AS (SELECT DISTINCT path[i] AS a, path[i + 1] AS z FROM i) SELECT DISTINCT src, rel, dst FROM e JOIN d ON (src = a AND dst = z) OR (src = z AND dst = a)")
def connecting_relations(spark, sf_dir):
    """The relations of these paths."""
    edges = view(spark, sf_dir, "kg_edges")
    return graph.path_relations(graph.connecting_paths(edges, entities(spark), 3), edges)


@query("WITH RECURSIVE e AS (SELECT * FROM {kg_edges} WHERE rel IN ('IN_NATION', 'IN_REGION')), b AS (SELECT src AS a, dst AS z FROM e UNION SELECT dst, src FROM e)" + PATHS.replace("s:1", "n:1").replace("s:2", "n:6") % 4)
def typed_paths(spark, sf_dir):
    """Paths whose every edge is of a wanted kind."""
    return graph.simple_paths(view(spark, sf_dir, "kg_edges"), "n:1", "n:6", 4, ["IN_NATION", "IN_REGION"]).select(F.array_join("path", ">").alias("path"))


@query("""WITH e AS (SELECT * FROM {kg_edges}), b AS (SELECT src AS a, dst AS z FROM e UNION SELECT dst, src FROM e) SELECT a AS id, least(count(*), 20) AS degree FROM b GROUP BY a""")
def node_degrees(spark, sf_dir):
    """Neighbours, capped at twenty."""
    return graph.degrees(view(spark, sf_dir, "kg_edges"))


@query("""WITH n AS (SELECT * FROM {kg_nodes}) SELECT DISTINCT id, label, entity_type FROM n WHERE lower(id) IN ('n:5', 'an') OR contains(lower(label), 'an') OR contains(lower(label), 'n:5') OR contains(lower(entity_type), 'an') ORDER BY id LIMIT 20""")
def entity_search(spark, sf_dir):
    """By id, or part of the label or properties; the first twenty are the feature."""
    nodes = view(spark, sf_dir, "kg_nodes").withColumn("properties", F.col("entity_type"))
    return graph.entity_search(nodes, ["N:5", "an"], 20).select("id", "label", "entity_type")


@query("""WITH e AS (SELECT * FROM {kg_edges}), n AS (SELECT * FROM {kg_nodes}), k AS (SELECT concat('n:', n_nationkey) AS id FROM nation WHERE n_nationkey < 3), b AS (SELECT src AS id, dst AS other, rel, 'out' AS way FROM e UNION SELECT dst, src, rel, 'in' FROM e),
    r AS (SELECT b.*, row_number() OVER (PARTITION BY b.id ORDER BY other, rel) AS nth FROM b WHERE id IN (SELECT id FROM k)) SELECT r.id, other, rel, way, label FROM r LEFT JOIN n ON n.id = other WHERE nth <= 10""")
def neighbour_cards(spark, sf_dir):
    """Ten neighbours of each entity (the limit is the feature), with direction and label."""
    wanted = view(spark, sf_dir, "nation").where("n_nationkey < 3").select(F.concat(F.lit("n:"), F.col("n_nationkey").cast("string")).alias("id"))
    return graph.neighbours(view(spark, sf_dir, "kg_edges"), view(spark, sf_dir, "kg_nodes"), wanted, 10)


@query("SELECT id, label, entity_type FROM {kg_nodes} ORDER BY id LIMIT 5000")
def entity_page(spark, sf_dir):
    """The first five thousand by id (the limit is the feature)."""
    return view(spark, sf_dir, "kg_nodes").select("id", "label", "entity_type").orderBy("id").limit(5000)


@query("""WITH u AS (SELECT child AS uri, 0 AS k FROM {class_tree} UNION SELECT parent, 0 FROM {class_tree}), d AS (SELECT parent AS uri, count(*) AS n FROM {class_tree} GROUP BY 1), x AS (SELECT u.uri, coalesce(n, 0) AS dependents FROM u LEFT JOIN d USING (uri)),
    r AS (SELECT *, row_number() OVER (ORDER BY dependents, uri) AS nth, count(*) OVER () AS n FROM x), l AS (SELECT unnest([0.5e0, 0.75e0, 0.9e0, 0.95e0]) AS level)
    SELECT level, count(*) AS removed, CAST(sum(dependents) AS BIGINT) AS dependents FROM r, l WHERE nth <= greatest(1, floor(n * level)) GROUP BY level""")
def graded_cases(spark, sf_dir):
    """How much goes at each level of reduction."""
    from tessera.operators import layers

    tree = view(spark, sf_dir, "class_tree")
    classes = tree.select(F.col("child").alias("uri")).union(tree.select("parent")).distinct()
    return layers.graded(classes, tree.select(F.col("parent").alias("uri")), [0.5, 0.75, 0.9, 0.95])


@query("""WITH RECURSIVE t AS (SELECT child, min(parent) AS parent FROM {class_tree} GROUP BY child), d(node, depth) AS (SELECT child, 0 FROM t UNION ALL SELECT t.child, depth + 1 FROM d JOIN t ON t.parent = d.node),
    x AS (SELECT child AS node FROM {class_tree} UNION SELECT parent FROM {class_tree}), m AS (SELECT x.node, coalesce(max(depth), 0) + CASE WHEN x.node IN (SELECT child FROM t) THEN 1 ELSE 0 END AS depth FROM x LEFT JOIN d USING (node) GROUP BY x.node),
    c AS (SELECT node, count(*) AS n FROM (SELECT child AS node FROM {class_tree} UNION ALL SELECT parent FROM {class_tree}) AS y GROUP BY node)
    SELECT round(avg(depth), 4) AS mean_depth, round(avg(n), 4) AS connectivity, round(1 / (1 + abs(avg(depth) - avg(n))), 4) AS modularity FROM m JOIN c USING (node)""")
def modularity(spark, sf_dir):
    """I16: balance of depth and connectivity, by first parents."""
    return graph.modularity(view(spark, sf_dir, "class_tree")).select(rounded("mean_depth"), rounded("connectivity"), rounded("modularity"))
