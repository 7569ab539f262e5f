"""An agent's graph tools over the bound knowledge graph, for all suppliers and nations at once."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import tools
from tessera.plans.binding import view
from tessera.plans.registered import query

BOTH = "n AS (SELECT * FROM {kg_nodes}), e AS (SELECT * FROM {kg_edges}), b AS (SELECT src AS a, dst AS z FROM e UNION SELECT dst, src FROM e)"
AROUND = f"""WITH RECURSIVE {BOTH}, q AS (SELECT n_nationkey AS query, CASE n_nationkey % 4 WHEN 0 THEN lower(n_name) WHEN 1 THEN concat('zz', n_name) ELSE concat('n:', n_nationkey) END AS entity, n_nationkey % 6 AS hops FROM nation),
    l AS (SELECT query, id, row_number() OVER (PARTITION BY query ORDER BY id) AS nth FROM q JOIN n ON contains(lower(label), lower(entity)) WHERE entity NOT IN (SELECT id FROM n)), s AS (SELECT query, id FROM l WHERE nth <= 3 UNION SELECT query, entity FROM q WHERE entity IN (SELECT id FROM n)),
    h(query, id, hop) AS (SELECT query, id, 0 FROM s UNION SELECT h.query, z, hop + 1 FROM h JOIN b ON id = a JOIN q ON q.query = h.query WHERE hop < least(greatest(hops, 1), 3)),
    f AS (SELECT query, id, min(hop) AS hop FROM h GROUP BY query, id), k AS (SELECT query, id, hop FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY hop, id) AS nth FROM f WHERE hop > 0) AS x WHERE nth <= 30 UNION ALL SELECT query, id, hop FROM f WHERE hop = 0),
    x AS (SELECT query, nth, k2.id, n.label, n.entity_type, hop FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY hop, id) AS nth FROM k) AS k2 LEFT JOIN n ON n.id = k2.id WHERE nth <= 20),
    y AS (SELECT query, nth, src, rel, dst FROM (SELECT k1.query, src, rel, dst, row_number() OVER (PARTITION BY k1.query ORDER BY src, rel, dst) AS nth FROM (SELECT DISTINCT src, rel, dst FROM e) AS d JOIN k AS k1 ON k1.id = src JOIN k AS k2 ON k2.id = dst AND k2.query = k1.query) AS r WHERE nth <= 30)"""


def asked(spark, sf_dir):
    key, name = F.col("n_nationkey"), F.col("n_name")
    entity = F.when(key % 4 == 0, F.lower(name)).when(key % 4 == 1, F.concat(F.lit("zz"), name)).otherwise(F.concat(F.lit("n:"), key.cast("string")))
    return view(spark, sf_dir, "nation").select(key.alias("query"), entity.alias("entity"), (key % 6).alias("hops"))


def explored(spark, sf_dir):
    return tools.explored(asked(spark, sf_dir), view(spark, sf_dir, "kg_nodes"), view(spark, sf_dir, "kg_edges"))


@query(AROUND + " SELECT query, nth, id, label, entity_type, hop FROM x")
def explored_entities(spark, sf_dir):
    """Entities around those asked for by id or label; the limits are the tool's."""
    return explored(spark, sf_dir)[0]


@query(AROUND + " SELECT query, nth, src, rel, dst FROM y")
def explored_relations(spark, sf_dir):
    """Relations among them."""
    return explored(spark, sf_dir)[1]


@query(AROUND + " SELECT query, count(x.id) = 0 AS failed, count(x.id) AS entities, (SELECT count(*) FROM y WHERE y.query = q.query) AS relations FROM q LEFT JOIN x USING (query) GROUP BY query")
def explored_replies(spark, sf_dir):
    """The tool's replies, read back as VARIANT."""
    reply = F.parse_json("reply")
    size = lambda name: F.size(F.try_variant_get(reply, f"$.{name}", "array<variant>"))
    rows = tools.replies(asked(spark, sf_dir), *explored(spark, sf_dir))
    return rows.select("query", F.try_variant_get(reply, "$.error", "string").isNotNull().alias("failed"), F.greatest(size("entities"), F.lit(0)).cast("long").alias("entities"), F.greatest(size("relations"), F.lit(0)).cast("long").alias("relations"))


JOINED = f"WITH {BOTH}, q AS (SELECT s_suppkey AS query, CASE WHEN s_suppkey % 3 = 0 THEN s_name ELSE concat('s:', s_suppkey) END AS source, CASE s_suppkey % 4 WHEN 0 THEN concat('s:', s_suppkey) WHEN 1 THEN 'nowhere' ELSE concat('n:', (s_nationkey + 1) % 25) END AS target, s_suppkey % 8 AS hops FROM supplier)" + """,
    u AS (SELECT query, coalesce((SELECT id FROM n WHERE id = source), (SELECT min(id) FROM n WHERE contains(lower(label), lower(source)))) AS a0, coalesce((SELECT id FROM n WHERE id = target), (SELECT min(id) FROM n WHERE contains(lower(label), lower(target)))) AS t, least(greatest(hops, 1), 6) AS most FROM q),
    s0 AS (SELECT query, a0 AS id, [a0] AS path FROM u WHERE a0 IS NOT NULL)""" + "".join(
    f", s{k} AS (SELECT r.query, z AS id, min(list_append(r.path, z)) AS path FROM s{k - 1} AS r JOIN b ON r.id = a " + " ".join(f"LEFT JOIN s{j} AS o{j} ON o{j}.query = r.query AND o{j}.id = z" for j in range(k)) + " WHERE " + " AND ".join(f"o{j}.id IS NULL" for j in range(k)) + " GROUP BY r.query, z)"
    for k in range(1, 7)
) + ", p AS (SELECT query, len(path) - 1 AS length, path FROM (" + " UNION ALL ".join(f"SELECT * FROM s{k}" for k in range(7)) + ") AS w JOIN u USING (query) WHERE w.id = t AND len(path) - 1 <= most)" + """,
    i AS (SELECT query, path, unnest(range(1, len(path))) AS i FROM p), d AS (SELECT query, i, path[i] AS a, path[i + 1] AS z FROM i), t AS (SELECT query, i, min(concat(src, ' -[', rel, ']-> ', dst)) AS line FROM d JOIN e ON (src = a AND dst = z) OR (src = z AND dst = a) GROUP BY query, i),
    c AS (SELECT query, string_agg(line, ' → ' ORDER BY i) AS chain FROM t GROUP BY query)"""


@query(JOINED + " SELECT q.query, source, target, length, array_to_string(path, '>') AS path, coalesce(chain, CASE WHEN length = 0 THEN 'direct' END) AS chain FROM q LEFT JOIN p USING (query) LEFT JOIN c USING (query)")
def found_connections(spark, sf_dir):
    """A shortest path for each of many pairs, by id or label, as a chain of facts."""
    name = F.concat(F.lit("s:"), F.col("s_suppkey").cast("string"))
    key, other = F.col("s_suppkey"), F.concat(F.lit("n:"), ((F.col("s_nationkey") + 1) % 25).cast("string"))
    rows = view(spark, sf_dir, "supplier").select(key.alias("query"), F.when(key % 3 == 0, F.col("s_name")).otherwise(name).alias("source"), F.when(key % 4 == 0, name).when(key % 4 == 1, "nowhere").otherwise(other).alias("target"), (key % 8).alias("hops"))
    found = tools.connections(rows, view(spark, sf_dir, "kg_nodes"), view(spark, sf_dir, "kg_edges"))
    return found.select("query", "source", "target", "length", F.array_join("path", ">").alias("path"), "chain")
