"""Queries on graphs: customers, nations and regions as entities, and the fixtures of the planner."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.catalog import query
from palimpsest.operators import graph as G
from palimpsest.plans.common import FACTS_SQL, event_facts, values_sql
from palimpsest.session import table

EDGE_SQL = """
e AS (
  SELECT 'c' || c_custkey AS src, 'lives_in' AS predicate, 'n' || c_nationkey AS dst FROM customer
  UNION ALL SELECT 's' || s_suppkey, 'based_in', 'n' || s_nationkey FROM supplier
  UNION ALL SELECT 'n' || n_nationkey, 'located_in', 'r' || n_regionkey FROM nation),
w AS (SELECT src, dst FROM e UNION ALL SELECT dst, src FROM e)
"""


def _edges(spark, sf_dir):
    parts = [
        table(spark, sf_dir, t).select(F.concat(F.lit(a), F.col(k)).alias("src"), F.lit(p).alias("predicate"), F.concat(F.lit(b), F.col(j)).alias("dst"))
        for t, a, k, p, b, j in (
            ("customer", "c", "c_custkey", "lives_in", "n", "c_nationkey"),
            ("supplier", "s", "s_suppkey", "based_in", "n", "s_nationkey"),
            ("nation", "n", "n_nationkey", "located_in", "r", "n_regionkey"),
        )
    ]
    e = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return e.withColumns({"fact_id": F.concat_ws(":", "src", "dst"), "valid_at": F.lit(0.0), "invalid_at": F.lit(None).cast("double")})


@query("graph_edges", f"WITH {EDGE_SQL} SELECT src, predicate, dst FROM e")
def graph_edges(spark, sf_dir):
    return _edges(spark, sf_dir).select("src", "predicate", "dst")


@query("neighbours_out_in", f"WITH {EDGE_SQL} SELECT 'out' AS direction, src, dst FROM e WHERE src = 'n3' UNION ALL SELECT 'in', src, dst FROM e WHERE dst = 'n3'")
def neighbours_out_in(spark, sf_dir):
    e = _edges(spark, sf_dir)
    out = G.neighbours(e, "n3").select(F.lit("out").alias("direction"), "src", "dst")
    return out.unionByName(G.neighbours(e, "n3", "in").select(F.lit("in").alias("direction"), "src", "dst"))


@query(
    "proximity_2hop",
    f"""WITH {EDGE_SQL}, a AS (SELECT 'c1' AS node UNION ALL SELECT 'r2'), x AS (SELECT * FROM w WHERE dst NOT IN (SELECT node FROM a)),
h1 AS (SELECT dst AS node, sum(0.65::DOUBLE) AS s FROM x JOIN a ON src = node GROUP BY dst),
h2 AS (SELECT dst AS node, sum(least(1, s) * 0.65::DOUBLE) AS s FROM x JOIN h1 ON src = node GROUP BY dst),
u AS (SELECT node, 1.0::DOUBLE AS s FROM a UNION ALL FROM h1 UNION ALL FROM h2)
SELECT node, least(1.0::DOUBLE, round(sum(s), 12)) AS score FROM u GROUP BY node""",
)
def proximity_2hop(spark, sf_dir):
    anchors = spark.createDataFrame([("c1",), ("r2",)], "node string")
    return G.proximity(_edges(spark, sf_dir), anchors)


@query(
    "proximity_excluded",
    f"""WITH {EDGE_SQL}, a AS (SELECT 'r2' AS node), z AS (SELECT 'n8' AS node UNION ALL SELECT 'n9'),
x AS (SELECT * FROM w WHERE dst NOT IN (SELECT node FROM a) AND dst NOT IN (SELECT node FROM z) AND src NOT IN (SELECT node FROM z)),
h1 AS (SELECT dst AS node, max(0.65::DOUBLE) AS s FROM x JOIN a ON src = node GROUP BY dst),
h2 AS (SELECT dst AS node, max(least(1, s) * 0.65::DOUBLE) AS s FROM x JOIN h1 ON src = node GROUP BY dst),
u AS (SELECT node, 1.0::DOUBLE AS s FROM a UNION ALL FROM h1 UNION ALL FROM h2)
SELECT node, least(1.0::DOUBLE, round(max(s), 12)) AS score FROM u GROUP BY node""",
)
def proximity_excluded(spark, sf_dir):
    anchors = spark.createDataFrame([("r2",)], "node string")
    zone = spark.createDataFrame([("n8",), ("n9",)], "node string")
    return G.proximity(_edges(spark, sf_dir), anchors, reinforce=False, excluded=zone)


@query("planner_chain", f"WITH {EDGE_SQL} SELECT a.src AS customer, b.dst AS node FROM e a JOIN e b ON b.src = a.dst AND b.predicate = 'located_in' WHERE a.src = 'c7' AND a.predicate = 'lives_in'")
def planner_chain(spark, sf_dir):
    got = G.walk_chain(_edges(spark, sf_dir), "c7", ["lives_in", "based_in"])
    return got.select(F.lit("c7").alias("customer"), "node")


@query("exclusion_zone", f"WITH {EDGE_SQL} SELECT 'n4' AS node UNION SELECT src FROM e WHERE dst = 'n4' AND predicate IN ('based_in', 'located_in', 'lives_in')")
def exclusion_zone(spark, sf_dir):
    return G.exclusion_zone(_edges(spark, sf_dir), spark.createDataFrame([("n4",)], "node string"))


@query("bounded_paths", f"WITH {EDGE_SQL} SELECT src || ':' || dst AS fact_id, 0 AS depth FROM e WHERE src = 'r1' OR dst = 'r1' ORDER BY depth, fact_id LIMIT 5")
def bounded_paths(spark, sf_dir):
    return G.bounded_paths(_edges(spark, sf_dir), spark.createDataFrame([("r1",)], "node string"), 2, 5)


@query("entity_upsert", f"WITH {FACTS_SQL}, n AS (SELECT CAST(user_id AS VARCHAR) AS user_id, CAST(user_id AS VARCHAR) AS name FROM facts UNION SELECT CAST(user_id AS VARCHAR), event_type FROM facts) SELECT user_id, lower(name) AS key, min(name) AS name FROM n GROUP BY ALL")
def entity_upsert(spark, sf_dir):
    f = event_facts(spark, sf_dir)
    return G.entities(f.withColumns({"object": F.col("predicate"), "predicate": F.lit("did")}))


@query("orphan_entities", f"WITH {EDGE_SQL} SELECT 'c' || c_custkey AS key FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def orphan_entities(spark, sf_dir):
    """Customers that no order names."""
    from palimpsest.operators.health import orphans

    ents = table(spark, sf_dir, "customer").select(F.lit("u").alias("user_id"), F.concat(F.lit("c"), "c_custkey").alias("key"))
    e = table(spark, sf_dir, "orders").select(F.lit("u").alias("user_id"), F.concat(F.lit("c"), "o_custkey").alias("src"), F.concat(F.lit("o"), "o_orderkey").alias("dst"))
    return orphans(ents, e).select("key")


@query(
    "identity_components",
    "SELECT 'u' || user_id AS handle, min('u' || user_id) OVER (PARTITION BY user_id % 7) AS canonical FROM (SELECT DISTINCT user_id FROM events) QUALIFY count(*) OVER (PARTITION BY user_id % 7) > 1",
)
def identity_components(spark, sf_dir):
    """Handles linked in chains: each user with the next one of the same remainder by seven."""
    from pyspark.sql import Window as W

    u = table(spark, sf_dir, "events").select("user_id").distinct()
    nxt = F.lead("user_id").over(W.partitionBy(F.col("user_id") % 7).orderBy("user_id"))
    links = u.select(F.concat(F.lit("u"), "user_id").alias("a"), F.concat(F.lit("u"), nxt).alias("b")).where("b IS NOT NULL")
    return G.identity_roots(links)


PEOPLE = [
    ("u", "Wei", "works_at", "Moonshot AI"), ("u", "Wei", "colleague", "Lin"), ("u", "Lin", "works_at", "Zephyr Labs"), ("u", "Zephyr Labs", "based_in", "Lisbon"),
    ("u", "user", "sister", "Maya"), ("u", "Maya", "occupation", "pediatrician"), ("u", "Maya", "lives_in", "Seattle"), ("u", "Moonshot AI", "based_in", "Beijing"),
]


def _people(spark):
    rows = [(*p, i, f"f{i}", float(i), None) for i, p in enumerate(PEOPLE)]
    return spark.createDataFrame(rows, "user_id string, subject string, predicate string, object string, seq int, fact_id string, valid_at double, invalid_at double")


@query("multi_hop_walk", values_sql(["question", "answer"], [("Where does Wei's colleague work?", "zephyr labs"), ("What is my sister's profession?", "pediatrician")]))
def multi_hop_walk(spark, sf_dir):
    e = G.edges(_people(spark))
    out = None
    for q, anchor in (("Where does Wei's colleague work?", "wei"), ("What is my sister's profession?", "user")):
        got = G.walk_chain(e, anchor, G.planned_predicates(q)).select(F.lit(q).alias("question"), F.col("node").alias("answer"))
        out = got if out is None else out.unionByName(got)
    return out


@query("entity_mentions", values_sql(["node"], [("lin",), ("lisbon",), ("zephyr labs",)]))
def entity_mentions(spark, sf_dir):
    return G.mentioned_entities(G.entities(_people(spark)), "does Lin of Zephyr ever travel to Lisbon?", "u")


@query("excluded_entities", values_sql(["node"], [("lisbon",), ("zephyr labs",)]))
def excluded_entities(spark, sf_dir):
    f = _people(spark)
    return G.exclusion_zone(G.edges(f), G.excluded_mentions(G.entities(f), "which company is not based in Lisbon?", "u"))


@query("relation_relevance", values_sql(["fact_id", "relevance"], [("f0", 1.0), ("f1", 0.0), ("f2", 1.0), ("f3", 0.75), ("f4", 0.0), ("f5", 0.0), ("f6", 0.0), ("f7", 0.0)]))
def relation_relevance(spark, sf_dir):
    f = _people(spark).withColumn("text", F.concat_ws(" ", "subject", "object"))
    return f.select("fact_id", G.relation_relevance("which company, Zephyr?", *[F.col(c) for c in ("predicate", "subject", "object", "text")]).alias("relevance"))
