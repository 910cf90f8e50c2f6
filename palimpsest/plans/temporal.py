"""Queries on the bi-temporal facts that events fold into."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.catalog import query
from palimpsest.functions import text as T
from palimpsest.operators import chains as Chains
from palimpsest.operators import lifecycle as Life
from palimpsest.operators import temporal as Time
from palimpsest.plans.common import AS_OF, FACTS_SQL, event_facts
from palimpsest.session import table

LIVE = f"ts_s <= {AS_OF} AND (invalid_at IS NULL OR invalid_at > {AS_OF})"


@query("bitemporal_as_of", f"WITH {FACTS_SQL} SELECT user_id, event_type, value, ts_s AS valid_at, invalid_at, supersedes FROM facts WHERE {LIVE}")
def bitemporal_as_of(spark, sf_dir):
    facts = Time.facts_from_events(table(spark, sf_dir, "events"))
    return Time.as_of(facts, AS_OF).select("user_id", "event_type", "value", "valid_at", "invalid_at", "supersedes")


@query("slot_history", f"WITH {FACTS_SQL} SELECT user_id, event_type, event_id, value, ts_s AS valid_at, invalid_at, previous_value, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts_s, event_id) AS version FROM facts")
def slot_history(spark, sf_dir):
    from pyspark.sql import Window as W

    f = Time.facts_from_events(table(spark, sf_dir, "events"))
    version = F.row_number().over(W.partitionBy("user_id", "event_type").orderBy("valid_at", "event_id")).cast("long")
    return f.select("user_id", "event_type", "event_id", "value", "valid_at", "invalid_at", "previous_value", version.alias("version"))


@query("slot_head", "SELECT CAST(user_id AS VARCHAR) AS user_id, event_type AS predicate, max_by(event_id, (ts, event_id)) AS fact_id FROM (SELECT *, lag(value) OVER w AS pv, row_number() OVER w AS rn FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id)) WHERE rn = 1 OR value IS DISTINCT FROM pv GROUP BY ALL")
def slot_head(spark, sf_dir):
    return Time.slot_heads(event_facts(spark, sf_dir)).select("user_id", "predicate", "fact_id")


@query(
    "current_state",
    f"WITH {FACTS_SQL} SELECT CAST(user_id AS VARCHAR) AS subject, event_type AS predicate, event_id AS fact_id FROM facts WHERE invalid_at IS NULL ORDER BY 1, 2 LIMIT 18",
)
def current_state(spark, sf_dir):
    return Time.current_state(event_facts(spark, sf_dir)).select("subject", "predicate", "fact_id")


@query("previous_value", f"WITH {FACTS_SQL} SELECT event_id, value, previous_value, value - previous_value AS change FROM facts WHERE previous_value IS NOT NULL")
def previous_value(spark, sf_dir):
    f = Time.facts_from_events(table(spark, sf_dir, "events")).where("previous_value IS NOT NULL")
    return f.select("event_id", "value", "previous_value", (F.col("value") - F.col("previous_value")).alias("change"))


@query(
    "supersession_pairs",
    f"WITH {FACTS_SQL} SELECT o.event_id AS older, n.event_id AS newer, n.ts_s - o.ts_s AS held_s FROM facts n JOIN facts o ON n.supersedes = o.event_id",
)
def supersession_pairs(spark, sf_dir):
    r = Time.replacements(event_facts(spark, sf_dir))
    return r.select(F.col("older.fact_id").alias("older"), F.col("newer.fact_id").alias("newer"), (F.col("newer.valid_at") - F.col("older.valid_at")).alias("held_s"))


@query(
    "supersession_chain",
    f"""WITH RECURSIVE {FACTS_SQL}, chain AS (
  SELECT event_id AS root, event_id AS fact_id, 0 AS depth FROM facts WHERE supersedes IS NULL
  UNION ALL SELECT c.root, f.event_id, c.depth + 1 FROM chain c JOIN facts f ON f.supersedes = c.fact_id)
SELECT root, fact_id, CAST(depth AS INTEGER) AS depth FROM chain""",
)
def supersession_chain(spark, sf_dir):
    return Time.slot_chains(event_facts(spark, sf_dir), ["user_id", "predicate"])


@query(
    "chain_roles",
    f"WITH {FACTS_SQL} SELECT event_id AS fact_id, CASE WHEN {LIVE} AND supersedes IS NOT NULL THEN 'replacement' WHEN {LIVE} THEN 'current' "
    "WHEN invalid_at IS NOT NULL THEN 'superseded' ELSE 'past' END AS role FROM facts",
)
def chain_roles(spark, sf_dir):
    return Time.chain_roles(event_facts(spark, sf_dir), AS_OF).select("fact_id", "role")


@query("timeline_gaps", "SELECT event_id, epoch_us(ts) / 1000000.0 - lag(epoch_us(ts) / 1000000.0) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap_s FROM events")
def timeline_gaps(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("at", T.seconds_of("ts"))
    return Time.gaps(e, ["user_id"], "at", "event_id").select("event_id", "gap_s")


@query(
    "session_gap",
    """WITH g AS (SELECT *, epoch_us(ts) / 1000000.0 AS t, CASE WHEN epoch_us(ts) / 1000000.0 - lag(epoch_us(ts) / 1000000.0) OVER (PARTITION BY user_id ORDER BY ts, event_id) >= 900 THEN 1 ELSE 0 END AS n FROM events),
s AS (SELECT user_id, t, sum(n) OVER (PARTITION BY user_id ORDER BY t, event_id) AS k FROM g)
SELECT user_id, CAST(k AS BIGINT) AS session_no, min(t) AS first_at, max(t) AS last_at, count(*) AS n FROM s GROUP BY user_id, k""",
)
def session_gap(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("at", T.seconds_of("ts"))
    s = Time.quiet_sessions(e, ["user_id"], "at", "event_id")
    return s.groupBy("user_id", "session_no").agg(F.min("at").alias("first_at"), F.max("at").alias("last_at"), F.count(F.lit(1)).alias("n"))


@query(
    "as_of_join",
    f"""WITH {FACTS_SQL}, p AS (SELECT o_orderkey, o_custkey AS user_id, epoch(o_orderdate)::DOUBLE + 883612800 AS at FROM orders)
SELECT o_orderkey, event_type, value FROM p JOIN facts f ON f.user_id = p.user_id AND f.ts_s <= p.at AND (f.invalid_at IS NULL OR p.at < f.invalid_at)""",
)
def as_of_join(spark, sf_dir):
    """What each slot of a customer held when they ordered (order dates moved into the events' years)."""
    at = (F.datediff("o_orderdate", F.lit("1970-01-01")) * 86400 + 883612800).cast("double")
    p = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("user_id"), at.alias("at"))
    got = Time.as_of_join(p, Time.facts_from_events(table(spark, sf_dir, "events")), ["user_id"], "at")
    return got.where("event_type IS NOT NULL").select("o_orderkey", "event_type", "value")


@query("recency_score", f"SELECT event_id, round(exp(-greatest({AS_OF} - epoch_us(ts) / 1000000.0, 0) / (45 * 86400)), 9) AS recency FROM events")
def recency_score(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.round(T.recency(F.lit(AS_OF) - T.seconds_of("ts"), 45.0), 9).alias("recency"))


@query(
    "decay_sweep",
    f"""WITH {FACTS_SQL}, m AS (SELECT max(ts_s) AS last FROM facts)
SELECT event_id AS fact_id, CASE WHEN {LIVE} THEN round(greatest(0.3, exp(-0.02 * greatest(0, last - ts_s) / 86400)), 9) ELSE 1 END AS salience FROM facts, m""",
)
def decay_sweep(spark, sf_dir):
    return Life.decay_sweep(event_facts(spark, sf_dir), AS_OF).select("fact_id", F.round("salience", 9).alias("salience"))


@query(
    "eviction_rank",
    f"WITH {FACTS_SQL}, n AS (SELECT greatest(0, count(*) - 500) AS k FROM facts), r AS (SELECT event_id, row_number() OVER (ORDER BY value, ts_s, event_id) AS rn FROM facts) "
    "SELECT event_id AS fact_id, CASE WHEN rn <= k THEN 'cold' ELSE 'hot' END AS tier FROM r, n",
)
def eviction_rank(spark, sf_dir):
    f = event_facts(spark, sf_dir).withColumns({"salience": F.col("value"), "last_access": F.col("valid_at")})
    return Life.evict_cold(f, 500).select("fact_id", "tier")


@query(
    "focus_boost",
    "SELECT event_id AS fact_id, CASE WHEN contains(event_type, 'purch') THEN least(5.0, value + 0.5) ELSE value END AS salience FROM events WHERE NOT contains(event_type, 'error')",
)
def focus_boost(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("fact_id"), F.col("event_type").alias("text"), F.col("value").alias("salience"))
    return Life.apply_focus(e, ["Purch"], ["ERROR"]).select("fact_id", "salience")


@query(
    "working_live",
    f"SELECT event_id FROM events WHERE NOT (event_type = 'error') AND (event_type = 'view' OR epoch_us(ts) / 1000000.0 + 86400 > {AS_OF})",
)
def working_live(spark, sf_dir):
    """Events as working memory: errors are used up, views never expire, others live a day."""
    at = T.seconds_of("ts")
    w = table(spark, sf_dir, "events").withColumns({"consumed": F.col("event_type") == "error", "expires_at": F.when(F.col("event_type") != "view", at + 86400)})
    return Life.sweep_working(w, AS_OF).select("event_id")


@query(
    "access_reinforcement",
    "SELECT e.user_id AS fact_id, round(1.0::DOUBLE + 0.5::DOUBLE * count(*), 9) AS salience, count(*) AS access_count FROM events e WHERE event_type = 'view' GROUP BY 1",
)
def access_reinforcement(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("event_type = 'view'")
    facts = e.select(F.col("user_id").alias("fact_id")).distinct().withColumns({"salience": F.lit(1.0), "access_count": F.lit(0).cast("long"), "last_access": F.lit(0.0)})
    log = e.select(F.col("user_id").alias("fact_id"), T.seconds_of("ts").alias("at"))
    return Life.reinforce(facts, log).select("fact_id", F.round("salience", 9).alias("salience"), "access_count")


@query(
    "latest_log_window",
    "SELECT event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY (ts, event_id) DESC) <= 512",
)
def latest_log_window(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("at", F.struct("ts", "event_id"))
    return Life.latest_log(e, "event_type", "at").select("event_type", "event_id")


@query(
    "chain_walk",
    f"""WITH RECURSIVE e AS (SELECT event_id, user_id, event_type, epoch_us(ts) / 1000000.0 AS t, CAST(floor(value) AS BIGINT) % 3 AS kind FROM events),
links AS (
  SELECT *, CASE WHEN kind = 0 THEN lag(event_id) OVER (PARTITION BY user_id ORDER BY t, event_id) ELSE lag(event_id) OVER (PARTITION BY user_id, event_type ORDER BY t, event_id) END AS supersedes
  FROM e),
seeds AS (SELECT user_id AS qid, max_by(event_id, (t, event_id)) AS event_id FROM e GROUP BY user_id, event_type),
up AS (SELECT * FROM seeds UNION SELECT u.qid, l.supersedes FROM up u JOIN links l ON l.event_id = u.event_id WHERE l.supersedes IS NOT NULL),
down AS (SELECT * FROM seeds UNION SELECT d.qid, l.event_id FROM down d JOIN links l ON l.supersedes = d.event_id),
m AS (SELECT * FROM up UNION SELECT * FROM down),
r AS (
  SELECT qid, m.event_id AS fact_id, row_number() OVER (PARTITION BY qid ORDER BY event_type, t, m.event_id) AS place, count(*) OVER (PARTITION BY qid) AS n
  FROM m JOIN e ON e.event_id = m.event_id WHERE t <= {AS_OF})
SELECT qid, fact_id, CAST(place AS INTEGER) AS place FROM r WHERE n > 1 AND place <= 12""",
)
def chain_walk(spark, sf_dir):
    """Each user's newest facts and their chains. A third of the facts replace what came before them in any slot of the user, so that chains fork and merge slots."""
    from pyspark.sql import Window as W

    e = table(spark, sf_dir, "events").withColumn("valid_at", T.seconds_of("ts"))
    before = lambda *by: F.lag("event_id").over(W.partitionBy(*by).orderBy("valid_at", "event_id"))
    link = F.when(F.floor("value") % 3 == 0, before("user_id")).otherwise(before("user_id", "event_type"))
    facts = e.select(F.col("event_id").alias("fact_id"), "user_id", F.col("user_id").cast("string").alias("subject"), F.col("event_type").alias("predicate"), "valid_at", link.alias("supersedes"))
    seeds = e.groupBy(F.col("user_id").alias("qid"), "event_type").agg(F.max_by("event_id", F.struct("valid_at", "event_id")).alias("fact_id")).select("qid", "fact_id")
    return Chains.chain_walk(facts, seeds, AS_OF).select("qid", "fact_id", "place")
