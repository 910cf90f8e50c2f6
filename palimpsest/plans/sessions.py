"""Queries on sessions, working memory, conflicts and namespaces; events are episodes, a user's day is a session."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest import vocabulary as V
from palimpsest.catalog import query
from palimpsest.functions import text as T
from palimpsest.operators import sessions as S
from palimpsest.plans.common import AS_OF, FACTS_SQL, event_facts, stems_sql
from palimpsest.session import table

LIVE = f"ts_s <= {AS_OF} AND (invalid_at IS NULL OR invalid_at > {AS_OF})"
EPISODES_SQL = """
ep AS (
  SELECT event_id AS episode_id, CAST(user_id AS VARCHAR) AS user_id, user_id || ':' || CAST(floor(epoch_us(ts) / 86400000000) AS BIGINT) AS session_id,
         event_type || ' ' || event_id AS content, epoch_us(ts) / 1000000.0 AS event_time, event_id % 7 <> 0 AS consolidated, event_id % 11 = 0 AS ephemeral,
         CASE WHEN event_id % 5 = 0 THEN event_type END AS summary, CASE WHEN event_id % 2 = 0 THEN 'agent_session' ELSE 'chat' END AS source
  FROM events)
"""
TOKENS_SQL = "len(regexp_extract_all({0}, '[A-Za-z0-9]+'))"  # of text without CJK letters


def _episodes(spark, sf_dir):
    no, at = F.col("event_id"), T.seconds_of("ts")
    return table(spark, sf_dir, "events").select(
        no.alias("episode_id"), F.col("user_id").cast("string").alias("user_id"), F.concat("user_id", F.lit(":"), F.floor(at / 86400)).alias("session_id"),
        F.concat_ws(" ", "event_type", "event_id").alias("content"), at.alias("event_time"), (at + 60).alias("ingested_at"), (no % 7 != 0).alias("consolidated"),
        (no % 11 == 0).alias("ephemeral"), F.when(no % 5 == 0, F.col("event_type")).alias("summary"), F.when(no % 2 == 0, "agent_session").otherwise("chat").alias("source"),
    )


def _facts(spark, sf_dir):
    f = event_facts(spark, sf_dir)
    return f.withColumns(
        {
            "text": F.concat_ws(" ", "predicate", "fact_id"), "sensitive": F.col("predicate") == "purchase", "object": F.col("fact_id").cast("string"),
            "provenance": F.array_compact(F.array("fact_id", "supersedes")), "tier": F.when(F.col("fact_id") % 4 == 0, "cold").otherwise("hot"),
        }
    )


@query(
    "session_report",
    f"""WITH {FACTS_SQL}, {EPISODES_SQL}, p AS (SELECT event_id AS fact_id, unnest(list_filter([event_id, supersedes], lambda x: x IS NOT NULL)) AS episode_id FROM facts),
s AS (SELECT session_id, fact_id, count(DISTINCT episode_id) AS n_own FROM p JOIN ep USING (episode_id) GROUP BY ALL)
SELECT session_id, fact_id, CAST(n_own AS INTEGER) AS n_own, CASE WHEN {LIVE} THEN 'live' ELSE 'superseded' END AS status, event_type = 'purchase' AS redacted,
CASE WHEN event_type = 'purchase' THEN '{S.HIDDEN}' ELSE event_type || ' ' || event_id END AS text FROM s JOIN facts ON event_id = fact_id""",
)
def session_report(spark, sf_dir):
    return S.session_report(_facts(spark, sf_dir), _episodes(spark, sf_dir), AS_OF).select("session_id", "fact_id", "n_own", "status", "redacted", "text")


WORKING_SQL = f"""
wm AS (SELECT event_id AS item_id, CAST(user_id AS VARCHAR) AS user_id, user_id || ':' || CAST(floor(epoch_us(ts) / 86400000000) AS BIGINT) AS session_id,
  event_type AS kind, event_type = 'error' AS consumed, CASE WHEN event_type <> 'view' THEN epoch_us(ts) / 1000000.0 + 86400 END AS expires_at FROM events WHERE event_id % 3 = 0),
wl AS (SELECT * FROM wm WHERE NOT consumed AND (expires_at IS NULL OR expires_at > {AS_OF}))
"""


def _working(spark, sf_dir):
    e = _episodes(spark, sf_dir).where("episode_id % 3 = 0").withColumn("kind", F.split("content", " ")[0])
    until = F.when(F.col("kind") != "view", F.col("event_time") + 86400)
    return e.select(F.col("episode_id").alias("item_id"), "user_id", "session_id", "content", "kind", "event_time", until.alias("expires_at"), (F.col("kind") == "error").alias("consumed"))


@query(
    "agent_status",
    f"""WITH {EPISODES_SQL}, {WORKING_SQL}, e AS (SELECT user_id, session_id, count(*) AS episodes, count(*) FILTER (WHERE NOT consolidated) AS episodes_pending FROM ep GROUP BY ALL),
w AS (SELECT user_id, session_id, count(*) AS n FROM wl GROUP BY ALL)
SELECT user_id, session_id, episodes, episodes_pending, coalesce(n, 0) AS working_live FROM e LEFT JOIN w USING (user_id, session_id)""",
)
def agent_status(spark, sf_dir):
    return S.agent_status(_episodes(spark, sf_dir), _working(spark, sf_dir), AS_OF)


CONFLICTS_SQL = """
cf AS (SELECT event_id AS conflict_id, CAST(user_id AS VARCHAR) AS user_id, lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS older, event_id AS newer,
       CASE WHEN event_id % 4 = 0 THEN 'resolved' ELSE 'pending' END AS status FROM facts QUALIFY older IS NOT NULL)
"""


def _conflicts(facts):
    from pyspark.sql import Window as W

    prev = F.lag("fact_id").over(W.partitionBy("user_id").orderBy("fact_id"))
    c = facts.select(F.col("fact_id").alias("conflict_id"), "user_id", prev.alias("older"), F.col("fact_id").alias("newer"), F.when(F.col("fact_id") % 4 == 0, "resolved").otherwise("pending").alias("status"))
    return c.where("older IS NOT NULL")


@query(
    "pending_conflicts",
    f"""WITH {FACTS_SQL}, {CONFLICTS_SQL}, l AS (SELECT event_id FROM facts WHERE {LIVE})
SELECT conflict_id, older, newer, CASE WHEN status = 'pending' AND (older NOT IN (FROM l) OR newer NOT IN (FROM l)) THEN 'dismissed' ELSE status END AS status FROM cf""",
)
def pending_conflicts(spark, sf_dir):
    """Each fact beside the one before of its user, whatever its slot."""
    f = event_facts(spark, sf_dir)
    return S.settle_conflicts(_conflicts(f), f, AS_OF).select("conflict_id", "older", "newer", "status")


@query(
    "namespace_stats",
    f"""WITH {FACTS_SQL}, {EPISODES_SQL}, {WORKING_SQL}, {CONFLICTS_SQL}, fx AS (SELECT *, CAST(user_id AS VARCHAR) AS u, CASE WHEN event_type = 'view' THEN 'decision' ELSE event_type END AS kind FROM facts),
f AS (SELECT u AS user_id, count(*) FILTER (WHERE event_id % 4 <> 0) AS facts_hot, count(*) FILTER (WHERE event_id % 4 = 0) AS facts_cold, count(*) FILTER (WHERE {LIVE}) AS facts_live,
  count(*) FILTER (WHERE NOT ({LIVE})) AS facts_superseded, count(*) FILTER (WHERE event_type = 'purchase') AS facts_sensitive, min(ts_s) AS oldest_fact_valid_at, max(ts_s) AS newest_fact_valid_at FROM fx GROUP BY 1),
e AS (SELECT user_id, count(*) AS episodes, count(*) FILTER (WHERE consolidated) AS episodes_consolidated, count(*) FILTER (WHERE NOT consolidated) AS episodes_pending,
  count(*) FILTER (WHERE ephemeral) AS episodes_ephemeral, count(summary) AS summaries, min(event_time) AS first_event_at, max(event_time) AS last_event_at,
  max(event_time + 60) FILTER (WHERE source = 'agent_session') AS last_fed_at, count(DISTINCT session_id) FILTER (WHERE source = 'agent_session') AS fed_sessions FROM ep GROUP BY 1),
t AS (SELECT u AS user_id, count(*) AS conclusions FROM fx WHERE {LIVE} AND kind = 'decision' AND (u, u || ':' || CAST(floor(ts_s / 86400) AS BIGINT)) IN (SELECT (user_id, session_id) FROM ep WHERE source = 'agent_session') GROUP BY 1),
w AS (SELECT user_id, count(*) AS working_live FROM wl GROUP BY 1), c AS (SELECT user_id, count(*) AS pending_conflicts FROM cf WHERE status = 'pending' GROUP BY 1),
r AS (SELECT user_id, count(*) FILTER (WHERE known) AS relations, count(*) FILTER (WHERE NOT known) AS graph_stale_relations FROM (SELECT user_id, episode_id IN (SELECT event_id FROM facts) AS known FROM ep WHERE episode_id % 2 = 0) GROUP BY 1),
n AS (SELECT user_id, count(*) AS entities, count(*) FILTER (WHERE NOT linked) AS graph_orphan_entities FROM (SELECT user_id, session_id, bool_or(episode_id % 2 = 0) AS linked FROM ep GROUP BY ALL) GROUP BY 1)
SELECT user_id, coalesce(facts_hot, 0) AS facts_hot, coalesce(facts_cold, 0) AS facts_cold, coalesce(facts_live, 0) AS facts_live, coalesce(facts_superseded, 0) AS facts_superseded, coalesce(facts_sensitive, 0) AS facts_sensitive,
oldest_fact_valid_at, newest_fact_valid_at, episodes, episodes_consolidated, episodes_pending, episodes_ephemeral, summaries, first_event_at, last_event_at, last_fed_at, fed_sessions,
coalesce(conclusions, 0) AS conclusions, coalesce(working_live, 0) AS working_live, coalesce(pending_conflicts, 0) AS pending_conflicts, coalesce(relations, 0) AS relations,
coalesce(graph_stale_relations, 0) AS graph_stale_relations, entities, graph_orphan_entities, episodes_pending > 0 AS consolidation_backlog
FROM e LEFT JOIN f USING (user_id) LEFT JOIN t USING (user_id) LEFT JOIN w USING (user_id) LEFT JOIN c USING (user_id) LEFT JOIN r USING (user_id) LEFT JOIN n USING (user_id)""",
)
def namespace_stats(spark, sf_dir):
    """Views are decisions of the day they were made on; sessions are entities, and every second event an edge to its user's."""
    f, ep = _facts(spark, sf_dir), _episodes(spark, sf_dir)
    f = f.withColumn("predicate", F.when(F.col("predicate") == "view", "decision").otherwise(F.col("predicate")))
    f = f.withColumn("subject", F.concat("user_id", F.lit(":"), F.floor(F.col("valid_at") / 86400)))
    edges = ep.where("episode_id % 2 = 0").select("user_id", F.lit("me").alias("src"), F.col("session_id").alias("dst"), F.col("episode_id").alias("fact_id"))
    entities = ep.select("user_id", F.col("session_id").alias("key")).distinct()
    return S.namespace_stats(f, ep, _working(spark, sf_dir), _conflicts(f), entities, edges, AS_OF)


@query(
    "page_in",
    f"""WITH {FACTS_SQL}, h AS (SELECT event_id FROM facts WHERE event_id % 4 = 0 AND event_type = 'click' ORDER BY value DESC, event_id LIMIT 50)
SELECT event_id AS fact_id, CASE WHEN event_id % 4 = 0 AND event_id NOT IN (FROM h) THEN 'cold' ELSE 'hot' END AS tier,
CASE WHEN event_id IN (FROM h) THEN 1 ELSE 0 END AS access_count, CASE WHEN event_id IN (FROM h) THEN 1.5::DOUBLE ELSE 1.0::DOUBLE END AS salience FROM facts""",
)
def page_in(spark, sf_dir):
    """The fifty clicks of highest value that are cold are retrieved, and so become hot."""
    f = _facts(spark, sf_dir)
    hits = f.where("tier = 'cold' AND predicate = 'click'").orderBy(F.desc("value"), "fact_id").limit(50)
    return S.page_in(f, hits).select("fact_id", "tier", "access_count", "salience")


HISTORY_Q = "which purchase did 7 make before"


@query(
    "history_rows",
    f"""WITH {FACTS_SQL}, q AS (SELECT list_distinct({stems_sql("'" + HISTORY_Q + "'")}) AS qs),
m AS (SELECT f.*, len(list_intersect(qs, {stems_sql("user_id || ' ' || event_type || ' ' || event_id || ' ' || event_type || ' ' || event_id")})) > 0 AS hit FROM facts f, q),
k AS (SELECT a.event_id, a.supersedes FROM m a LEFT JOIN m b ON b.supersedes = a.event_id WHERE (a.hit AND (a.invalid_at IS NOT NULL OR a.supersedes IS NOT NULL OR b.event_id IS NOT NULL)) OR b.hit),
x AS (SELECT event_id FROM k UNION SELECT supersedes FROM k UNION SELECT m.event_id FROM m JOIN k ON m.supersedes = k.event_id)
SELECT event_id AS fact_id, strftime(make_timestamp(CAST(ts_s * 1000000 AS BIGINT)), '%Y-%m-%d') AS valid_from, coalesce(strftime(make_timestamp(CAST(invalid_at * 1000000 AS BIGINT)), '%Y-%m-%d'), 'current') AS valid_until,
CAST(user_id AS VARCHAR) AS subject, event_type AS attribute, CAST(event_id AS VARCHAR) AS value,
CASE WHEN ts_s > {AS_OF} THEN 'not yet valid' WHEN {LIVE} THEN 'current' WHEN invalid_at IS NOT NULL THEN 'superseded' ELSE 'past' END AS status
FROM facts WHERE event_id IN (SELECT event_id FROM x WHERE event_id IS NOT NULL) ORDER BY subject, attribute, ts_s, value, fact_id LIMIT 16""",
)
def history_rows(spark, sf_dir):
    return S.history_rows(_facts(spark, sf_dir), HISTORY_Q, AS_OF)


@query(
    "recall_spaces",
    f"""WITH {FACTS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts_s DESC, event_id) AS k FROM facts WHERE {LIVE} AND user_id % 10 = 3 AND event_type <> 'purchase'),
b AS (SELECT CAST(user_id AS VARCHAR) AS user_id, '## Space: ' || user_id || chr(10) || 'FACTS:' || chr(10) || string_agg('- [' || strftime(make_timestamp(CAST(ts_s * 1000000 AS BIGINT)), '%Y-%m-%d') || '] ' || event_type || ' ' || event_id, chr(10) ORDER BY k) AS block FROM r WHERE k <= 6 GROUP BY user_id)
SELECT *, CAST({TOKENS_SQL.format("block")} AS INTEGER) AS tokens FROM b""",
)
def recall_spaces(spark, sf_dir):
    """Every tenth user's space, read at once."""
    f = _facts(spark, sf_dir)
    spaces = [r[0] for r in f.select("user_id").distinct().where("cast(user_id as int) % 10 = 3").collect()]
    return S.multi_space(f, spaces, AS_OF, 6, sensitive=False)


@query("full_history_tokens", f"WITH {EPISODES_SQL} SELECT user_id, CAST(sum({TOKENS_SQL.format('content')}) AS BIGINT) AS full_tokens FROM ep WHERE event_time <= {AS_OF} GROUP BY user_id")
def full_history_tokens(spark, sf_dir):
    return S.full_history_tokens(_episodes(spark, sf_dir), AS_OF)


@query(
    "namespace_dirs",
    """SELECT page_id, coalesce(nullif(left(lower(regexp_replace(regexp_replace(url, '[^A-Za-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')), 48), ''), 'namespace') || '--' || left(sha256(url), 16) AS dir FROM pages WHERE url IS NOT NULL""",
)
def namespace_dirs(spark, sf_dir):
    return table(spark, sf_dir, "pages").where("url IS NOT NULL").select("page_id", S.namespace_dir(F.col("url")).alias("dir"))


@query(
    "remember_routing",
    "WITH m AS (SELECT conv_id, turn, lower(CASE WHEN conv_id % 9 = 0 THEN 'Today ' || coalesce(text, '') ELSE text END) AS said FROM conversations) SELECT conv_id, turn, CASE WHEN "
    + " OR ".join(f"contains(said, '{m}')" for m in V.EPHEMERAL_MARKS)
    + " THEN 'working' ELSE 'long' END AS scope FROM m",
)
def remember_routing(spark, sf_dir):
    """Turns as messages, those of each ninth conversation said to be of today."""
    c = table(spark, sf_dir, "conversations")
    said = F.when(F.col("conv_id") % 9 == 0, F.concat(F.lit("Today "), F.coalesce("text", F.lit("")))).otherwise(F.col("text"))
    m = c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("episode_id"), F.lit("u").alias("user_id"), F.col("conv_id").cast("string").alias("session_id"), said.alias("content"), F.col("turn").cast("double").alias("event_time"))
    episodes, items = S.remember(m)
    marked = episodes.join(items.select("session_id", "event_time", F.lit("working").alias("scope")), ["session_id", "event_time"], "left")
    return marked.select(F.col("session_id").cast("long").alias("conv_id"), F.col("event_time").cast("long").alias("turn"), F.coalesce("scope", F.lit("long")).alias("scope"))


@query(
    "working_memory_ops",
    f"WITH {WORKING_SQL} SELECT item_id FROM wl WHERE kind = 'click' AND item_id % 2 <> 0 AND session_id NOT IN (SELECT session_id FROM wm WHERE item_id % 5 = 0)",
)
def working_memory_ops(spark, sf_dir):
    """Even items are used up, the sessions of each fifth are closed, and clicks are listed."""
    w = _working(spark, sf_dir)
    left = S.clear_sessions(S.consume(w, w.where("item_id % 2 = 0")), w.where("item_id % 5 = 0"))
    users = w.select("user_id").distinct()
    live = left.join(users, "user_id").where(F.col("kind") == "click")
    return live.where(S.Life.working_live(AS_OF)).select("item_id")


@query(
    "close_session_outcomes",
    f"""WITH {FACTS_SQL}, n AS (SELECT item_id, CAST(item_id % 20 AS VARCHAR) AS session_id, trim(text) AS statement FROM benchmark WHERE trim(text) <> ''),
h AS (SELECT session_id, left(lower(statement), 120) AS k FROM n WHERE item_id % 3 = 0)
SELECT item_id FROM n WHERE (session_id, left(lower(statement), 120)) NOT IN (SELECT (session_id, k) FROM h)""",
)
def close_session_outcomes(spark, sf_dir):
    """Passages as conclusions of a session; each third is known already, and closing again does not add it."""
    b = table(spark, sf_dir, "benchmark").where("trim(text) <> ''")
    found = b.select("item_id", F.lit("u").alias("user_id"), (F.col("item_id") % 20).cast("string").alias("session_id"), F.lit("finding").alias("kind"), F.trim("text").alias("text"))
    facts = found.where("item_id % 3 = 0").select(
        "user_id", F.col("session_id").alias("subject"), F.lit("finding").alias("predicate"), F.concat("text", F.lit(" （依据：log）")).alias("text"),
        F.lit(0.0).alias("valid_at"), F.lit(None).cast("double").alias("invalid_at"), F.lit(None).cast("double").alias("expired_at"),
    )
    return S.new_outcomes(found, facts, AS_OF).select("item_id")
