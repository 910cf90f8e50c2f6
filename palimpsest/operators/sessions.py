"""Sessions: what one contributed, its closing, working memory, and the state of a namespace."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest import vocabulary as V
from palimpsest.functions import text as T
from palimpsest.operators import lifecycle as Life
from palimpsest.operators import temporal as Time

HIDDEN = "[redacted sensitive fact]"


def namespace_dir(user: Column) -> Column:
    """A folder name for a namespace: a readable prefix, and the hash that tells namespaces apart."""
    plain = F.left(F.lower(F.regexp_replace(F.regexp_replace(user, "[^A-Za-z0-9]+", "-"), "^-+|-+$", "")), F.lit(48))
    return F.concat(F.when(plain == "", "namespace").otherwise(plain), F.lit("--"), F.left(F.sha2(user.cast("binary"), 256), F.lit(16)))


def contributed(facts: DataFrame, episodes: DataFrame) -> DataFrame:
    """(user_id, session_id, fact_id, own): each session's facts, with those of its episodes that tell of them."""
    told = facts.select("user_id", "fact_id", F.explode("provenance").alias("episode_id"))
    both = told.join(episodes.select("user_id", "episode_id", "session_id"), ["user_id", "episode_id"])
    return both.groupBy("user_id", "session_id", "fact_id").agg(F.sort_array(F.collect_set("episode_id")).alias("own"))


def session_report(facts: DataFrame, episodes: DataFrame, t: float, sensitive: bool = False) -> DataFrame:
    """The facts of every session as an audit may show them: status, the session's own evidence, and text,
    which is hidden for sensitive facts unless asked for."""
    rows = contributed(facts, episodes).join(facts.drop("provenance"), ["user_id", "fact_id"])
    hidden = F.lit(False) if sensitive else F.coalesce("sensitive", F.lit(False))
    status = F.when(Time.live_at(t, expired="expired_at"), "live").otherwise("superseded")
    shown = lambda c: F.when(hidden, F.lit(HIDDEN)).otherwise(F.col(c))
    return rows.select("user_id", "session_id", "fact_id", status.alias("status"), hidden.alias("redacted"), F.size("own").alias("n_own"), shown("text").alias("text"))


def agent_status(episodes: DataFrame, working: DataFrame, t: float) -> DataFrame:
    """Per session, numbers alone: episodes, pending ones and live working items; no text."""
    ep = episodes.groupBy("user_id", "session_id").agg(F.count(F.lit(1)).alias("episodes"), F.count_if(~F.col("consolidated")).alias("episodes_pending"))
    live = working.where(Life.working_live(t)).groupBy("user_id", "session_id").agg(F.count(F.lit(1)).alias("working_live"))
    return ep.join(live, ["user_id", "session_id"], "full").fillna(0, ["episodes", "episodes_pending", "working_live"])


def namespace_stats(
    facts: DataFrame, episodes: DataFrame, working: DataFrame, conflicts: DataFrame, entities: DataFrame, edges: DataFrame, t: float
) -> DataFrame:
    """A namespace in numbers, one row a user. Every table is aggregated by user before it meets the others.

    facts: with tier; episodes: with consolidated, ephemeral, summary, source, event_time and ingested_at;
    edges: (user_id, src, dst, fact_id); entities: (user_id, key).
    """
    live = Time.live_at(t, expired="expired_at")
    f = facts.groupBy("user_id").agg(
        F.count_if(F.col("tier") != "cold").alias("facts_hot"), F.count_if(F.col("tier") == "cold").alias("facts_cold"),
        F.count_if(live).alias("facts_live"), F.count_if(~live).alias("facts_superseded"), F.count_if("sensitive").alias("facts_sensitive"),
        F.min("valid_at").alias("oldest_fact_valid_at"), F.max("valid_at").alias("newest_fact_valid_at"),
    )
    fed = F.col("source") == "agent_session"
    e = episodes.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("episodes"), F.count_if("consolidated").alias("episodes_consolidated"), F.count_if(~F.col("consolidated")).alias("episodes_pending"),
        F.count_if("ephemeral").alias("episodes_ephemeral"), F.count_if(F.coalesce("summary", F.lit("")) != "").alias("summaries"),
        F.min("event_time").alias("first_event_at"), F.max("event_time").alias("last_event_at"),
        F.max(F.when(fed, F.col("ingested_at"))).alias("last_fed_at"), F.countDistinct(F.when(fed, F.col("session_id"))).alias("fed_sessions"),
    )
    sessions = episodes.where(fed).select("user_id", F.col("session_id").alias("subject")).distinct()
    told = facts.where(live & F.lower("predicate").isin(*V.OUTCOME_KINDS)).join(sessions, ["user_id", "subject"], "left_semi")
    told = told.groupBy("user_id").agg(F.count(F.lit(1)).alias("conclusions"))
    w = working.where(Life.working_live(t)).groupBy("user_id").agg(F.count(F.lit(1)).alias("working_live"))
    c = conflicts.where("status = 'pending'").groupBy("user_id").agg(F.count(F.lit(1)).alias("pending_conflicts"))
    known = edges.join(facts.select("user_id", "fact_id").withColumn("_k", F.lit(True)), ["user_id", "fact_id"], "left")
    r = known.groupBy("user_id").agg(F.count("_k").alias("relations"), F.count_if(F.col("_k").isNull()).alias("graph_stale_relations"))
    ends = edges.select("user_id", F.col("src").alias("key")).union(edges.select("user_id", "dst")).distinct().withColumn("_k", F.lit(True))
    n = entities.select("user_id", "key").join(ends, ["user_id", "key"], "left").groupBy("user_id").agg(
        F.count(F.lit(1)).alias("entities"), F.count_if(F.col("_k").isNull()).alias("graph_orphan_entities")
    )
    out = f
    for part in (e, told, w, c, r, n):
        out = out.join(part, "user_id", "full")
    times = {"oldest_fact_valid_at", "newest_fact_valid_at", "first_event_at", "last_event_at", "last_fed_at", "user_id"}
    return out.fillna(0, [x for x in out.columns if x not in times]).withColumn("consolidation_backlog", F.col("episodes_pending") > 0)


# working memory: items (item_id, user_id, session_id, content, kind, event_time, expires_at, consumed)
WORKING = "item_id string, user_id string, session_id string, content string, kind string, event_time double, expires_at double, consumed boolean"


def remember(messages: DataFrame, scope: str = "auto", ttl: float | None = None) -> tuple[DataFrame, DataFrame]:
    """messages(episode_id, user_id, session_id, content, event_time) as (episodes, working items).

    Every message is an episode. One of a passing state is an item as well, and its episode
    counts as consolidated, so that no durable fact comes of it.
    """
    passing = {"auto": T.ephemeral(F.col("content")), "working": F.lit(True), "long": F.lit(False)}[scope]
    rows = messages.withColumn("ephemeral", passing)
    episodes = rows.withColumn("consolidated", F.col("ephemeral"))
    until = F.lit(None).cast("double") if ttl is None else F.col("event_time") + ttl
    items = rows.where("ephemeral").select(
        F.concat(F.lit("wm_"), F.left(F.sha2(F.concat_ws("\x1f", "user_id", "session_id", "episode_id"), 256), F.lit(12))).alias("item_id"),
        "user_id", "session_id", "content", F.lit("state").alias("kind"), "event_time", until.alias("expires_at"), F.lit(False).alias("consumed"),
    )
    return episodes, items


def working_items(items: DataFrame, user: str, t: float, session: str | None = None, kind: str | None = None) -> DataFrame:
    """What is live of a user's working memory."""
    own = items.where((F.col("user_id") == user) & Life.working_live(t, session))
    return own.where(F.col("kind") == kind) if kind else own


def consume(items: DataFrame, used: DataFrame) -> DataFrame:
    """``items`` with those of used(item_id) marked as consumed."""
    hit = used.select("item_id").distinct().withColumn("_u", F.lit(True))
    return items.join(hit, "item_id", "left").withColumn("consumed", F.col("consumed") | F.coalesce("_u", F.lit(False))).select(*items.columns)


def clear_sessions(items: DataFrame, closed: DataFrame) -> DataFrame:
    """``items`` without those of closed(user_id, session_id)."""
    return items.join(closed.select("user_id", "session_id").distinct(), ["user_id", "session_id"], "left_anti").select(*items.columns)


def settle_conflicts(conflicts: DataFrame, facts: DataFrame, t: float) -> DataFrame:
    """conflicts(conflict_id, user_id, older, newer, status): a pending one of which a side is gone or no longer
    live is dismissed."""
    live = facts.where(Time.live_at(t, expired="expired_at")).select("user_id", "fact_id")
    for side in ("older", "newer"):
        conflicts = conflicts.join(live.withColumnRenamed("fact_id", side).withColumn(f"_{side}", F.lit(True)), ["user_id", side], "left")
    gone = F.col("_older").isNull() | F.col("_newer").isNull()
    status = F.when((F.col("status") == "pending") & gone, "dismissed").otherwise(F.col("status"))
    return conflicts.select("conflict_id", "user_id", "older", "newer", status.alias("status"))


def judge_conflicts(pairs: DataFrame, facts: DataFrame, judge, seen: DataFrame | None = None) -> DataFrame:
    """Pairs (a, b) that ``judge(text, text)`` calls a contradiction; a model that is shipped to the workers.
    Pairs in ``seen`` are not asked again."""
    import pandas as pd

    if seen is not None:
        pairs = pairs.join(seen.select("a", "b"), ["a", "b"], "left_anti")

    @F.pandas_udf("boolean")
    def says(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([bool(judge(a, b)) for a, b in zip(x, y, strict=True)])

    text = facts.select("fact_id", "text")
    both = pairs.join(text.toDF("a", "_x"), "a").join(text.toDF("b", "_y"), "b")
    return both.where(says("_x", "_y")).select("a", "b")


def new_outcomes(found: DataFrame, facts: DataFrame, t: float) -> DataFrame:
    """found(user_id, session_id, kind, text): conclusions that no live fact of the session holds yet, by the first
    120 characters of the statement; closing a session twice adds nothing."""
    key = lambda c: F.left(F.lower(T.outcome_parts(F.col(c))["statement"]), F.lit(120))
    held = facts.where(Time.live_at(t, expired="expired_at") & F.lower("predicate").isin(*V.OUTCOME_KINDS))
    held = held.select("user_id", F.col("subject").alias("session_id"), key("text").alias("_k")).distinct()
    return found.withColumn("_k", key("text")).join(held, ["user_id", "session_id", "_k"], "left_anti").drop("_k")


def page_in(facts: DataFrame, hits: DataFrame, boost: float = 0.5) -> DataFrame:
    """``facts`` with the cold ones of hits(fact_id) hot again, and reinforced."""
    hit = hits.select("fact_id").distinct().withColumn("_h", F.lit(True))
    warm = F.coalesce("_h", F.lit(False)) & (F.col("tier") == "cold")
    more = F.when(warm, 1).otherwise(0)
    changed = {"salience": F.col("salience") + boost * more, "access_count": F.col("access_count") + more, "tier": F.when(warm, "hot").otherwise(F.col("tier"))}
    return facts.join(hit, "fact_id", "left").withColumns(changed).select(*facts.columns)


def history_rows(facts: DataFrame, query: str, t: float, limit: int = 16) -> DataFrame:
    """Supersession evidence: chain members whose words the query shares, or whose replacement does, and what
    stands directly before and after them."""
    q = F.lit(query)
    own = facts.select("fact_id", "subject", "predicate", "object", "text", "valid_at", "invalid_at", "expired_at", "supersedes")
    newer = own.where("supersedes IS NOT NULL").select(F.col("supersedes").alias("fact_id"), F.col("fact_id").alias("next"))
    words = F.concat_ws(" ", "subject", F.replace("predicate", F.lit("_"), F.lit(" ")), "object", "text", T.predicate_aliases(F.col("predicate")))
    touched = own.where(F.size(T.overlap_terms(q, words)) > 0).select("fact_id", "supersedes")
    links = newer.join(touched.select(F.col("fact_id").alias("next")), "next")  # the query fits what came after
    # a fact that the query fits counts if it is in a chain; one whose replacement fits is in a chain as it is
    ended = own.where("invalid_at IS NOT NULL OR expired_at IS NOT NULL OR supersedes IS NOT NULL").select("fact_id")
    chained = touched.join(ended.union(newer.select("fact_id")).distinct(), "fact_id", "left_semi")
    core = chained.select("fact_id").union(links.select("fact_id")).distinct()
    old = own.join(core, "fact_id").where("supersedes IS NOT NULL").select(F.col("supersedes").alias("fact_id"))
    after = newer.join(core, "fact_id").select(F.col("next").alias("fact_id"))
    chosen = core.union(old).union(after).distinct()
    replaced = newer.select("fact_id").distinct().withColumn("_r", F.lit(True))
    rows = own.join(chosen, "fact_id", "left_semi").join(replaced, "fact_id", "left")
    status = (
        F.when(F.col("valid_at") > t, "not yet valid").when(Time.live_at(t, expired="expired_at"), "current").when(F.col("_r"), "superseded").otherwise("past")
    )
    first = rows.orderBy(F.lower("subject"), F.lower("predicate"), "valid_at", F.lower("object"), "fact_id").limit(limit)
    until = F.coalesce(T.epoch_date(F.col("invalid_at")), F.lit("current"))
    attribute = F.replace("predicate", F.lit("_"), F.lit(" ")).alias("attribute")
    return first.select("fact_id", T.epoch_date(F.col("valid_at")).alias("valid_from"), until.alias("valid_until"), "subject", attribute, F.col("object").alias("value"), status.alias("status"))


def multi_space(facts: DataFrame, spaces: list[str], t: float, n: int = 6, sensitive: bool = True) -> DataFrame:
    """(user_id, block, tokens): for each space its n newest live facts as lines under its name, in one plan: ranks
    are by space, and no edge crosses them."""
    from pyspark.sql import Window as W

    own = facts.where(F.col("user_id").isin(*spaces) & Time.live_at(t, expired="expired_at"))
    own = own if sensitive else own.where(~F.coalesce("sensitive", F.lit(False)))
    w = W.partitionBy("user_id").orderBy(F.desc("valid_at"), "fact_id")
    top = own.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n)
    line = F.concat(F.lit("- ["), T.epoch_date(F.col("valid_at")), F.lit("] "), F.col("text"))
    lines = top.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("_rn", line.alias("l")))).alias("ls"))  # n lines at most
    block = F.concat(F.lit("## Space: "), F.col("user_id"), F.lit("\nFACTS:\n"), F.array_join(F.transform("ls", lambda x: x["l"]), "\n"))
    made = lines.select("user_id", block.alias("block"))
    return made.withColumn("tokens", T.tokens_cjk(F.col("block")))


def full_history_tokens(episodes: DataFrame, t: float | None = None) -> DataFrame:
    """(user_id, full_tokens): what all of a user's episodes up to t would cost in a prompt."""
    seen = episodes if t is None else episodes.where(F.col("event_time") <= t)
    return seen.groupBy("user_id").agg(F.sum(T.tokens_cjk(F.col("content"))).alias("full_tokens"))
