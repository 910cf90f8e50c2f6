"""Evidence blocks: provenance, procedures, preferences, and the bounded context they are packed into."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest import vocabulary as V
from palimpsest.functions import text as T
from palimpsest.operators import context as Context
from palimpsest.operators import ranking as R
from palimpsest.operators import temporal as Time
from palimpsest.session import cut_lineage


def provenance(facts: DataFrame, episodes: DataFrame, query: str, limit: int = 4, past: bool = False, t: float | None = None) -> DataFrame:
    """Episodes behind ranked facts(fact_id, rank, text, provenance, valid_at ..): the best score of each
    by overlaps of query, fact and episode, with a head start for past facts in history questions."""
    q = F.lit(query)
    said = facts.select("fact_id", "rank", "text", F.explode("provenance").alias("episode_id"), *[c for c in ("invalid_at", "sensitive") if c in facts.columns])
    both = said.join(episodes.select("episode_id", "content", "event_time"), "episode_id")
    a = F.size(T.overlap_terms(q, F.col("text")))
    score = 8 * a + 3 * F.size(T.overlap_terms(F.col("text"), F.col("content"))) + 2 * F.size(T.overlap_terms(q, F.col("content")))
    if past and t is not None:
        score = score + F.when(F.col("invalid_at") <= t, 96).otherwise(0)
    rows = both.withColumns({"_a": a, "score": score}).where("_a > 0")
    if "sensitive" in facts.columns:
        rows = rows.where(~F.coalesce("sensitive", F.lit(False)))
    w = W.partitionBy("episode_id").orderBy(F.desc("score"), "rank")
    best = rows.withColumn("_rn", F.row_number().over(w)).where("_rn = 1")
    return best.orderBy(F.desc("score"), "rank", F.desc("event_time"), "episode_id").limit(limit).select("episode_id", "fact_id", "score", T.best_snippet(F.col("content"), q).alias("snippet"))


def preferences(facts: DataFrame, query: str, limit: int = 24) -> DataFrame:
    """Preference facts, those that the query touches first, then the newest."""
    rows = facts.where(T.has_any(F.lower("predicate"), V.PREFERENCE_MARKS))
    hit = F.size(T.overlap_terms(F.lit(query), F.concat_ws(" ", "predicate", "object"))) > 0
    return rows.orderBy(F.desc(hit), F.desc("valid_at"), "seq").limit(limit)


def browse(facts: DataFrame, t: float, status: str | None = None, kind: str | None = None, needle: str = "", sensitive: bool = False) -> DataFrame:
    """Facts by status (live or superseded), kind (outcomes or attributes) and text; sensitive ones only if asked for."""
    live = (F.col("valid_at") <= t) & (F.col("invalid_at").isNull() | (F.col("invalid_at") > t)) & (F.col("expired_at").isNull() | (F.col("expired_at") > t))
    c: Column = F.lit(True)
    if status:
        c = c & (live if status == "live" else ~live)
    if kind:
        outcome = F.lower("predicate").isin(*V.OUTCOME_KINDS)
        c = c & (outcome if kind == "outcomes" else ~outcome)
    if needle:
        c = c & F.contains(F.lower("text"), F.lit(needle.lower()))
    return facts.where(c if sensitive else c & ~F.coalesce("sensitive", F.lit(False)))


def readable(table: DataFrame, home: str, spaces: list[str]) -> DataFrame:
    """Rows of a principal's home and of the spaces they may read: a pruned scan of the user partitions."""
    return table.where(F.col("user_id").isin(home, *spaces))


def union_first(lists: list[DataFrame], id_col: str = "fact_id") -> DataFrame:
    """Ranked lists (id, rank) as one: each id where it came first, by list and then by rank."""
    every = reduce(DataFrame.unionByName, [x.select(id_col, "rank").withColumn("list_no", F.lit(i)) for i, x in enumerate(lists)])
    return every.groupBy(id_col).agg(F.min(F.struct("list_no", "rank")).alias("m")).orderBy("m.list_no", "m.rank").select(id_col, "m.list_no", "m.rank")


def seats(lists: DataFrame, k: int) -> list:
    """A place for each subquery's best unseen id, then the main list (list_no 0), then the rest; ``lists`` is
    (list_no, rank, id) of a few ranked heads."""
    rows = [(r["list_no"], r["rank"], r["id"]) for r in lists.where(F.col("rank") <= k).orderBy("list_no", "rank").collect()]
    out: list = []
    for n in sorted({r[0] for r in rows} - {0}):
        free = next((i for m, _, i in rows if m == n and i not in out), None)
        if free is not None and len(out) < k:
            out.append(free)
    for _, _, i in sorted(rows, key=lambda r: (r[0] != 0, r[1], r[0])):
        if i not in out and len(out) < k:
            out.append(i)
    return out


def head_and_tail(text: Column, budget: int, mark: str = "\n…\n") -> Column:
    """The first 35 % and the last 65 % of a long text's budget."""
    head = int(budget * 0.35)
    return F.when(F.length(text) <= budget, text).otherwise(F.concat(F.left(text, F.lit(head)), F.lit(mark), F.right(text, F.lit(budget - head))))


def summary_answer(summaries: DataFrame, query: str, k: int = 6) -> DataFrame:
    """Of the k best summaries by words, the one that shares most telling terms with the query, if any does."""
    top = R.bm25(summaries, query, "episode_id", "summary").orderBy(F.desc("score"), "id").limit(k)
    s = summaries.join(top.select(F.col("id").alias("episode_id")), "episode_id")
    common = T.overlap_terms(F.lit(query), F.col("summary"))
    telling = F.size(F.array_except(common, T.words(*Context.GENERIC_TERMS)))
    return s.withColumns({"telling": telling, "common": F.size(common)}).where("telling > 0").orderBy(F.desc("telling"), F.desc("common"), F.desc("event_time")).limit(1)


def episode_search(episodes: DataFrame, query: str, vector: list[float], k: int = 5, t: float | None = None) -> DataFrame:
    """Dense candidates, then words over that pool, fused; the dense order alone where the pool is no larger than k."""
    pool = max(5 * k, 25)
    seen = episodes.where(F.col("event_time") <= t) if t is not None else episodes
    near = cut_lineage(R.vector_top_k(seen, vector, pool, "embedding", "episode_id").join(seen.select("episode_id", "content"), "episode_id"))
    dense = R.rank_by(near.select(F.col("episode_id").alias("id"), "score"))
    if near.count() <= k:
        return dense.orderBy("rank").select("id", "rank")
    words = R.bm25(near, query, "episode_id", "content").select("id", "score")
    every = near.select(F.col("episode_id").alias("id")).join(words, "id", "left").fillna({"score": 0.0})
    both = dense.select(F.lit("dense").alias("signal"), "id", "rank").unionByName(R.rank_by(every).select(F.lit("lex").alias("signal"), "id", "rank"))
    fused = R.weighted_rrf(both, {"dense": 1.0, "lex": 1.0})
    return R.rank_by(fused.withColumnRenamed("fused", "score")).where(F.col("rank") <= k).select("id", "rank")


def fact_lines(facts: DataFrame, limit: int) -> str:
    rows = facts.orderBy(F.desc("valid_at"), "seq").limit(limit).select(T.epoch_date(F.col("valid_at")).alias("d"), "text").collect()
    return "\n".join(f"- [{r['d']}] {r['text']}" for r in rows)


def lean_context(facts: DataFrame, episodes: DataFrame, query: str, user: str, t: float, budget: int = 6000, n_facts: int = 15, n_chunks: int = 2) -> str:
    """The bounded context of a question: blocks that its shape calls for, packed within the budget.

    Each block is a limited plan; the driver sees their few rows only.
    """
    need = Context.plan_evidence(query)
    own = cut_lineage(facts.where(F.col("user_id") == user))
    live = own.where(Time.live_at(t, expired="expired_at"))
    ranked = [Context.hybrid(own, q, user, t, max(n_facts, need.n_facts)).withColumn("rank", F.monotonically_increasing_id()) for q in (query, *need.subqueries[:2])]
    top = cut_lineage(union_first(ranked).withColumn("_o", F.struct("list_no", "rank")).join(live, "fact_id"))
    blocks = []

    def add(title: str, body: str) -> None:
        if body:
            blocks.append(f"{title}\n{body}")

    add("FACTS:", fact_lines(top, n_facts))
    state = [f"{r['subject']} | {r['predicate']} | {r['object']}" for r in Time.current_state(live).collect()]
    add("CURRENT STATE (live facts only):", "\n".join(state) if need.current_state else "")
    add("PREFERENCE RECORDS:", fact_lines(preferences(live, query), 24) if need.preference else "")
    add("PROCEDURAL MEMORY:", fact_lines(Context.procedures(own, query, user, t), 6) if need.procedural else "")
    if need.history:
        old = Context.history_answer(own, query, user, t).first()
        add("FACT HISTORY:", f"- {old['older']['text']} -> {old['newer']['text']}" if old else "")
    if episodes is not None:
        w = top.withColumn("rank", F.col("_o.rank"))
        chunks = provenance(w, episodes, query, max(n_chunks, need.n_chunks)).collect()
        add("PROVENANCE RAW:", "\n".join(f"- {r['snippet']}" for r in chunks))
    return Context.pack(blocks, budget, need)


def writable(table: DataFrame, home: str, spaces: list[str]) -> DataFrame:
    """Rows of a principal's home and of the spaces they may write."""
    return table.where(F.col("user_id").isin(home, *spaces))


def allowed(requests: DataFrame, principals: DataFrame) -> DataFrame:
    """requests(principal, space, mode) with ``ok``: home is always allowed, other spaces by the principal's lists, and
    what may be written may be read."""
    p = principals.select("principal", "home", "readable", "writable")
    may_write = F.array_contains("writable", F.col("space"))
    may_read = F.array_contains("readable", F.col("space")) | may_write
    ok = (F.col("space") == F.col("home")) | F.when(F.col("mode") == "write", may_write).otherwise(may_read)
    return requests.join(p, "principal", "left").withColumn("ok", F.coalesce(ok, F.lit(False))).select(*requests.columns, "ok")


def haystack(messages: DataFrame, by: str, most: int = 600_000, newest_first: bool = False) -> DataFrame:
    """(by, text): the sessions of each question as one text, by date and then session, cut to ``most`` characters.
    messages: (by, session_id, event_time, pos, role, content)."""
    line = F.concat(F.lit("["), F.col("role"), F.lit("] "), F.coalesce("content", F.lit("")))
    turns = messages.groupBy(by, "session_id").agg(F.min("event_time").alias("at"), F.array_sort(F.collect_list(F.struct("pos", line.alias("l")))).alias("ls"))
    body = F.array_join(F.transform("ls", lambda x: x["l"]), "\n")
    at = -F.col("at") if newest_first else F.col("at")
    told = turns.select(by, F.struct(at.alias("at"), "session_id", body.alias("b")).alias("s"))
    return told.groupBy(by).agg(F.array_sort(F.collect_list("s")).alias("ss")).select(by, F.left(F.array_join(F.transform("ss", lambda s: s["b"]), "\n"), F.lit(most)).alias("text"))
