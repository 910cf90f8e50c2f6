"""How memory ages and is edited: decay, tiers, focus, working memory, updates and deletions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.functions import text as T
from palimpsest.operators.ordering import spread_rank
from palimpsest.operators.ranking import near_pairs


def decay_sweep(facts: DataFrame, t: float, per_day: float = 0.02, floor: float = 0.3) -> DataFrame:
    """Live, never read, non-durable facts get the salience of their age at the newest fact of the store."""
    last = facts.agg(F.max("valid_at").alias("_last"))  # one row
    live = (F.col("valid_at") <= t) & (F.col("invalid_at").isNull() | (F.col("invalid_at") > t)) & (F.col("expired_at").isNull() | (F.col("expired_at") > t))
    aged = F.greatest(F.lit(floor), F.exp(-per_day * F.greatest(F.lit(0.0), F.col("_last") - F.col("valid_at")) / T.DAY))
    fades = live & (F.col("access_count") == 0) & ~T.durable(F.col("predicate"))
    return facts.crossJoin(F.broadcast(last)).withColumn("salience", F.when(fades, aged).otherwise(F.col("salience"))).drop("_last")


def reinforce(facts: DataFrame, log: DataFrame, boost: float = 0.5) -> DataFrame:
    """Salience, count and last access from an append-only log(fact_id, at); reads stay free of writes."""
    n = log.groupBy("fact_id").agg(F.count(F.lit(1)).alias("_n"), F.max("at").alias("_at"))
    out = facts.join(n, "fact_id", "left")
    more = F.coalesce("_n", F.lit(0))
    return out.withColumns({"access_count": F.col("access_count") + more, "last_access": F.coalesce("_at", "last_access"), "salience": F.col("salience") + boost * more}).drop("_n", "_at")


def evict_cold(facts: DataFrame, most_hot: int) -> DataFrame:
    """``facts`` with tier: of the non-durable, the least salient and longest unread are cold, as many
    as exceed ``most_hot``. Their ranks are counted over ranges, so that no task ranks the store."""
    out = max(0, facts.count() - most_hot)
    if not out:
        return facts.withColumn("tier", F.lit("hot"))
    fading = facts.where(~T.durable(F.col("predicate"))).select("fact_id", "salience", "last_access")
    ranked = spread_rank(fading, [F.asc("salience"), F.asc("last_access"), F.asc("fact_id")])
    cold = ranked.where(F.col("rank") <= out).select("fact_id").withColumn("_c", F.lit(True))
    return facts.join(cold, "fact_id", "left").withColumn("tier", F.when(F.col("_c"), "cold").otherwise("hot")).drop("_c")


def in_focus(text: Column, terms: list[str]) -> Column:
    """Some term is a substring, in any case."""
    return T.has_any(F.lower(text), tuple(t.lower() for t in terms)) if terms else F.lit(False)


def apply_focus(facts: DataFrame, track: list[str], mute: list[str]) -> DataFrame:
    """Tracked facts gain half a point of salience, to five at most; muted ones go."""
    up = F.when(in_focus(F.col("text"), track), F.least(F.lit(5.0), F.col("salience") + 0.5)).otherwise(F.col("salience"))
    return facts.where(~in_focus(F.col("text"), mute)).withColumn("salience", up)


def working_live(t: float, session: str | None = None) -> Column:
    c = ~F.col("consumed") & (F.col("expires_at").isNull() | (F.col("expires_at") > t))
    return c & (F.col("session_id") == session) if session else c


def sweep_working(items: DataFrame, t: float) -> DataFrame:
    """What has neither been used up nor expired."""
    return items.where(working_live(t))


def route(messages: DataFrame) -> DataFrame:
    """``scope``: working for statements of a passing state, else long."""
    return messages.withColumn("scope", F.when(T.ephemeral(F.col("content")), "working").otherwise("long"))


def edit_fact(facts: DataFrame, fact_id: str, **changes) -> DataFrame:
    """The fact rewritten as the user says: both intervals open again, text and category anew."""
    hit = F.col("fact_id") == fact_id
    out = facts
    for name, value in changes.items():
        out = out.withColumn(name, F.when(hit, F.lit(value)).otherwise(F.col(name)))
    text = T.fact_text(F.col("subject"), F.col("predicate"), F.col("object"))
    new = {"text": text, "source": F.lit("user"), "invalid_at": F.lit(None), "expired_at": F.lit(None)}
    if "category" not in changes:
        new["category"] = T.category(F.col("predicate"), F.col("object"), text)
    if "sensitive" not in changes:
        new["sensitive"] = F.col("sensitive") | T.sensitive(F.col("predicate"), F.col("object"), text)
    return out.withColumns({k: F.when(hit, v).otherwise(F.col(k)) for k, v in new.items()})


def delete_facts(facts: DataFrame, ids: DataFrame) -> DataFrame:
    return facts.join(ids.select("fact_id"), "fact_id", "left_anti")


def clear_slot(facts: DataFrame, user: str, subject: str, predicate: str, expected: int, t: float) -> DataFrame:
    """``facts`` without a slot's live, not user-made ones; refused if they are not as many as expected."""
    live = (F.col("invalid_at").isNull() | (F.col("invalid_at") > t)) & (F.col("expired_at").isNull() | (F.col("expired_at") > t))
    hit = (F.col("user_id") == user) & (F.col("subject") == subject) & (F.col("predicate") == predicate) & (F.col("source") != "user") & live
    n = facts.where(hit).count()
    if n != expected:
        raise ValueError(f"the slot holds {n} facts, not {expected}")
    return facts.where(~F.coalesce(hit, F.lit(False)))


def classify(facts: DataFrame) -> DataFrame:
    """Category and sensitivity where there is no category yet; a sensitive mark is never taken back."""
    blank = F.coalesce(F.col("category"), F.lit("")) == ""
    args = (F.col("predicate"), F.col("object"), F.col("text"))
    return facts.withColumns(
        {
            "category": F.when(blank, T.category(*args)).otherwise(F.col("category")),
            "sensitive": F.when(blank, F.coalesce(F.col("sensitive"), F.lit(False)) | T.sensitive(*args)).otherwise(F.col("sensitive")),
        }
    )


def conflict_pairs(facts: DataFrame, lo: float = 0.62, hi: float = 0.94, seen: DataFrame | None = None) -> DataFrame:
    """Pairs of one user and subject that may contradict: near vectors, or one object under two predicates.
    ``seen`` has judged pairs (a, b), the smaller id first.

    One object is an equality, so those pairs are a join of their own. Near vectors of other objects meet as matrices,
    in parts of a subject of bounded size; no pair that is not near leaves them, and none comes twice, so that pairs
    are neither joined nor sorted. A fact_id names one fact.
    """
    subject = F.concat_ws("\x1f", F.coalesce("user_id", F.lit("")), F.lower("subject"))
    f = facts.select("fact_id", subject.alias("key"), F.lower(F.trim("object")).alias("o"), F.col("predicate").alias("p"), "embedding")
    said = f.select("fact_id", "key", "o", "p")
    one = said.toDF("a", "key", "o", "pa").join(said.toDF("b", "key", "o", "pb"), ["key", "o"]).where("a < b AND pa <> pb").select("a", "b")
    what = F.coalesce(F.concat(F.lit("o"), "o"), F.concat(F.lit("p"), "p"), F.lit(""))  # no object: facts differ by predicate
    near = near_pairs(f, "key", "fact_id", "embedding", lo, hi, what).select("a", "b")
    pairs = one.unionByName(near)
    return pairs.join(seen, ["a", "b"], "left_anti") if seen is not None else pairs


def resolve_conflict(facts: DataFrame, older: str, newer: str, keep: str, t: float) -> DataFrame:
    """keep 'newer' or 'older' retires the other at t; 'both' changes nothing."""
    gone = {"newer": older, "older": newer}.get(keep)
    if not gone:
        return facts
    hit = F.col("fact_id") == gone
    return facts.withColumns(
        {"invalid_at": F.when(hit, F.coalesce("invalid_at", F.lit(t))).otherwise(F.col("invalid_at")), "expired_at": F.when(hit, F.lit(t)).otherwise(F.col("expired_at"))}
    )


def summarise(episodes: DataFrame, most: int = 400) -> DataFrame:
    """Excerpts for episodes without a summary: blanks collapsed, cut to ``most`` characters."""
    cut = F.left(F.trim(F.regexp_replace("content", r"\s+", " ")), F.lit(most))
    return episodes.withColumn("summary", F.when(F.coalesce("summary", F.lit("")) == "", cut).otherwise(F.col("summary")))


def reflect(facts: DataFrame, episodes: DataFrame, t: float) -> DataFrame:
    """Notes on what changed: superseded facts, their live replacement and the summaries of its sessions."""
    live = (F.col("n.invalid_at").isNull() | (F.col("n.invalid_at") > t)) & (F.col("n.expired_at").isNull() | (F.col("n.expired_at") > t))
    both = facts.alias("o").join(facts.alias("n").where(live), F.col("n.supersedes") == F.col("o.fact_id"))
    said = both.select(F.col("o.fact_id").alias("fact_id"), F.col("n.fact_id").alias("replaced_by"), F.explode_outer("n.provenance").alias("episode_id"))
    notes = said.join(episodes.select("episode_id", "summary"), "episode_id", "left")
    return notes.groupBy("fact_id", "replaced_by").agg(F.array_join(F.array_sort(F.collect_set("summary")), "\n").alias("note"))


def latest_log(log: DataFrame, key: str, at: str, most: int = 512) -> DataFrame:
    """The last ``most`` rows of each key."""
    w = W.partitionBy(key).orderBy(F.desc(at))
    return log.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= most).drop("_rn")
