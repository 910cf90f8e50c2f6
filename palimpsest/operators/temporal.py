"""Bi-temporal operators: supersession, liveness, slot heads and histories.

A fact is valid on [valid_at, invalid_at) and known on [created_at, expired_at);
NULL ends are open. Times are epoch seconds as doubles, and no plan reads the clock.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from palimpsest.functions import text as T


def supersede(df: DataFrame, slot: list[str], value: str, at: str, seq: str) -> DataFrame:
    """Closed form of exact-slot supersession for single-valued slots in time order.

    A row that repeats its slot's previous value is a duplicate; each kept row ends
    where the next begins. One shuffle on the slot serves both windows.
    """
    w = W.partitionBy(*slot).orderBy(at, seq)
    kept = (
        df.withColumn("_pv", F.lag(value).over(w))
        .withColumn("_rn", F.row_number().over(w))
        .where((F.col("_rn") == 1) | ~F.col(value).eqNullSafe(F.col("_pv")))
        .drop("_pv", "_rn")
    )
    return kept.withColumns(
        {
            "invalid_at": F.lead(at).over(w),
            "supersedes": F.lag(seq).over(w),
            "previous_value": F.lag(value).over(w),
        }
    )


def facts_from_events(events: DataFrame) -> DataFrame:
    """events(user_id, event_type, value, ts, event_id) as facts of slot (user, type)."""
    rows = events.select(
        "event_id", "user_id", "event_type", "value", T.seconds_of("ts").alias("valid_at")
    )
    return supersede(rows, ["user_id", "event_type"], "value", "valid_at", "event_id").withColumn(
        "expired_at", F.col("invalid_at")
    )


def live_at(t: float | Column, valid="valid_at", invalid="invalid_at", expired: str | None = None) -> Column:
    """valid_at <= t < invalid_at, and not yet expired where that column is named."""
    t = F.lit(t) if not isinstance(t, Column) else t
    c = (F.col(valid) <= t) & (F.col(invalid).isNull() | (F.col(invalid) > t))
    return c & (F.col(expired).isNull() | (F.col(expired) > t)) if expired else c


def as_of(facts: DataFrame, t: float) -> DataFrame:
    return facts.where(live_at(t))


def strict_as_of(facts: DataFrame, t: float, known_at: float) -> DataFrame:
    """Valid at t and, beyond the plain read, recorded and not expired by ``known_at``."""
    return facts.where(live_at(t) & (F.col("created_at") <= known_at) & (F.col("expired_at").isNull() | (F.col("expired_at") > known_at)))


def as_of_join(probes: DataFrame, facts: DataFrame, slot: list[str], at: str) -> DataFrame:
    """Each probe beside the fact of its slot that is valid at its time; a shuffle on the slot only."""
    f = facts.alias("f")
    on = [probes[c] == F.col(f"f.{c}") for c in slot]
    on += [F.col("f.valid_at") <= probes[at], probes[at] < F.coalesce(F.col("f.invalid_at"), F.lit(float("inf")))]
    return probes.join(f, on, "left")


def slot_heads(facts: DataFrame) -> DataFrame:
    """One fact per single-valued slot: user-made first, then latest valid, created, largest id.
    A fact of an accumulating predicate is a slot of its own, so one window serves all and the facts are made once."""
    own = F.when(~T.single_valued(F.col("predicate")), F.col("fact_id"))
    slot = [F.col("user_id"), F.lower("subject"), F.lower("predicate"), own]
    order = [F.desc(F.col("source").eqNullSafe("user")), F.desc("valid_at"), F.desc("created_at"), F.desc("fact_id")]
    return facts.withColumn("_rn", F.row_number().over(W.partitionBy(*slot).orderBy(*order))).where("_rn = 1").drop("_rn")


def current_state(facts: DataFrame, limit: int = 18) -> DataFrame:
    """Latest value per single-valued slot and all others; no priority of user-made ones, and the first of equals."""
    own = F.when(~T.single_valued(F.col("predicate")), F.col("fact_id"))
    w = W.partitionBy(F.lower("subject"), F.lower("predicate"), own).orderBy(F.desc("valid_at"), "seq")
    both = facts.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
    return both.orderBy(F.lower("subject"), F.lower("predicate"), F.lower("object"), F.desc("valid_at")).limit(limit)


def slot_history(facts: DataFrame, user: str, subject: str, predicate: str) -> DataFrame:
    """Every fact of one slot, oldest first; the subject in any case, the predicate as it is."""
    own = (F.col("user_id") == user) & (F.lower("subject") == subject.lower()) & (F.col("predicate") == predicate)
    return facts.where(own).orderBy("valid_at", "seq")


def replacements(facts: DataFrame) -> DataFrame:
    """Superseded facts beside what replaced them: the latest of several replacements."""
    n, o = facts.alias("n"), facts.alias("o")
    newest = n.where(F.col("n.supersedes").isNotNull()).groupBy(F.col("n.supersedes").alias("_old")).agg(
        F.max_by(F.struct("n.*"), F.struct("n.valid_at", "n.created_at", "n.fact_id")).alias("newer")
    )
    return o.join(newest, F.col("o.fact_id") == F.col("_old")).select(F.struct("o.*").alias("older"), "newer")


def slot_chains(facts: DataFrame, slot: list[str], at: str = "valid_at", seq: str = "seq") -> DataFrame:
    """(root, fact_id, depth) of facts that ``supersede`` linked: each slot is one chain in order, of any length."""
    w = W.partitionBy(*slot).orderBy(at, seq)
    return facts.select(F.first("fact_id").over(w).alias("root"), "fact_id", (F.row_number().over(w) - 1).alias("depth"))


def chain_roles(facts: DataFrame, t: float) -> DataFrame:
    """current, replacement (live and replacing something), superseded (it has a replacement) or past."""
    replaced = facts.where("supersedes IS NOT NULL").select(F.col("supersedes").alias("fact_id")).distinct().withColumn("_r", F.lit(True))
    live = live_at(t)
    role = F.when(live & F.col("supersedes").isNotNull(), "replacement").when(live, "current").when(F.col("_r"), "superseded").otherwise("past")
    return facts.join(replaced, "fact_id", "left").withColumn("role", role).drop("_r")


def gaps(rows: DataFrame, key: list[str], at: str, seq: str) -> DataFrame:
    """Seconds since the row before, per key."""
    w = W.partitionBy(*key).orderBy(at, seq)
    return rows.withColumn("gap_s", F.col(at) - F.lag(at).over(w))


def quiet_sessions(rows: DataFrame, key: list[str], at: str, seq: str, quiet: float = 900.0) -> DataFrame:
    """Rows with session_no: a new session begins after ``quiet`` seconds of silence."""
    w = W.partitionBy(*key).orderBy(at, seq)
    new = (F.col(at) - F.lag(at).over(w) >= quiet).cast("long")
    return rows.withColumn("_new", F.coalesce(new, F.lit(0))).withColumn("session_no", F.sum("_new").over(w)).drop("_new")


def duration_evidence(episodes: DataFrame, anchors: list[str], action: str = r"(?i)\b(start|began|begin|finish|complet|end)") -> DataFrame:
    """First sentence of each episode that names an anchor and an action, by anchor and time."""
    said = episodes.select("episode_id", "event_time", F.posexplode(T.sentences(F.col("content"))).alias("pos", "sentence"))
    hit = said.where(F.col("sentence").rlike(action)).withColumn("anchor", F.explode(T.words(*anchors)))
    hit = hit.where(F.contains(F.lower("sentence"), F.lower("anchor")))
    first = W.partitionBy("anchor", "episode_id").orderBy("pos")
    return hit.withColumn("_rn", F.row_number().over(first)).where("_rn = 1").select("anchor", "event_time", "episode_id", "sentence")
