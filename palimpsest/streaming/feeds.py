"""Feeding session logs: what is due, whose claims count, and a run that marks a log as seen only when all of it went well.

The ledger is a table (path, size, failures). A claim is a line of an append-only log
(path, size, target, seq), written by whoever fed a log out of turn.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# fixed values: seconds of quiet before a log is read, bytes of a request, logs of a run, failures before one is given up
QUIET_S, MOST_BYTES, LIMIT, GIVE_UP = 900, 1_500_000, 25, 3


def fold_claims(seen: DataFrame, claims: DataFrame, target: str | None = None) -> DataFrame:
    """``seen`` (path, size) with the last claim of each path in its place; claims on another target do not count."""
    own = claims if target is None else claims.where(F.coalesce("target", F.lit("")).isin("", target))
    last = own.where("path IS NOT NULL AND size IS NOT NULL").groupBy("path").agg(F.max_by("size", "seq").alias("size"))
    return seen.select("path", "size").join(last.select("path"), "path", "left_anti").unionByName(last)


def due(files: DataFrame, seen: DataFrame, now: float, oversized: DataFrame | None = None, quiet_s: float = QUIET_S, most_bytes: int = MOST_BYTES) -> DataFrame:
    """files(path, length, modified) that have changed since they were seen(path, size) and are no longer written to.
    oversized(path, size, most_bytes) has those that did not fit; a larger log or limit puts them back."""
    still = files.where(F.lit(now) - F.col("modified") >= quiet_s)
    out = still.join(seen.select("path", F.col("size").alias("length")), ["path", "length"], "left_anti")
    if oversized is not None:
        known = oversized.where(F.col("most_bytes") == most_bytes).select("path", F.col("size").alias("length"))
        out = out.join(known, ["path", "length"], "left_anti")
    return out


def feed(todo: DataFrame, ledger: DataFrame, ingest: Callable[[DataFrame], DataFrame], limit: int = LIMIT) -> tuple[DataFrame, dict]:
    """The ledger after a run over the ``limit`` oldest of todo(path, length, modified), and its counts.

    ``ingest(batch)`` imports and closes those logs and says how it went: (path, ok). Only what went
    well is seen; a log that has failed GIVE_UP times is seen as well, so that it does not take a place
    in every run. Running a batch again changes nothing that went well.
    """
    batch = todo.orderBy("modified", "path").limit(limit)
    went = ingest(batch).groupBy("path").agg(F.min("ok").alias("ok"))
    tried = batch.join(went, "path", "left").withColumn("ok", F.coalesce("ok", F.lit(False)))
    both = tried.join(ledger.select("path", F.col("failures").alias("_f")), "path", "left")
    failures = F.when(F.col("ok"), 0).otherwise(F.coalesce("_f", F.lit(0)) + 1)
    marked = both.withColumn("failures", failures)
    size = F.when(F.col("ok") | (F.col("failures") >= GIVE_UP), F.col("length"))
    new = marked.select("path", size.alias("size"), "failures", "ok")
    counts = new.agg(F.count_if("ok").alias("fed"), F.count_if(~F.col("ok")).alias("failed"), F.count_if(~F.col("ok") & F.col("size").isNotNull()).alias("given_up")).first()
    rest = ledger.join(new.select("path"), "path", "left_anti").select("path", "size", "failures")
    return rest.unionByName(new.select("path", "size", "failures")), counts.asDict()


def dedup_landed(episodes: DataFrame, landed: Callable[[], DataFrame], land: Callable[[DataFrame, int], None], checkpoint: str):
    """A stream of episodes without those that ever landed, restarts included: each batch is held against the landed
    fingerprints themselves, not against a state that forgets. ``land(rows, batch_id)`` writes by batch id."""

    def step(batch: DataFrame, batch_id: int) -> None:
        one = batch.groupBy("fingerprint").agg(*[F.min_by(c, F.struct("ts", "episode_id")).alias(c) for c in batch.columns if c != "fingerprint"])
        land(one.join(landed().select("fingerprint"), "fingerprint", "left_anti").select(*batch.columns), batch_id)

    return episodes.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def request_chunks(rows: DataFrame, most: int, feed_col: str = "feed") -> DataFrame:
    """(feed, id, chunk): rows(feed, id, seq, bytes) in requests of at most ``most`` bytes; what never fits has chunk -1.

    A prefix sum deals rows to stretches of ``most`` bytes; the one row that crosses the edge of a
    stretch is a request of its own, so no request is too large. The sum is a window over sizes.
    """
    from pyspark.sql import Window as W

    fits = F.col("bytes") <= most
    w = W.partitionBy(feed_col).orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.when(fits, F.col("bytes")).otherwise(0)).over(w), F.lit(0))
    at = rows.withColumn("_before", before).withColumn("_stretch", F.floor(F.col("_before") / most))
    crosses = F.floor((F.col("_before") + F.col("bytes") - 1) / most) > F.col("_stretch")
    slot = 2 * F.col("_stretch") + F.when(crosses, 1).otherwise(0)
    dense = at.withColumn("_slot", F.when(fits, slot))
    numbers = dense.where("_slot IS NOT NULL").select(feed_col, "_slot").distinct()
    numbers = numbers.withColumn("chunk", F.row_number().over(W.partitionBy(feed_col).orderBy("_slot")) - 1)
    out = dense.join(numbers, [feed_col, "_slot"], "left")
    return out.select(feed_col, "id", F.coalesce("chunk", F.lit(-1)).cast("int").alias("chunk"))


def claims_of(parts: list[DataFrame]) -> DataFrame:
    """Claim logs one after the other: later logs count as later."""
    return reduce(DataFrame.unionByName, [p.withColumn("seq", F.struct(F.lit(i).alias("log"), F.col("seq").alias("line"))) for i, p in enumerate(parts)])
