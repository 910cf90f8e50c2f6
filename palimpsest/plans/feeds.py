"""Queries on feeds: orders as session logs of a size and an age, events as claims."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from palimpsest.catalog import query
from palimpsest.functions import text as T
from palimpsest.plans.common import FACTS_SQL
from palimpsest.session import scratch, table
from palimpsest.streaming import feeds as Feeds
from palimpsest.streaming import folds as Folds

NOW = 915148800.0  # 1999-01-01
SEEN_SQL = "sn AS (SELECT o_orderkey AS path, CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE CAST(floor(o_totalprice) AS BIGINT) END AS size FROM orders WHERE o_orderkey % 3 <> 1)"
CLAIMS_SQL = "cl AS (SELECT user_id AS path, CAST(max_by(event_id, (ts, event_id)) AS BIGINT) AS size FROM events WHERE event_type IN ('view', 'click') GROUP BY 1)"


def _files(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("path"), F.floor("o_totalprice").alias("length"), T.seconds_of("o_orderdate").alias("modified"))


def _seen(spark, sf_dir):
    f = _files(spark, sf_dir).where("path % 3 <> 1")
    return f.select("path", F.when(F.col("path") % 5 == 0, 1).otherwise(F.col("length")).cast("long").alias("size"))


@query(
    "feeds_due",
    f"WITH {SEEN_SQL}, f AS (SELECT o_orderkey AS path, CAST(floor(o_totalprice) AS BIGINT) AS length, epoch_us(o_orderdate) / 1000000.0 AS modified FROM orders) "
    f"SELECT path, length FROM f WHERE {NOW} - modified >= 900 AND (path, length) NOT IN (SELECT (path, size) FROM sn) AND NOT (path % 7 = 0)",
)
def feeds_due(spark, sf_dir):
    """Every seventh log is known to be too large for a request."""
    f = _files(spark, sf_dir)
    big = f.where("path % 7 = 0").select("path", F.col("length").alias("size"), F.lit(Feeds.MOST_BYTES).alias("most_bytes"))
    return Feeds.due(f, _seen(spark, sf_dir), NOW, big).select("path", "length")


@query("claims_folded", f"WITH {SEEN_SQL}, {CLAIMS_SQL} SELECT path, size FROM cl UNION ALL SELECT path, size FROM sn WHERE path NOT IN (SELECT path FROM cl)")
def claims_folded(spark, sf_dir):
    """Views name no target, clicks this one, and other events another."""
    e = table(spark, sf_dir, "events")
    target = F.when(F.col("event_type") == "click", "here").when(F.col("event_type") != "view", "elsewhere")
    claims = e.select(F.col("user_id").alias("path"), F.col("event_id").cast("long").alias("size"), target.alias("target"), F.struct("ts", "event_id").alias("seq"))
    return Feeds.fold_claims(_seen(spark, sf_dir), claims, "here")


@query(
    "feed_run",
    f"""WITH {SEEN_SQL}, b AS (SELECT o_orderkey AS path, CAST(floor(o_totalprice) AS BIGINT) AS length FROM orders WHERE o_orderkey % 3 = 1 ORDER BY o_orderdate, path LIMIT 25),
r AS (SELECT path, path % 4 <> 0 AS ok, length, CASE WHEN path % 4 <> 0 THEN 0 ELSE CASE WHEN path % 8 = 0 THEN 3 ELSE 1 END END AS failures FROM b)
SELECT path, CASE WHEN ok OR failures >= 3 THEN length END AS size, CAST(failures AS INTEGER) AS failures FROM r""",
)
def feed_run(spark, sf_dir):
    """A run over the oldest logs that are new; each fourth fails, each eighth for the third time."""
    f = _files(spark, sf_dir).where("path % 3 = 1")
    ledger = f.where("path % 8 = 0").select("path", F.lit(None).cast("long").alias("size"), F.lit(2).alias("failures"))
    after, _ = Feeds.feed(f, ledger, lambda batch: batch.select("path", (F.col("path") % 4 != 0).alias("ok")))
    batch = f.orderBy("modified", "path").limit(25).select("path")
    return after.join(batch, "path", "left_semi")


@query(
    "fold_incremental",
    f"WITH {FACTS_SQL} SELECT CAST(event_id AS VARCHAR) AS fact_id, ts_s AS valid_at, invalid_at, invalid_at AS expired_at, CAST(supersedes AS VARCHAR) AS supersedes FROM facts",
)
def fold_incremental(spark, sf_dir):
    """Events as facts that arrive in four batches by time, each folded into the state that the ones before have left."""
    e = table(spark, sf_dir, "events").withColumn("valid_at", T.seconds_of("ts"))
    none = F.lit(None)
    facts = e.select(
        F.col("event_id").cast("string").alias("fact_id"), F.col("user_id").cast("string").alias("user_id"), F.lit("user").alias("subject"), F.col("event_type").alias("predicate"),
        F.concat(F.lit("v"), F.col("value").cast("string")).alias("object"), "valid_at", F.col("valid_at").alias("created_at"), none.cast("double").alias("invalid_at"), none.cast("double").alias("expired_at"),
        none.cast("string").alias("supersedes"), F.lit("extracted").alias("source"), F.lit(1.0).alias("salience"), F.array().cast("array<string>").alias("provenance"), F.col("event_id").cast("long").alias("seq"),
    )
    span = facts.agg(F.min("valid_at").alias("a"), F.max("valid_at").alias("z")).first()
    cuts = [float("-inf"), *[span["a"] + (span["z"] - span["a"]) * i / 4 for i in (1, 2, 3)], float("inf")] if span["a"] is not None else []
    stream = Folds.FoldedFacts(spark, f"{scratch(spark)}/folds-{uuid.uuid4().hex}")
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        stream.add(facts.where((F.col("valid_at") > lo) & (F.col("valid_at") <= hi)))
    return stream.facts().select("fact_id", "valid_at", "invalid_at", "expired_at", "supersedes")
