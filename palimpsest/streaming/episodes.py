"""Streams of episodes: consolidation, deduplication, quiet-gap sessions and expiring working memory."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from palimpsest.operators.extract import extract, learn_names
from palimpsest.operators.reconcile import FACT, reconcile


State = tuple[DataFrame, DataFrame]  # facts, and (user_id, known_name)


def consolidate_batch(batch: DataFrame, state: State) -> State:
    """State after a batch of episodes: known facts and new ones folded together by (user, subject).

    Known facts come first in their order, so that folding in parts equals folding at once
    when batches arrive in time order.
    """
    facts, names = state
    return reconcile(facts.unionByName(extract(batch, names))), learn_names(batch, names)


def run_consolidation(episodes: DataFrame, read_state: Callable[[], State], write_state: Callable[[State, int], None], checkpoint: str):
    """Each micro-batch consolidates what arrived; the checkpoint stands for the pending flag. A batch
    that is run again starts from the state before it, so writing by batch id makes it exactly-once."""

    def step(batch: DataFrame, batch_id: int) -> None:
        write_state(consolidate_batch(batch, read_state()), batch_id)

    return episodes.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def dedup_stream(episodes: DataFrame, late: str = "1 day") -> DataFrame:
    """Each fingerprint once within the watermark."""
    return episodes.withWatermark("ts", late).dropDuplicatesWithinWatermark(["fingerprint"])


def quiet_session_counts(events: DataFrame, quiet: str = "15 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions that end after ``quiet``: (user_id, start, end, n)."""
    g = events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", quiet)).agg(F.count(F.lit(1)).alias("n"))
    return g.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def windowed_counts(events: DataFrame, size: str = "1 day", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    g = events.withWatermark("ts", late).groupBy(w, "event_type").agg(F.count(F.lit(1)).alias("n"))
    return g.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "event_type", "n")


def call_results(calls: DataFrame, results: DataFrame, within: str = "1 hour") -> DataFrame:
    """Tool calls beside their results, which come within an interval. A call without one comes out with nulls, once the
    watermark says that none can come any more."""
    c = calls.withWatermark("ts", within).alias("c")
    r = results.withWatermark("ts", within).alias("r")
    near = (F.col("r.ts") >= F.col("c.ts")) & (F.col("r.ts") <= F.col("c.ts") + F.expr(f"interval {within}"))
    return c.join(r, (F.col("c.call_id") == F.col("r.call_id")) & near, "leftOuter")


class _Items(StatefulProcessor):
    """The items of one key, each with a timer of its own."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.items = handle.getMapState("items", "item_id string", "content string, until long")

    def _drop(self, key, ids, status: str) -> list[tuple]:
        out = [(key[0], i, self.items.getValue((i,))[0], status) for i in ids]
        for i in ids:
            self.items.removeKey((i,))
        return out

    def _due(self, now: int) -> list[str]:
        return sorted(k[0] for k, v in self.items.iterator() if v[1] is not None and v[1] <= now)

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803  the names that Spark calls
        out = []
        for r in pd.concat(list(rows)).sort_values(["ts", "item_id"], kind="stable").to_dict("records"):
            if r["op"] in ("clear", "consume"):
                out += self._drop(key, self._due(int(r["ts"].timestamp() * 1000)), "expired")  # before its timer comes
                ids = sorted(k[0] for k in self.items.keys())
                out += self._drop(key, ids if r["op"] == "clear" else [i for i in ids if i == r["item_id"]], {"clear": "cleared", "consume": "consumed"}[r["op"]])
            else:
                until = None if pd.isna(r["ttl_seconds"]) else int(r["ts"].timestamp() * 1000 + r["ttl_seconds"] * 1000)
                self.items.updateValue((r["item_id"],), (r["content"], until))
                if until is not None:
                    self.handle.registerTimer(until)
                out.append((key[0], r["item_id"], r["content"], "live"))
        yield pd.DataFrame(out, columns=HELD)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802, N803  the names that Spark calls
        yield pd.DataFrame(self._drop(key, self._due(expiredTimerInfo.getExpiryTimeInMs()), "expired"), columns=HELD)

    def close(self) -> None:
        pass


HELD = ["key", "item_id", "content", "status"]


def working_memory(items: DataFrame, late: str = "0 seconds") -> DataFrame:
    """items(key, ts, content, ttl_seconds) as (key, item_id, content, status), a row a change: live, consumed, cleared
    or expired.

    A key holds any number of items. Each is forgotten at its own time, once the watermark has passed it; without a time to
    live it stays. ``op`` consume takes an item away by its ``item_id``, and clear takes all of the key. Both
    columns may be missing: an item is then known by its time and content. The session keeps its state in RocksDB.
    """
    own = F.sha2(F.concat_ws("\x1f", F.col("ts").cast("string"), "content"), 256)
    more = {"item_id": own, "op": F.lit("add")}
    items = items.withColumns({c: v for c, v in more.items() if c not in items.columns})
    keyed = items.select("key", "ts", "content", "ttl_seconds", F.coalesce("item_id", own).alias("item_id"), F.coalesce("op", F.lit("add")).alias("op"))
    keyed = keyed.withWatermark("ts", late).groupBy("key")
    return keyed.transformWithStateInPandas(_Items(), "key string, item_id string, content string, status string", "Append", "EventTime")


def empty_state(spark: SparkSession) -> State:
    return spark.createDataFrame([], FACT), spark.createDataFrame([], "user_id string, known_name string")
