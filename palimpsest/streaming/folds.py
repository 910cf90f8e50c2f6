"""The conflict fold as a stream with keyed state: a batch touches what its facts can touch.

State belongs to (user, subject) and lies under the headings of the fold: a new fact reads the
live facts of its slot and object, of its words and of the other side of a preference, and no
others. The live facts of a key that has few are one value, read and written once a batch. What has ended leaves the state; the rows that a batch changes go out, and the newest
row of a fact counts.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from palimpsest.operators.reconcile import FACT, Fold, Shelf, _end
from palimpsest.session import ROCKS
from palimpsest.sources.store import _fs

FEW = 64  # live facts of a key that are one value in the state
NAMES = [c.split()[0] for c in FACT.split(", ")]


class StateFold(Fold):
    """A fold on kept facts: a few that are all there from the start (``few``), or many, whose shelves are read from the
    state when a rule first looks at them."""

    def __init__(self, facts, shelves, first: int, few: list | None = None, **rules):
        super().__init__(**rules)
        self.held, self.lists, self.next = facts, shelves, first
        self.known: dict[int, str] = {}
        self.few = few is not None
        for no, f in few or []:
            self.known[no] = json.dumps(f)
            self._file(no, f)

    def _shelf(self, heading: tuple) -> Shelf:
        if self.few:
            return super()._shelf(heading)
        if heading not in self.shelves:
            self.shelves[heading] = Shelf()
            name = (json.dumps(heading),)
            for no in self.lists.getValue(name)[0] if self.lists.containsKey(name) else []:
                if no not in self.by_no:
                    self.known[no] = self.held.getValue((no,))[0]
                    self.by_no[no] = json.loads(self.known[no])
                    self.headings[no] = self._headings(self.by_no[no])
                self.shelves[heading].put(no, self.by_no[no])
        return self.shelves[heading]

    def changed(self) -> dict[int, dict]:
        return {no: f for no, f in self.by_no.items() if self.known.get(no) != json.dumps(f)}

    def live(self) -> list:
        """What is in memory and has not ended."""
        return [[no, f] for no, f in self.by_no.items() if _end(f) == float("inf")]

    def settle(self) -> None:
        """Writes what has changed to the maps, without what has ended; facts that were few until now all go there."""
        changed = dict(self.live()) if self.few else self.changed()
        touched = {h for no in changed for h in self.headings[no]}
        for no, f in changed.items():
            if _end(f) == float("inf"):
                self.held.updateValue((no,), (json.dumps(f),))
            elif no in self.known:
                self.held.removeKey((no,))
        for h in touched:
            live = sorted(self._shelf(h).open)
            if live:
                self.lists.updateValue((json.dumps(h),), (live,))
            elif self.lists.containsKey((json.dumps(h),)):
                self.lists.removeKey((json.dumps(h),))


class _Keep(StatefulProcessor):
    def __init__(self, rules: dict):
        self.rules = rules

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.few = handle.getValueState("few", "no long, facts string")  # facts is null once they lie in the maps
        self.facts = handle.getMapState("facts", "no long", "fact string")
        self.lists = handle.getMapState("headings", "heading string", "numbers array<long>")

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803  the names that Spark calls
        late = lambda x: (x is None, x)
        new = [{c: None if r[c] != r[c] else r[c] for c in NAMES} for r in rows]
        first, few = self.few.get() or (0, "[]")
        fold = StateFold(self.facts, self.lists, first, None if few is None else json.loads(few), **self.rules)
        for r in sorted(new, key=lambda f: [late(f[c]) for c in ("valid_at", "created_at", "seq")]):
            fold.take(r)
        kept = fold.live() if fold.few else None
        if kept is None or len(kept) > FEW:
            kept = fold.settle()
        self.few.update((fold.next, None if kept is None else json.dumps(kept)))
        for f in fold.changed().values():
            yield Row(**{c: f[c] for c in NAMES})

    def close(self) -> None:
        pass


def fold_stream(facts: DataFrame, **rules) -> DataFrame:
    """A stream of new FACT rows as a stream of changed ones: kept facts, and known ones that they end. Batches come in
    the order of created_at; within one, facts are taken by valid time. The session needs the RocksDB state store."""
    keyed = facts.select(*NAMES).withColumn("_key", F.lower(F.trim("subject")))
    return keyed.groupBy("user_id", "_key").transformWithState(_Keep(rules), FACT, "Update", "None")


class FoldedFacts:
    """Facts folded batch after batch, kept under ``root``: what arrives, the state, and the changed rows of each batch.
    A batch that is run again writes the same folder, so each counts once."""

    def __init__(self, spark: SparkSession, root: str, **rules):
        self.spark, self.root, self.rules = spark, root, rules

    def add(self, facts: DataFrame) -> None:
        facts.select(*NAMES).write.mode("append").parquet(f"{self.root}/in")
        self.run()

    def run(self) -> None:
        """Folds in what has arrived since."""
        before = self.spark.conf.get("spark.sql.streaming.stateStore.providerClass")
        self.spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
        try:
            new = self.spark.readStream.schema(FACT).parquet(f"{self.root}/in")
            out = self.root

            def put(changed: DataFrame, batch: int) -> None:
                changed.withColumn("batch", F.lit(batch)).write.mode("overwrite").parquet(f"{out}/out/b{batch}")

            write = fold_stream(new, **self.rules).writeStream.outputMode("update").foreachBatch(put)
            write.option("checkpointLocation", f"{self.root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
        finally:
            self.spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)

    def facts(self) -> DataFrame:
        """The newest row of each fact."""
        _, fs, path = _fs(self.spark, f"{self.root}/out")
        if not fs.exists(path):
            return self.spark.createDataFrame([], FACT)
        rows = self.spark.read.schema(f"{FACT}, batch int").parquet(f"{self.root}/out/*")
        newest = rows.groupBy("fact_id").agg(F.max_by(F.struct(*NAMES), "batch").alias("f"))
        return newest.select("f.*")
