"""Streams against their batch forms."""

from pyspark.sql import functions as F

from palimpsest.operators.extract import extract
from palimpsest.operators.reconcile import reconcile
from palimpsest.plans.imports import _episodes
from palimpsest.streaming import episodes as S
from palimpsest.streaming import feeds as Feeds


def test_stream_equals_batch(spark, tmp_path):
    eps = _episodes(spark)
    for i in range(5):  # one file a batch, in time order
        eps.where(F.col("seq").between(2 * i, 2 * i + 1)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    at = {"n": -1}

    def read():
        return S.empty_state(spark) if at["n"] < 0 else tuple(spark.read.parquet(f"{tmp_path}/{t}/{at['n']}") for t in ("facts", "names"))

    def write(state, n):
        for df, t in zip(state, ("facts", "names"), strict=True):
            df.write.mode("overwrite").parquet(f"{tmp_path}/{t}/{n}")
        at["n"] = n

    src = spark.readStream.schema(eps.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    S.run_consolidation(src, read, write, f"{tmp_path}/cp").awaitTermination()
    cols = ["subject", "predicate", "object", "invalid_at", "expired_at"]
    say = lambda df: sorted(map(str, df.select(*cols).collect()))
    facts, names = read()
    assert say(facts) == say(reconcile(extract(eps))) and names.collect() == [("u1", "Wei")]


def _stream(spark, tmp_path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/s")
    return spark.readStream.schema(spark.read.parquet(f"{tmp_path}/s").schema).parquet(f"{tmp_path}/s")


def _run(spark, df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name).collect()


def test_dedup_and_sessions(spark, tmp_path):
    from datetime import datetime, timedelta

    t0 = datetime(2024, 1, 1)
    rows = [(1, t0, "a"), (1, t0 + timedelta(minutes=5), "a"), (1, t0 + timedelta(minutes=60), "b"), (2, t0, "c"), (9, t0 + timedelta(days=3), "z")]
    src = _stream(spark, tmp_path, rows, "user_id long, ts timestamp, fingerprint string")
    assert len(_run(spark, S.dedup_stream(src), "dedup")) == 4
    got = {(r["user_id"], r["n"]) for r in _run(spark, S.quiet_session_counts(src), "quiet")}
    assert {(1, 2), (1, 1), (2, 1)} <= got


def test_windowed_counts(spark, tmp_path):
    from datetime import datetime, timedelta

    t0 = datetime(2024, 1, 1)
    rows = [(t0 + timedelta(hours=h), "view") for h in (0, 1, 30, 200)]
    src = _stream(spark, tmp_path, rows, "ts timestamp, event_type string")
    got = sorted((r["start"], r["n"]) for r in _run(spark, S.windowed_counts(src), "windows"))
    assert got[:2] == [(t0, 2), (t0 + timedelta(days=1), 1)]


def test_request_chunks(spark):
    rows = [("f", i, i, b) for i, b in enumerate([40, 40, 40, 500, 90, 10])]
    out = {r["id"]: r["chunk"] for r in Feeds.request_chunks(spark.createDataFrame(rows, "feed string, id long, seq long, bytes long"), 100).collect()}
    assert out[3] == -1 and sorted(set(out.values()) - {-1}) == list(range(max(out.values()) + 1))
    size = dict(zip(range(6), [40, 40, 40, 500, 90, 10], strict=True))
    for c in set(out.values()) - {-1}:
        own = [i for i, x in out.items() if x == c]
        assert sum(size[i] for i in own) <= 100
    assert [out[i] for i in (0, 1, 2, 4, 5)] == sorted(out[i] for i in (0, 1, 2, 4, 5))


def test_landed_episodes_stay_known(spark, tmp_path):
    from datetime import datetime, timedelta

    t0, kind = datetime(2024, 1, 1), "episode_id string, ts timestamp, fingerprint string"
    done = spark.createDataFrame([("a", t0, "f1")], kind)
    done.write.parquet(f"{tmp_path}/landed/first")
    for name, rows in (("one", [("b", t0, "f1"), ("c", t0, "f2"), ("d", t0 + timedelta(days=9), "f2")]), ("two", [("e", t0 + timedelta(days=30), "f2"), ("f", t0, "f3")])):
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        src = spark.readStream.schema(done.schema).parquet(f"{tmp_path}/in")
        landed = lambda: spark.read.schema(done.schema).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/landed")
        Feeds.dedup_landed(src, landed, lambda df, n: df.write.mode("overwrite").parquet(f"{tmp_path}/landed/{n}"), f"{tmp_path}/cp").awaitTermination()
    assert sorted(r["episode_id"] for r in landed().collect()) == ["a", "c", "f"]


def test_feeding_until_given_up(spark):
    files = spark.createDataFrame([(f"p{i}", 10 + i, float(i)) for i in range(4)], "path string, length long, modified double")
    ledger = spark.createDataFrame([], "path string, size long, failures int")
    say = lambda batch: batch.select("path", (F.col("path") != "p1").alias("ok"))
    for n, want in enumerate(({"fed": 3, "failed": 1, "given_up": 0}, {"fed": 0, "failed": 1, "given_up": 0}, {"fed": 0, "failed": 1, "given_up": 1}, {"fed": 0, "failed": 0, "given_up": 0})):
        seen = ledger.where("size IS NOT NULL")
        ledger, counts = Feeds.feed(Feeds.due(files, seen, 10_000.0), ledger, say)
        assert counts == want, n
        ledger = spark.createDataFrame(ledger.collect(), "path string, size long, failures int")
    assert Feeds.due(files, ledger.where("size IS NOT NULL"), 10_000.0).isEmpty() and Feeds.due(files, ledger.limit(0), 900.0).count() == 1


def test_calls_meet_their_results(spark, tmp_path):
    from datetime import datetime, timedelta

    t0 = datetime(2024, 1, 1)
    for name, rows in (("calls", [("a", t0), ("b", t0)]), ("results", [("a", t0 + timedelta(minutes=30)), ("b", t0 + timedelta(hours=3))])):
        spark.createDataFrame(rows, "call_id string, ts timestamp").coalesce(1).write.parquet(f"{tmp_path}/{name}")
    c, r = (spark.readStream.schema("call_id string, ts timestamp").parquet(f"{tmp_path}/{n}") for n in ("calls", "results"))
    got = S.call_results(c, r).select(F.col("c.call_id").alias("id"))
    assert [x["id"] for x in _run(spark, got, "met")] == ["a"]


def test_working_memory_expires(spark, tmp_path):
    from datetime import datetime, timedelta

    t0, kind = datetime(2024, 1, 1), "key string, ts timestamp, content string, ttl_seconds double"
    for rows in ([("a", t0, "old", 60.0), ("a", t0 + timedelta(seconds=30), "new", 60.0)], [("b", t0 + timedelta(hours=2), "late", 60.0)], [("c", t0 + timedelta(hours=4), "later", 60.0)]):
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(f"{tmp_path}/w")
    src = spark.readStream.schema(spark.read.parquet(f"{tmp_path}/w").schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/w")
    got = [(r["key"], r["content"], r["status"]) for r in _run(spark, S.working_memory(src), "held")]
    assert ("a", "new", "live") in got and ("a", "new", "expired") in got and ("c", "later", "expired") not in got


def test_calls_without_a_result_come_out(spark, tmp_path):
    from datetime import datetime, timedelta

    t0 = datetime(2024, 1, 1)
    late = t0 + timedelta(hours=10)
    for name, rows in (("calls", [("a", t0), ("b", t0), ("z", late)]), ("results", [("a", t0 + timedelta(minutes=30)), ("b", t0 + timedelta(hours=3)), ("y", late)])):
        spark.createDataFrame(rows, "call_id string, ts timestamp").coalesce(1).write.parquet(f"{tmp_path}/{name}")
    c, r = (spark.readStream.schema("call_id string, ts timestamp").parquet(f"{tmp_path}/{n}") for n in ("calls", "results"))
    got = S.call_results(c, r).select(F.col("c.call_id").alias("id"), F.col("r.call_id").alias("result"))
    assert sorted(map(tuple, _run(spark, got, "met_or_not")), key=str) == [("a", "a"), ("b", None)]


def test_working_memory_holds_many_items(spark, tmp_path):
    from datetime import datetime, timedelta

    t0, kind = datetime(2024, 1, 1), "key string, ts timestamp, content string, ttl_seconds double, item_id string, op string"
    at = lambda s: t0 + timedelta(seconds=s)
    batches = [
        [("a", at(0), "one", 60.0, "1", "add"), ("a", at(1), "two", 7200.0, "2", "add"), ("a", at(2), "three", None, "3", None), ("a", at(3), "four", 60.0, "4", "add"), ("b", at(3), "other", 60.0, "1", "add")],
        [("a", at(10), None, None, "4", "consume"), ("a", at(11), None, None, "9", "consume"), ("c", at(600), "late", 60.0, "1", "add")],
        [("a", at(700), None, None, None, "clear"), ("c", at(9000), "later", 60.0, "2", "add")],
        [("d", at(20000), "last", 60.0, "1", "add")],
    ]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, kind).coalesce(1).write.parquet(f"{tmp_path}/w/{i}")
    src = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/w")
    got = [(r["key"], r["item_id"], r["status"]) for r in _run(spark, S.working_memory(src), "held_items")]
    assert sorted(got) == sorted([
        ("a", "1", "live"), ("a", "2", "live"), ("a", "3", "live"), ("a", "4", "live"), ("b", "1", "live"), ("a", "4", "consumed"), ("c", "1", "live"),
        ("a", "1", "expired"), ("b", "1", "expired"), ("a", "2", "cleared"), ("a", "3", "cleared"), ("c", "2", "live"), ("c", "1", "expired"), ("d", "1", "live"), ("c", "2", "expired"),
    ])
