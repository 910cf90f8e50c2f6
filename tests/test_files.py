"""Readers of files and benchmark sets, and the small views that no query shows."""

import json

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import health as Health
from palimpsest.operators import profile as Profile
from palimpsest.operators import temporal as Time
from palimpsest.sources import conversations as Conv
from palimpsest.sources import files as Files


def test_find_sessions(spark, tmp_path):
    for name, size in (("a/x.jsonl", 3000), ("a/agent-y.jsonl", 3000), ("b/z.jsonl", 100), ("b/w.jsonl", 5000), ("b/w.txt", 5000)):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("x" * size)
    got = {r["path"].split("/")[-1]: r["length"] for r in Files.find_sessions(spark, f"file://{tmp_path}").collect()}
    assert got == {"x.jsonl": 3000, "w.jsonl": 5000}
    assert Files.find_sessions(spark, f"file://{tmp_path}", limit=1).count() == 1
    assert Files.find_sessions(spark, f"file://{tmp_path}", since="2999-01-01T00:00:00").count() == 0


def test_documents_and_captions(spark, tmp_path):
    (tmp_path / "a.txt").write_text(" hello ")
    (tmp_path / "b.pdf").write_bytes(b"%PDF-1.4 x")
    (tmp_path / "c.png").write_bytes(b"\x89PNG\r\n\x1a\nxx")
    got = {r["path"].split("/")[-1]: (r["kind"], r["text"]) for r in Files.documents(spark, f"file://{tmp_path}").collect()}
    assert got == {"a.txt": ("text", "hello"), "b.pdf": ("pdf", None), "c.png": ("image", None)}
    images = spark.createDataFrame([("d/c.png", bytearray(b"xyz"))], "path string, content binary")
    assert Files.caption(images).first()["caption"] == "[image: c.png]"
    assert Files.caption(images, lambda data: f"{len(data)} bytes").first()["caption"] == "3 bytes"


def test_benchmark_sets(spark, tmp_path):
    item = {"question_id": "q", "question": "?", "answer": "!", "haystack_session_ids": ["s1", "s2"], "haystack_dates": ["2023/05/20 (Sat) 02:21", "2023/05/21 (Sun) 10:00"], "haystack_sessions": [[{"role": "user", "content": "a"}], [{"role": "user", "content": "b"}, {"role": "assistant", "content": "c"}]]}
    (tmp_path / "long.json").write_text(json.dumps([item]))
    got = [(r["session_id"], r["pos"], r["content"]) for r in Files.long_memory_items(spark, f"file://{tmp_path}/long.json").orderBy("session_id", "pos").collect()]
    assert got == [("s1", 0, "a"), ("s2", 0, "b"), ("s2", 1, "c")]
    turns = {"session_2": json.dumps([{"speaker": "B", "text": "late"}]), "session_10": json.dumps([{"speaker": "C", "text": "last", "blip_caption": "a cat"}]), "session_1": json.dumps([{"speaker": "A", "text": "first"}]), "session_1_date_time": "x"}
    got = [(r["n"], r["text"]) for r in Files.numbered_sessions(spark.createDataFrame([(1, turns)], "id int, conversation map<string,string>")).collect()]
    assert got == [(1, "first"), (2, "late"), (10, "last [shared image: a cat]")]
    rows = spark.createDataFrame([(p, q) for p in range(6) for q in range(5)], "persona_id int, question_id int")
    one, two = (sorted(map(tuple, Files.persona_sample(rows, 3, 2, seed).collect())) for seed in (1, 1))
    assert one == two and len(one) == 6 and len({p for p, _ in one}) == 3


def test_result_logs(spark, tmp_path):
    line = {"qid": "1", "cat": "c", "sys": {"lean": {"ok": True, "tok": 5, "lat": 0.5, "pred": "x"}, "full": {"ok": None, "err": "late"}}}
    (tmp_path / "log.jsonl").write_text(json.dumps(line) + "\n")
    got = {r["system"]: (r["ok"], r["tok"], r["err"]) for r in Files.result_log(spark, f"file://{tmp_path}/log.jsonl").collect()}
    assert got == {"lean": (True, 5, None), "full": (None, None, "late")}
    Files.write_results(spark.range(3), spark.range(1).withColumnRenamed("id", "n"), f"file://{tmp_path}/out")
    assert spark.read.json(f"file://{tmp_path}/out/rows").count() == 3 and spark.read.json(f"file://{tmp_path}/out/summary").collect()[0]["n"] == 0


def test_small_views(spark):
    edges = spark.createDataFrame([("u", "a", "b", 1), ("u", "a", "c", 2)], "user_id string, src string, dst string, fact_id int")
    assert [r["fact_id"] for r in Health.stale_edges(edges, edges.where("fact_id = 1")).collect()] == [2]
    facts = spark.createDataFrame([("x", "tx", True), ("y", "ty", False)], "object string, text string, sensitive boolean")
    assert sorted((r["object"], r["text"]) for r in Health.redacted(facts).collect()) == [("[redacted]", "[redacted]"), ("y", "ty")]
    rows = [("user", 0, ["a"]), ("extracted", 3, ["a"]), ("extracted", 1, ["a", "b"]), ("extracted", 0, [])]
    f = spark.createDataFrame(rows, "source string, access_count int, provenance array<string>").withColumn("n", F.monotonically_increasing_id())
    got = [(r["evidence_kind"], r["evidence_count"]) for r in Profile.evidence(f).orderBy("n").collect()]
    assert got == [("user", 1), ("reinforced", 3), ("mentions", 2), ("mentions", 1)]
    eps = spark.createDataFrame([("e1", 1.0, "I met Ann. I started yoga in May. Yoga ended."), ("e2", 2.0, "The yoga course finished."), ("e3", 3.0, "yoga is nice")], "episode_id string, event_time double, content string")
    got = {(r["anchor"], r["episode_id"]): r["sentence"] for r in Time.duration_evidence(eps, ["yoga", "golf"]).collect()}
    assert got == {("yoga", "e1"): "I started yoga in May.", ("yoga", "e2"): "The yoga course finished."}


SHAPES = {
    '{"messages": [{"role": "user", "content": "a b"}]}': ("messages", 1),
    '[{"role": "user", "content": "a b"}, {"role": "assistant", "content": "c"}]': ("messages", 2),
    '[{"session_id": "s1", "role": "user", "content": "a"}, {"session_id": "s2", "role": "user", "content": "b"}]': ("records", 2),
    '[{"content": "a"}]': ("records", 1),
    '{"role": "user", "content": "a bare record"}': ("records", 1),
    '{"content": "a"}\n{"content": "b"}': ("jsonl", 2),
    '{"mapping": {"a": {"parent": null, "message": {"author": {"role": "user"}, "content": {"parts": ["hello"]}}}}, "current_node": "a"}': ("chatgpt", 1),
    '{"type": "user", "isSidechain": false, "message": {"role": "user", "content": "a long enough line"}}\n{"type": "assistant", "isSidechain": false, "message": {"role": "assistant", "content": "another long line"}}': ("agent_session", 2),
    "Alice: hi\nBob: ho": ("transcript", 2),
    "no speaker here": ("transcript", 1),
    "{not json at all": ("transcript", 1),
}


@pytest.mark.parametrize("end", ["", "\n", "\n\n", "\r\n"])
def test_no_file_is_lost(spark, end):
    files = spark.createDataFrame([(str(i), ("  " if i % 2 and "ali" not in t.lower() else "") + t + end) for i, t in enumerate(SHAPES)], "id string, text string")
    found = {r["id"]: r["format"] for r in Conv.sniff(files).collect()}
    assert found == {str(i): kind for i, (kind, _) in enumerate(SHAPES.values())}
    assert Conv.read_any(files).count() == sum(n for _, n in SHAPES.values())
    assert {r[0] for r in Conv.read_any(files.where("id = '2'")).select("session_id").collect()} == {"s1", "s2"}


def test_texts_of_files_are_made_once(spark):
    calls = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def told(text):
        calls.add(1)
        return text

    files = spark.createDataFrame([(str(i), t) for i, t in enumerate(SHAPES)], "id string, text string")
    made = Conv.read_any(files.withColumn("text", told("text")))
    want = sorted((r["session_id"], r["pos"], r["speaker"], r["content"]) for r in Conv.read_any(files).collect())
    assert sorted((r["session_id"], r["pos"], r["speaker"], r["content"]) for r in made.collect()) == want
    assert calls.value == len(SHAPES)


def test_export_orders_and_hides(spark):
    def node(parent, text, role="user", at=None, **more):
        return {"parent": parent, "message": {"author": {"role": role}, "content": {"parts": [text]}, "create_time": at, **more}}

    tree = {"c": node("b", "third"), "a": node(None, "first"), "x": node("a", "not on the way"), "b": node("a", "second", "assistant"), "n": {"parent": "c", "message": None}}
    loose = {"a": node(None, "late", at=9.5), "b": node(None, "hidden", at=1, metadata={"is_visually_hidden_from_conversation": True}), "c": node(None, "sys", "system", 2), "d": node(None, "early", at=3), "e": node(None, " ", at=4)}
    rows = [(0, json.dumps({"title": "t", "conversation_id": "k", "mapping": tree, "current_node": "n"})), (1, json.dumps({"mapping": loose})), (2, "{}"), (3, "no"), (4, json.dumps({"mapping": loose, "current_node": "gone"}))]
    got = [tuple(r) for r in Conv.chat_export(spark.createDataFrame(rows, "i int, json string")).select("session_id", "title", "pos", "speaker", "content").orderBy("session_id", "pos").collect()]
    assert got == [
        *[(f"chatgpt_{i}", f"conversation {i + 1}", p, "user", c) for i in (1, 4) for p, c in ((0, "early"), (2, "late"))],
        ("k", "t", 0, "user", "first"), ("k", "t", 1, "assistant", "second"), ("k", "t", 2, "user", "third"),
    ]
