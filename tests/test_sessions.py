"""Closing sessions, recall, working memory, stores, threads and retrieval in rounds."""

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from palimpsest.memory import Memory
from palimpsest.operators import agentic as A
from palimpsest.operators import graph as G
from palimpsest.operators import sessions as S
from palimpsest.sources import conversations as Conv
from palimpsest.sources import files as Files
from palimpsest.sources import store as Store

T = 1_700_000_000.0


@pytest.fixture(scope="module")
def mem(spark):
    m = Memory(spark)
    m.add("My name is Wei. I work at Acme. I like green tea", "u", T, "s1")
    m.add("Bo lives in Oslo", "u", T + 10, "s2")
    assert m.remember("Today my throat hurts", "u", T + 20, "s1") == "working"
    assert m.remember("Bo works at Initech", "u", T + 30, "s1") == "long"
    return m


def test_close_session(mem):
    model = lambda p: json.dumps([{"kind": "decision", "statement": "Wei keeps drinking green tea", "why": "it is good"}, {"kind": "decision", "statement": "short"}])
    assert mem.working_memory("u", T + 60, "s1").count() == 1
    got = mem.close_session("u", "s1", T + 100, model=model)
    assert got == {"episodes": 3, "pending_consolidated": 2, "facts_added": 3, "summaries": 3, "outcomes": 1, "working_cleared": 1}
    assert mem.pending.count() == 1 and mem.working_memory("u", T + 60).count() == 0
    again = mem.close_session("u", "s1", T + 200, model=model)
    assert (again["outcomes"], again["facts_added"], again["pending_consolidated"], again["summaries"]) == (0, 0, 0, 0)
    assert {r["object"] for r in mem.facts.where("predicate IN ('works_at', 'likes')").collect()} == {"Acme", "green tea", "Initech"}
    assert mem.facts.where("lower(object) like '%throat%'").isEmpty()
    assert {(r["session_id"], r["episodes"], r["episodes_pending"]) for r in mem.status(T).collect()} == {("s1", 3, 0), ("s2", 1, 1)}
    mem.consolidate()
    rep = mem.session_report(T + 100).where("session_id = 's2'").collect()
    assert [(r["text"], r["status"], r["redacted"]) for r in rep] == [("Bo lives in Oslo", "live", False)] or len(rep) == 1


def test_recall(mem):
    out = mem.recall("Where does Wei work?", "u", T + 300, 800, answerer=lambda p: "Acme" if "Acme" in p else "?")
    assert "Acme" in out["context"] and out["answer"] == "Acme" and 0 < out["tokens_est"] and out["full_tokens"] > 0
    both = mem.recall_spaces("Where does Wei work?", ["u", "nobody"], T + 300, 800)
    assert both["context"].startswith("## Space: u\n") and "nobody" not in both["context"]


def test_cold_facts_are_found_and_warmed(mem, spark):
    m = Memory(spark)
    m.facts, m.episodes = mem.facts, mem.episodes
    m.evict(0)
    assert {r["tier"] for r in m.facts.where("predicate = 'works_at'").collect()} == {"hot"}  # durable facts stay
    m.facts = m.facts.withColumn("tier", F.lit("cold"))
    via, answer, ids = m.search("Where does Bo live?", "u", T + 300)
    assert answer == "Oslo" and via == "hybrid"
    assert m.facts.where(F.col("fact_id").isin(*ids) & (F.col("tier") == "hot") & (F.col("access_count") == 1)).count() == len(ids)


def test_summary_is_the_last_resort(mem, spark):
    m = Memory(spark)
    m.add("the zebra migration took nine weeks of planning", "u", T, "s9")
    m.close_session("u", "s9", T + 1)
    via, answer, _ = m.search("How was the zebra migration?", "u", T + 300)
    assert via == "summary" and "nine weeks" in answer


def test_reembed_and_store(mem, spark, tmp_path):
    m = Memory(spark)
    m.facts, m.episodes, m.working = mem.facts, mem.episodes, mem.working
    n = m.reembed(lambda texts: [[float(len(t)), 1.0] for t in texts])
    assert n["facts"] == m.facts.count() and n["summaries"] == 3
    assert all(r["embedding"] == [float(len(r["text"])), 1.0] for r in m.facts.collect())
    root = f"file://{tmp_path}/store"
    m.set_policy(outcomes="What?", other="")
    m.save(root)
    a, b = Memory.open(spark, root), Memory.open(spark, root)
    assert a.policy == {"outcomes": "What?"} and not a.stale(root)
    a.save(root)
    assert b.stale(root)
    with pytest.raises(ValueError, match="another writer"):
        b.save(root)


def test_working_items(spark):
    rows = [("a", "u", "s", "x", "state", 0.0, 50.0, False), ("b", "u", "s", "y", "note", 0.0, None, False), ("c", "v", "s", "z", "state", 0.0, None, True)]
    items = spark.createDataFrame(rows, S.WORKING)
    ids = lambda df: sorted(r["item_id"] for r in df.collect())
    assert ids(S.working_items(items, "u", 10.0)) == ["a", "b"] and ids(S.working_items(items, "u", 60.0)) == ["b"]
    assert ids(S.working_items(items, "u", 10.0, "s", "note")) == ["b"] and ids(S.working_items(items, "v", 10.0)) == []
    used = S.consume(items, items.where("item_id = 'b'"))
    assert ids(S.working_items(used, "u", 10.0)) == ["a"]
    assert ids(S.clear_sessions(items, items.where("user_id = 'u'"))) == ["c"]


def test_committed_lines(spark, tmp_path):
    path = tmp_path / "facts.jsonl"
    path.write_text("".join(json.dumps({"id": str(i)}) + "\n" for i in range(50)) + '{"id": "torn')
    got = Store.committed_lines(spark, f"file://{path}", 50)
    assert [json.loads(r["line"])["id"] for r in got.orderBy("no").collect()] == [str(i) for i in range(50)]
    with pytest.raises(ValueError, match="malformed"):
        Store.committed_lines(spark, f"file://{path}", 51)
    with pytest.raises(ValueError, match="51 lines, not the 60"):
        Store.committed_lines(spark, f"file://{path}", 60)
    logs = {"facts": (f"file://{path}", 50)}
    assert Store.convert(spark, logs, f"file://{tmp_path}/new", {"facts": "id string"}, dry_run=True) == {"facts": 50}
    assert Store.read_manifest(spark, f"file://{tmp_path}/new") is None
    Store.convert(spark, logs, f"file://{tmp_path}/new", {"facts": "id string"})
    assert Store.load(spark, f"file://{tmp_path}/new")["facts"].count() == 50


def test_documents_by_id(spark):
    d = Store.Documents(spark.createDataFrame([(1, "a"), (2, "b")], "id int, t string"))
    d = d.put(spark.createDataFrame([(2, "c"), (3, "d")], "id int, t string"))
    assert sorted(tuple(r) for r in d.scan().collect()) == [(1, "a"), (2, "c"), (3, "d")]
    assert d.get(2).first()["t"] == "c" and d.scan(F.col("t") > "b").count() == 2
    assert d.delete(d.get(2)).scan().count() == 2


@pytest.mark.parametrize("cycle", [False, True])
def test_long_threads(spark, cycle):
    node = lambda i: {"parent": f"n{i - 1}" if i else ("n5" if cycle else None), "message": {"author": {"role": "user"}, "content": {"parts": [f"m{i}"]}}}
    side = {"parent": "n3", "message": {"author": {"role": "user"}, "content": {"parts": ["aside"]}}}
    conv = {"title": "long", "id": "c", "current_node": "n999", "mapping": {**{f"n{i}": node(i) for i in range(1000)}, "x": side}}
    got = Conv.chat_export(spark.createDataFrame([(0, json.dumps(conv))], "i int, json string")).orderBy("pos").collect()
    assert [r["content"] for r in got] == [f"m{i}" for i in range(1000)] and [r["pos"] for r in got] == list(range(1000))


def test_docx(spark, tmp_path):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("word/document.xml", '<w:document><w:p><w:r><w:t>One &amp; </w:t></w:r><w:r><w:t xml:space="preserve">two</w:t></w:r></w:p><w:p/><w:p><w:r><w:t>three</w:t></w:r></w:p></w:document>')
    df = spark.createDataFrame([(1, bytearray(data.getvalue())), (2, bytearray(b"PK\x03\x04 broken")), (3, None)], "id int, content binary")
    assert {r["id"]: r["t"] for r in df.select("id", Files.docx_text(F.col("content")).alias("t")).collect()} == {1: "One & two\nthree", 2: None, 3: None}


def test_rounds(spark):
    texts = {1: "tea is green", 2: "tea grows in Assam", 3: "Assam is wet"}
    asked = []

    def pull(queries, k):
        rows = [(n, r, i, t) for n, q in enumerate(queries) for r, (i, t) in enumerate(((i, t) for i, t in texts.items() if q in t), 1)]
        return spark.createDataFrame(rows, "list_no int, rank int, id int, text string")

    def decompose(query, hint):
        asked.append(hint)
        return ["Assam"] if hint else ["tea"]

    got = A.gather(pull, "what about tea?", decompose, 3)
    assert [(r["id"], r["round"]) for r in got.collect()] == [(1, 0), (2, 0), (3, 1)] and asked[0] == "" and "Assam" in asked[1]
    assert A.gather(pull, "q", lambda q, h: ["nothing"], 3).collect() == []
    assert A.hypothetical("q", None) == "q" and A.hypothetical("q", lambda p: " x ") == "q\nx"
    assert A.verified("a", "c", None) and not A.verified("a", "c", lambda p: "no") and A.verified("a", "c", lambda p: "A yes")
    assert A.intents("q", lambda p: '["graph", "bad"]', ("graph", "wiki")) == ["graph"] and A.intents("q", lambda p: "?", ("graph",)) == []


def test_grounded_plan_and_bridge(mem):
    live = mem.facts
    plan = lambda p: '```json\n{"anchor": "Wei", "predicates": ["likes", "made_up", "works_at"]}\n```'
    assert A.grounded_plan("?", live, "u", T + 300, plan) == ("Wei", ["likes", "works_at"])
    assert A.grounded_plan("?", live, "u", T + 300, lambda p: "no idea") == (None, [])
    facts = live.where("predicate = 'works_at'")
    got = A.walk_facts(facts, "Wei", ["works_at"], T + 300).collect()
    assert [r["node"] for r in got] == ["acme"] and len(got[0]["path"]) == 1
    notes = A.entity_notes(live, "What about Bo?", "u", T + 300, lambda p: f"{p.count('[')} lines").collect()
    assert [(r["entity"], r["note"]) for r in notes] == [("bo", "2 lines")]


def test_unsettled_identities_raise(spark):
    links = spark.createDataFrame([(f"{i:04}", f"{i + 1:04}") for i in range(40)], "a string, b string")
    assert {r["canonical"] for r in G.identity_roots(links).collect()} == {"0000"}
    with pytest.raises(RuntimeError):
        G.identity_roots(links, rounds=1)
