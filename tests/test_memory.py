"""The whole path: statements in, answers out."""

import pytest
from pyspark.sql import functions as F

from palimpsest.memory import Memory
from palimpsest.operators import blocks as Blocks
from palimpsest.operators import models as Models
from palimpsest.plans.imports import BASE, DAY, SCRIPT

T = BASE + 60 * DAY


@pytest.fixture(scope="module")
def mem(spark):
    m = Memory(spark)
    for text, day in SCRIPT[:5]:
        m.add(text, "u1", BASE + day * DAY, session=f"s{day}")
    m.consolidate()
    for text, day in SCRIPT[5:]:
        m.add(text, "u1", BASE + day * DAY, session=f"s{day}")
    m.consolidate()
    return m


def test_current_and_past(mem):
    at = lambda t: {r["object"] for r in mem.as_of(t, "u1").where("subject = 'Wei' AND predicate = 'works_at'").collect()}
    assert at(BASE + 10 * DAY) == {"Tencent"} and at(T) == {"Moonshot AI"}
    rows = mem.history("u1", "wei", "works_at").collect()
    assert [r["object"] for r in rows] == ["Tencent", "Moonshot AI"] and rows[1]["supersedes"] == rows[0]["fact_id"]


@pytest.mark.parametrize(
    "query,via,answer",
    [
        ("Where does Wei work now?", "hybrid", "Moonshot AI"),
        ("Where did Wei work before?", "history", "Tencent"),
        ("What is Gina's favorite food?", "abstain", "I don't have that in memory."),
    ],
)
def test_search(mem, query, via, answer):
    assert mem.search(query, "u1", T)[:2] == (via, answer)


def test_context_is_bounded_and_relevant(mem):
    text = mem.lean_context("Where does Wei work now?", "u1", T, 800)
    assert "Moonshot AI" in text and len(text) <= 800 and "CURRENT STATE" in text


def test_edits_focus_and_store(mem, spark, tmp_path):
    root = f"file://{tmp_path}/m"
    mem.save(root)
    m = Memory.open(spark, root)
    assert m.facts.count() == mem.facts.count() and m.names.collect() == mem.names.collect()
    m.add_fact("Wei", "lives_in", "Beijing", "u1", T)
    assert [r["object"] for r in m.as_of(T + 1, "u1").where("predicate = 'lives_in' AND subject = 'Wei'").collect()] == ["Beijing"]
    some = m.facts.where("object = 'jazz'").first()["fact_id"]
    m.delete_fact(some)
    assert m.facts.where(F.col("fact_id") == some).count() == 0
    m.set_focus(mute=["tencent"])
    assert m._view().where(F.contains("text", F.lit("Tencent"))).count() == 0
    m.forget("u1")
    assert m.facts.count() == 0 and m.episodes.count() == 0


def test_cache_asks_each_prompt_once(spark):
    p = spark.createDataFrame([("a",), ("b",), ("a",), ("",)], "prompt string")
    out, cache = Models.complete(p, lambda x: x.upper())
    assert sorted(str(r["answer"]) for r in out.collect()) == ["A", "A", "B", "None"] and cache.count() == 2
    again, _ = Models.complete(p, lambda x: 1 / 0 if x else "", cache=spark.createDataFrame(cache.collect(), Models.CACHE))
    assert sorted(str(r["answer"]) for r in again.collect()) == ["A", "A", "B", "None"]


def test_model_output(spark):
    assert Models.salvage('```json\n[{"a": 1}, {"b": 2}, {"c": ') == [{"a": 1}, {"b": 2}]
    assert Models.salvage("nothing") == [] and Models.salvage('{"facts": [{"a": 1}, 3]}') == [{"a": 1}]
    raw = spark.createDataFrame([("e1", '[{"subject": "Wei", "predicate": "likes", "object": "tea"}, {"subject": "x"}]'), ("e2", None)], "episode_id string, answer string")
    assert [tuple(r) for r in Models.facts_from_output(raw).collect()] == [("e1", "Wei", "likes", "tea")]
    rows = [("s", "decision", "We  will ship on Friday", "tests pass"), ("s", "decision", "we will ship on friday", ""), ("s", "joke", "a statement long enough", ""), ("s", "lesson", "short", "")]
    got = Models.outcomes(spark.createDataFrame(rows, "session_id string, kind string, statement string, why string"), ("decision", "lesson")).collect()
    assert len(got) == 1


def test_rerank_and_seats(spark):
    rows = [(1, "q", i, "x" * i) for i in range(6)]
    top = Models.rerank(spark.createDataFrame(rows, "qid int, query string, id int, text string"), lambda q, t: len(t), 2)
    assert [r["id"] for r in top.orderBy("rank").collect()] == [5, 4]
    lists = spark.createDataFrame([(0, 1, "a"), (0, 2, "b"), (0, 3, "c"), (1, 1, "a"), (1, 2, "d"), (2, 1, "a"), (2, 2, "d"), (2, 3, "e")], "list_no int, rank int, id string")
    assert Blocks.seats(lists, 4) == ["a", "d", "b", "c"]
    first = Blocks.union_first([lists.where("list_no = 1").withColumnRenamed("id", "fact_id"), lists.where("list_no = 0").withColumnRenamed("id", "fact_id")])
    assert [r["fact_id"] for r in first.collect()] == ["a", "d", "b", "c"]


def test_episode_search(spark):
    rows = [(f"e{i}", f"topic {i % 7} note {i}", [float(i % 5), 1.0], float(i)) for i in range(60)]
    e = spark.createDataFrame(rows, "episode_id string, content string, embedding array<double>, event_time double")
    got = Blocks.episode_search(e, "topic 3", [4.0, 1.0], 5, 50.0).collect()
    assert len(got) == 5 and [r["rank"] for r in got] and all(int(r["id"][1:]) <= 50 for r in got)


def _embedder(texts):
    return [[float(len(t or "")), 1.0] for t in texts]


def _every_write(m, spark):
    """Each way to write, and what must hold after it."""
    before = m.episodes.count()
    m.add("I work at Acme.", "u1", T + 1)
    m.add("I work at Acme.", "u1", T + 1)
    m.remember("I prefer tea.", "u1", T + 2, session="later")
    m.remember("I am in a meeting right now.", "u1", T + 2, session="later", scope="working", ttl=60.0)
    messages = [("imp", "", 0, "user", "I like hiking.", None, "chat")]
    m.import_messages(spark.createDataFrame(messages, "session_id string, title string, pos long, speaker string, content string, event_time double, source string"), "u1")
    assert m.episodes.count() == before + 5 == m.episodes.select("episode_id").distinct().count()
    assert m.episodes.where(F.col("event_time") == T + 1).select("seq").distinct().count() == 2
    m.add_fact("Wei", "lives_in", "Osaka", "u1", T + 3)
    assert m.consolidate() >= 3
    m.update_fact(m.facts.where("object = 'Osaka'").first()["fact_id"], object="Kobe")
    said = '[{"kind": "decision", "statement": "We will move the store to another city.", "why": "rent"}]'
    assert m.close_session("u1", "later", T + 4, model=lambda p: said)["outcomes"] == 1
    m.decay(T + 5)
    assert m.facts.where("object = 'Kobe'").count() == 1 and m.facts.where("text IS NULL OR category IS NULL").isEmpty()


def test_every_write_works_after_evict_reembed_and_open(spark, tmp_path):
    m = Memory(spark)
    for text, day in SCRIPT[:4]:
        m.add(text, "u1", BASE + day * DAY, session=f"s{day}")
    m.add("My name is Ada.", "u2", BASE)
    m.consolidate()
    m.remember("I am on a train right now.", "u2", BASE, scope="working")
    m.evict(1)
    _every_write(m, spark)
    assert m.facts.where("tier IS NULL").isEmpty() and m.facts.where("tier = 'hot' AND object = 'Kobe'").count() == 1
    m.reembed(_embedder)
    m.add("I work at Initech.", "u1", T + 9, session="new")
    m.add_fact("Wei", "plays", "go", "u1", T + 9)
    m.consolidate()
    m.close_session("u1", "new", T + 10)
    assert m.facts.where("embedding IS NULL").isEmpty() and m.episodes.where("embedding IS NULL").isEmpty()
    root = f"file://{tmp_path}/kept"
    m.save(root)
    again = Memory.open(spark, root, _embedder)
    for name in ("facts", "episodes", "working", "names"):
        held, read = getattr(m, name), getattr(again, name)
        cols = sorted(held.columns)
        assert sorted(read.columns) == cols
        assert sorted(map(str, read.select(*cols).collect())) == sorted(map(str, held.select(*cols).collect()))
    again.add("I work at Hooli.", "u1", T + 20)
    again.add_fact("Wei", "speaks", "Ainu", "u1", T + 20)
    again.consolidate()
    assert again.facts.where("embedding IS NULL OR tier IS NULL").isEmpty() and again.arrivals > m.arrivals
    again.forget("u2")
    for name in ("facts", "episodes", "working", "names"):
        assert getattr(again, name).where("user_id = 'u2'").isEmpty() and not (name == "facts" and again.facts.isEmpty())
