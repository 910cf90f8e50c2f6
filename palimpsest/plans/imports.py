"""Importers, conflict folding, extraction and packing, on scripts with known outcomes and on driver tables."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from palimpsest.catalog import query
from palimpsest.functions import text as T
from palimpsest.functions import vectors as Vec
from palimpsest.operators import aggregates as Agg
from palimpsest.operators import context as Context
from palimpsest.operators import lifecycle as Life
from palimpsest.operators import temporal as Time
from palimpsest.operators.extract import extract
from palimpsest.operators.reconcile import FACT, reconcile
from palimpsest.plans.common import values_sql
from palimpsest.session import table
from palimpsest.sources import conversations as Conv
from palimpsest.sources import store as Store

BASE, DAY = 1_700_000_000.0, 86400.0
SCRIPT = [
    ("My name is Wei and I work at Tencent.", 0),
    ("I live in Shenzhen.", 1),
    ("My favorite programming language is Python.", 2),
    ("Actually I just switched jobs — I now work at Moonshot AI.", 30),
    ("My colleague Lin works at Moonshot AI too.", 31),
    ("My sister Maya is a pediatrician", 32),
    ("Maya moved to Seattle next month", 33),
    ("I like jazz, hate rain", 34),
    ("I no longer like jazz", 40),
    ("To rotate the PAT: open settings, regenerate the token", 41),
]


def _episodes(spark):
    rows = [(f"e{i}", "u1", t, BASE + d * DAY, BASE + d * DAY, i) for i, (t, d) in enumerate(SCRIPT)]
    return spark.createDataFrame(rows, "episode_id string, user_id string, content string, event_time double, ingested_at double, seq long")


EXTRACTED = [
    ("Wei", "works_at", "Tencent", "e0"), ("Wei", "lives_in", "Shenzhen", "e1"), ("Wei", "favorite_programming_language", "Python", "e2"), ("Wei", "works_at", "Moonshot AI", "e3"),
    ("Wei", "colleague", "Lin", "e4"), ("Lin", "works_at", "Moonshot AI", "e4"), ("Wei", "sister", "Maya", "e5"), ("Maya", "occupation", "pediatrician", "e5"),
    ("Maya", "lives_in", "Seattle", "e6"), ("u1", "likes", "jazz", "e7"), ("u1", "hates", "rain", "e7"), ("u1", "dislikes", "jazz", "e8"), ("PAT", "procedure", "open settings, regenerate the token", "e9"),
]


@query("rule_extract", values_sql(["subject", "predicate", "object", "episode"], EXTRACTED))
def rule_extract(spark, sf_dir):
    return extract(_episodes(spark)).select("subject", "predicate", "object", F.col("provenance")[0].alias("episode"))


@query(
    "consolidated_state",
    values_sql(
        ["subject", "predicate", "object", "live", "replaced"],
        [(s, p, o, (s, p, o) not in (("Wei", "works_at", "Tencent"), ("u1", "likes", "jazz")), (s, p, o) in (("Wei", "works_at", "Moonshot AI"), ("u1", "dislikes", "jazz"))) for s, p, o, _ in EXTRACTED],
    ),
)
def consolidated_state(spark, sf_dir):
    f = reconcile(extract(_episodes(spark)))
    return f.select("subject", "predicate", "object", F.col("expired_at").isNull().alias("live"), F.col("supersedes").isNotNull().alias("replaced"))


def _fact(i, s, p, o, t, source="extracted"):
    return (f"f{i}", "u", s, p, o, float(t), float(t), None, None, None, source, 1.0, [f"e{i}"], i)


FOLD = [
    _fact(0, "user", "studying", "biology", 1), _fact(1, "user", "studying", "chemistry", 2), _fact(2, "user", "likes", "pizza", 3), _fact(3, "user", "likes", "pasta", 4),
    _fact(4, "user", "boss", "Charles is my boss and a branch manager", 5), _fact(5, "user", "boss", "Charles", 6), _fact(6, "user", "lives_in", "Paris", 7, "user"),
    _fact(7, "user", "lives_in", "Rome", 8), _fact(8, "user", "dislikes", "pizza", 9), _fact(9, "User ", "studying", "chemistry", 10), _fact(10, "lin", "lives_in", "Beijing", 11),
    _fact(11, "user", "likes", "long walks", 12), _fact(12, "user", "likes", "long walks near rivers", 13),
]


@query(
    "reconcile_fold",
    values_sql(
        ["fact_id", "invalid_at", "supersedes"],
        [
            ("f0", 2.0, None), ("f1", None, "f0"), ("f2", 9.0, None), ("f3", None, None), ("f4", None, None), ("f6", None, None), ("f8", None, "f2"), ("f9", None, None),
            ("f10", None, None), ("f11", 13.0, None), ("f12", None, "f11"),
        ],
    ),
)
def reconcile_fold(spark, sf_dir):
    return reconcile(spark.createDataFrame(FOLD, FACT)).select("fact_id", "invalid_at", "supersedes")


@query(
    "reconcile_events",
    """WITH k AS (SELECT *, lag(event_type) OVER w AS pv, row_number() OVER w AS rn FROM (SELECT DISTINCT ON (user_id, ts) user_id, ts, event_id, event_type FROM events ORDER BY user_id, ts, event_id) WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
f AS (SELECT user_id, event_id, ts, lag(event_id) OVER w AS sup, lead(ts) OVER w AS nxt FROM k WHERE rn = 1 OR event_type <> pv WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT 'f' || event_id AS fact_id, 'f' || sup AS supersedes, nxt IS NULL AS live FROM f""",
)
def reconcile_events(spark, sf_dir):
    """The fold on a slot 'last action' per user: equal to the closed form where that applies."""
    e = table(spark, sf_dir, "events").groupBy("user_id", "ts").agg(F.min_by(F.struct("event_id", "event_type"), "event_id").alias("e"))
    t = T.seconds_of("ts")
    f = e.select(
        F.concat(F.lit("f"), "e.event_id").alias("fact_id"), F.col("user_id").cast("string").alias("user_id"), F.lit("user").alias("subject"), F.lit("last_action").alias("predicate"),
        F.col("e.event_type").alias("object"), t.alias("valid_at"), t.alias("created_at"), F.lit(None).cast("double").alias("invalid_at"), F.lit(None).cast("double").alias("expired_at"),
        F.lit(None).cast("string").alias("supersedes"), F.lit("extracted").alias("source"), F.lit(1.0).alias("salience"), F.array(F.concat(F.lit("e"), "e.event_id")).alias("provenance"), F.col("e.event_id").alias("seq"),
    )
    return reconcile(f).select("fact_id", "supersedes", F.col("expired_at").isNull().alias("live"))


@query(
    "import_dedupe",
    """WITH m AS (SELECT conv_id, string_agg(role || ': ' || trim(text), chr(10) ORDER BY turn) AS body FROM conversations WHERE trim(text) <> '' GROUP BY conv_id)
SELECT CAST(conv_id AS VARCHAR) AS session_id, sha1('u|' || conv_id || '|0|' || body) AS fingerprint FROM m WHERE conv_id % 3 <> 0""",
)
def import_dedupe(spark, sf_dir):
    """Conversations as imports of which every third landed before."""
    msgs = _messages(spark, sf_dir)
    before = Conv.import_episodes(msgs.where(F.col("session_id").cast("long") % 3 == 0), "u")
    return Conv.import_episodes(msgs, "u", before).select("session_id", "fingerprint")


def _messages(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return c.select(
        F.col("conv_id").cast("string").alias("session_id"), F.lit("").alias("title"), F.col("turn").alias("pos"), F.col("role").alias("speaker"), F.col("text").alias("content"),
        F.lit(None).cast("double").alias("event_time"), F.lit("messages").alias("source"),
    )


@query("session_render", "SELECT CAST(conv_id AS VARCHAR) AS session_id, string_agg(role || ': ' || trim(text), chr(10) ORDER BY turn) AS body FROM conversations WHERE trim(text) <> '' GROUP BY conv_id")
def session_render(spark, sf_dir):
    return Conv.render(_messages(spark, sf_dir)).select("session_id", "body")


@query(
    "records_to_sessions",
    "SELECT CAST(user_id AS VARCHAR) AS session_id, event_id AS pos, event_type AS speaker, 'value ' || CAST(event_id AS VARCHAR) AS content, epoch_us(ts) / 1000000.0 AS event_time FROM events",
)
def records_to_sessions(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"),
        F.to_json(F.struct(F.col("user_id").alias("thread_id"), F.col("event_type").alias("role"), F.concat(F.lit("value "), "event_id").alias("text"), T.seconds_of("ts").alias("ts"))).alias("json"),
    )
    return Conv.records(e).select("session_id", "pos", "speaker", "content", "event_time")


TREE = [
    {
        "title": "Trip", "create_time": BASE, "current_node": "c", "id": "t1",
        "mapping": {
            "r": {"id": "r", "parent": None, "message": None},
            "s": {"id": "s", "parent": "r", "message": {"author": {"role": "system"}, "content": {"parts": ["primer"]}}},
            "a": {"id": "a", "parent": "s", "message": {"author": {"role": "user"}, "create_time": BASE + 1, "content": {"content_type": "text", "parts": ["Hello", "there"]}}},
            "b": {"id": "b", "parent": "a", "message": {"author": {"role": "assistant"}, "create_time": BASE + 2, "content": {"content_type": "text", "parts": ["Hi"]}}},
            "x": {"id": "x", "parent": "a", "message": {"author": {"role": "assistant"}, "content": {"parts": ["another branch"]}}},
            "c": {"id": "c", "parent": "b", "message": {"author": {"role": "user"}, "create_time": BASE + 3, "content": {"content_type": "text", "parts": ["Bye"]}}},
        },
    },
    {"mapping": {"p": {"message": {"author": {"role": "user"}, "create_time": 9.0, "content": "later"}}, "q": {"message": {"author": {"role": "user"}, "create_time": 5.0, "content": "first"}}}},
]


@query(
    "thread_linearise",
    values_sql(
        ["session_id", "title", "pos", "speaker", "content"],
        [("t1", "Trip", 0, "user", "Hello\nthere"), ("t1", "Trip", 1, "assistant", "Hi"), ("t1", "Trip", 2, "user", "Bye"), ("chatgpt_1", "conversation 2", 0, "user", "first"), ("chatgpt_1", "conversation 2", 1, "user", "later")],
    ),
)
def thread_linearise(spark, sf_dir):
    rows = spark.createDataFrame([(i, json.dumps(c)) for i, c in enumerate(TREE)], "i int, json string")
    return Conv.chat_export(rows).select("session_id", "title", F.col("pos").cast("long").alias("pos"), "speaker", "content")


@query(
    "chat_arrays",
    values_sql(["session_id", "pos", "speaker", "content"], [("imported", 0, "user", "a"), ("imported", 1, "assistant", "b\nc"), ("imported_0", 0, "user", "one"), ("imported_1", 0, "bot", "two")]),
)
def chat_arrays(spark, sf_dir):
    one = [{"role": "user", "content": " a "}, {"author": {"role": "assistant"}, "content": [{"type": "text", "text": "b"}, {"type": "image_url"}, "c"]}, {"role": "user", "content": ""}]
    many = [[{"content": "one"}], {"messages": [{"speaker": "bot", "text": "two"}]}]
    f = spark.createDataFrame([(0, json.dumps({"messages": one})), (1, json.dumps(many))], "id int, json string")
    return Conv.chat_array(f).select("session_id", F.col("pos").cast("long").alias("pos"), "speaker", "content")


@query(
    "transcript_turns",
    values_sql(["pos", "speaker", "content"], [(1, "Alice", "hello\nsecond line"), (2, "Bob B.", "hi: you"), (0, "user", "just text\nmore")]),
)
def transcript_turns(spark, sf_dir):
    text = [(0, i, x) for i, x in enumerate(["Alice: hello", "second line", "", "Bob B.: hi: you"])] + [(1, i, x) for i, x in enumerate(["just text", "more"])]
    return Conv.transcript(spark.createDataFrame(text, "id int, line_no int, line string")).select(F.col("pos").cast("long").alias("pos"), "speaker", "content")


@query(
    "agent_log_turns",
    values_sql(["pos", "speaker", "content", "event_time"], [(0, "user", "please use [REDACTED] for this", 1704067200.0), (1, "assistant", "first part of it\nsecond part", None), (6, "user", "codex style message", None)]),
)
def agent_log_turns(spark, sf_dir):
    rows = [
        {"type": "user", "timestamp": "2024-01-01T00:00:00Z", "message": {"role": "user", "content": "please use sk-abcdefghijklmnop1234 for this"}},
        {"type": "assistant", "message": {"role": "assistant", "content": [{"type": "thinking", "text": "hm"}, {"type": "text", "text": "first part of it"}, {"type": "tool_use"}, {"type": "text", "text": "second part"}]}},
        {"type": "summary", "message": {"role": "user", "content": "a summary of things"}},
        {"type": "user", "isSidechain": True, "message": {"role": "user", "content": "a side chain message"}},
        {"type": "user", "message": {"role": "user", "content": "ok"}},
        {"type": "user", "message": {"role": "user", "content": "<local-command>something long"}},
        {"type": "response_item", "payload": {"type": "message", "role": "user", "content": [{"type": "input_text", "text": "codex style message"}]}},
    ]
    lines = [("s", i, json.dumps(r)) for i, r in enumerate(rows)] + [("s", 7, '{"torn'), ("s", 8, "not json")]
    return Conv.agent_log(spark.createDataFrame(lines, "session_id string, line_no int, line string")).select(F.col("pos").cast("long").alias("pos"), "speaker", "content", "event_time")


@query("sniff_formats", values_sql(["id", "format"], [(0, "chatgpt"), (1, "messages"), (2, "records"), (3, "jsonl"), (4, "transcript"), (5, "agent_session")]))
def sniff_formats(spark, sf_dir):
    texts = [
        json.dumps(TREE), json.dumps([{"role": "user", "content": "x"}]), json.dumps([{"session_id": "s", "content": "x"}]), '{"content": "a"}\n{"content": "b"}', "Alice: hi",
        '{"type": "user", "isSidechain": false}\n{"type": "user", "isSidechain": false}',
    ]
    return Conv.sniff(spark.createDataFrame(list(enumerate(texts)), "id long, text string")).select("id", "format")


@query(
    "to_epoch",
    values_sql(["id", "epoch"], [(0, 1700000000.0), (1, 1700000000.5), (2, 1700000000.0), (3, 1705314600.0), (4, 1705276800.0), (5, 1672876800.0), (6, None), (7, None)]),
)
def to_epoch(spark, sf_dir):
    rows = ["1700000000", "1700000000500", "1700000000000000", "2024-01-15T10:30:00Z", "2024-01-15", "on 2023/1/5 (Thu)", "junk", None]
    df = spark.createDataFrame(list(enumerate(rows)), "id long, v string")
    return df.select("id", T.to_epoch(F.col("v")).alias("epoch"))


@query("duration_parse", values_sql(["v", "seconds"], [("7d", 604800), ("12h", 43200), ("30m", 1800), ("90", 90), ("1.5h", 5400), ("x", None)]))
def duration_parse(spark, sf_dir):
    return spark.createDataFrame([(v,) for v in ("7d", "12h", "30m", "90", "1.5h", "x")], "v string").select("v", T.duration_seconds(F.col("v")).alias("seconds"))


@query("snapshot_restore", values_sql(["object", "replaces"], [("chemistry", "biology"), ("pasta", None)]))
def snapshot_restore(spark, sf_dir):
    """Two facts are known already; the chain is rewired to the new ids."""
    snap = spark.createDataFrame([f if f[0] != "f1" else (*f[:9], "f0", *f[10:]) for f in FOLD[:4]], FACT)
    known = snap.where("object = 'pizza'")
    new = Store.restore(snap, known)
    return new.alias("n").join(new.alias("o"), F.col("n.supersedes") == F.col("o.fact_id"), "left").select(F.col("n.object").alias("object"), F.col("o.object").alias("replaces")).where("object <> 'biology'")


@query(
    "numeric_candidates",
    values_sql(["id", "raw", "value", "unit", "include"], [(0, "$20", 20.0, "USD", True), (1, "$200", 200.0, "USD", True), (2, "$1,500.50", 1500.5, "USD", True), (4, "$7", 7.0, "USD", False)]),
)
def numeric_candidates(spark, sf_dir):
    rows = [(0, "I paid $20 for a writing workshop."), (1, "The workshop was great. It cost $200."), (2, "In March the workshop was $1,500.50!"), (3, "Lunch was $9."), (4, "The December workshop was $7.")]
    out = Agg.amounts(spark.createDataFrame(rows, "id bigint, text string"), "How much money did I spend on workshops in March?")
    return out.select("id", "raw", "value", "unit", "include")


@query("duration_candidates", values_sql(["id", "value", "include"], [(0, 0.5, True), (1, 2.0, False)]))
def duration_candidates(spark, sf_dir):
    rows = [(0, "Went for a 30-minute jog today."), (1, "I used to do 2 hours of yoga.")]
    out = Agg.amounts(spark.createDataFrame(rows, "id bigint, text string"), "How many hours of jogging and yoga did I do last week?")
    return out.select("id", "value", "include")


@query(
    "object_candidates",
    values_sql(["id", "item", "action", "include"], [(0, "coffee table", "bought", True), (1, "bookshelf", "assembled", True), (2, "kitchen table", "fixed", True), (3, "mattress", "bought", True), (4, "scratch guards", "bought", False), (5, "dog bed", "bought", False)]),
)
def object_candidates(spark, sf_dir):
    rows = [(0, "I bought a new coffee table"), (1, "assembled the bookshelf"), (2, "fixed my wobbly kitchen table"), (3, "ordered a mattress"), (4, "bought scratch guards"), (5, "bought a dog bed for Max"), (6, "saw a desk")]
    return Agg.objects(spark.createDataFrame(rows, "id bigint, text string"), "furniture")


@query(
    "candidate_dedupe",
    "SELECT l_partkey, l_orderkey, l_linenumber FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY l_returnflag = 'N' DESC, l_discount DESC, l_shipdate, l_orderkey * 10 + l_linenumber) = 1",
)
def candidate_dedupe(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").withColumns(
        {"include": F.col("l_returnflag") == "N", "confidence": F.col("l_discount"), "date": F.col("l_shipdate"), "seq": F.col("l_orderkey") * 10 + F.col("l_linenumber")}
    )
    return Agg.best_candidates(rows, ["l_partkey"]).select("l_partkey", "l_orderkey", "l_linenumber")


@query("conflict_pairs", values_sql(["a", "b"], [("f0", "f1"), ("f2", "f3")]))
def conflict_pairs(spark, sf_dir):
    rows = [("f0", "user", "likes", "tea", [1.0, 0.0], 0), ("f1", "User", "dislikes", "tea", [0.0, 1.0], 1), ("f2", "lin", "studies", "law", [1.0, 0.0], 2), ("f3", "lin", "studying", "medicine", [0.8, 0.6], 3), ("f4", "wei", "likes", "tea", [1.0, 0.0], 4)]
    f = spark.createDataFrame([("u", *r) for r in rows], "user_id string, fact_id string, subject string, predicate string, object string, embedding array<double>, seq int")
    return Life.conflict_pairs(f)


@query("reflections", values_sql(["fact_id", "replaced_by", "note"], [("f0", "f1", "moved on")]))
def reflections(spark, sf_dir):
    f = reconcile(spark.createDataFrame(FOLD[:2], FACT))
    return Life.reflect(f, spark.createDataFrame([("e1", "moved on")], "episode_id string, summary string"), 100.0)


def _known(spark):
    return reconcile(extract(_episodes(spark))).withColumn("text", T.fact_text(F.col("subject"), F.col("predicate"), F.col("object")))


QUESTIONS = [
    ("Where does Wei work now?", "hybrid", "Moonshot AI"), ("Where did Wei work before?", "history", "Tencent"), ("How do I rotate the PAT?", "procedural", "open settings, regenerate the token"),
    ("Where does Wei's colleague work?", "multi-hop", "Moonshot AI"), ("What is the capital of France?", "abstain", Context.ABSTAIN),
]


@query("search_cascade", values_sql(["question", "via", "answer"], QUESTIONS))
def search_cascade(spark, sf_dir):
    facts = _known(spark).withColumn("user_id", F.lit("u1"))
    facts = spark.createDataFrame(facts.collect(), facts.schema)  # ten facts of a script, asked five times
    rows = [(q, *Context.search(facts, q, "u1", BASE + 60 * DAY)[:2]) for q, _, _ in QUESTIONS]
    return spark.createDataFrame(rows, "question string, via string, answer string")


@query("as_of_employer", values_sql(["day", "employer"], [(10, "Tencent"), (60, "Moonshot AI")]))
def as_of_employer(spark, sf_dir):
    f = _known(spark).where("subject = 'Wei' AND predicate = 'works_at'")
    out = [Time.as_of(f, BASE + d * DAY).select(F.lit(d).cast("long").alias("day"), F.col("object").alias("employer")) for d in (10, 60)]
    return out[0].unionByName(out[1])


@query("evidence_plan", values_sql(["question", "n_facts", "n_summaries", "n_chunks", "multi_hop"], [("How many books did I read?", 0, 12, 1, False), ("What is my sister's job?", 8, 6, 2, True), ("What's the email address?", 8, 0, 2, False)]))
def evidence_plan(spark, sf_dir):
    rows = []
    for q in ("How many books did I read?", "What is my sister's job?", "What's the email address?"):
        n = Context.plan_evidence(q)
        rows.append((q, n.n_facts, n.n_summaries, n.n_chunks, n.multi_hop))
    return spark.createDataFrame(rows, "question string, n_facts bigint, n_summaries bigint, n_chunks bigint, multi_hop boolean")


@query("budget_pack")
def budget_pack(spark, sf_dir):
    """Documents as evidence blocks of questions, packed into 2000 characters each."""
    d = table(spark, sf_dir, "documents")
    title = F.element_at(T.words("FACTS:", "RELEVANT CONVERSATIONS:", "USER PROFILE:", "TIMELINE:"), (F.col("doc_id") % 4 + 1).cast("int"))
    blocks = d.select((F.col("doc_id") % 97).alias("qid"), F.col("doc_id").alias("seq"), F.concat(title, F.lit("\n"), F.col("text")).alias("block"), F.lit("What is the phone number?").alias("query"))
    return Context.pack_table(blocks, 2000).select("qid", F.length("context").alias("size"), F.md5(F.col("context").cast("binary")).alias("digest"))


@query("hash_embedding")
def hash_embedding(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", Vec.embedder(64)("text").alias("v"))
    return c.select("conv_id", "turn", F.round(Vec.norm(F.col("v")), 9).alias("norm"), F.size("v").alias("dim"))


@query(
    "read_any_format",
    """
    SELECT CASE conv_id % 7 WHEN 4 THEN 's' || conv_id WHEN 5 THEN 'c' || conv_id ELSE 'imported_' || conv_id END AS session_id, role AS speaker, content
    FROM (SELECT conv_id, role, trim(regexp_replace('m' || turn || ' ' || coalesce(text, ''), '[^A-Za-z0-9 ]', ' ', 'g')) AS content FROM conversations)
    WHERE CASE conv_id % 7 WHEN 5 THEN role <> 'system' WHEN 6 THEN role IN ('user', 'assistant') AND length(content) >= 12 ELSE true END
    """,
)
def read_any_format(spark, sf_dir):
    """Conversations as files of seven shapes, every other one with a newline at its end; each is read by what it looks like."""
    said = F.trim(F.regexp_replace(F.concat(F.lit("m"), "turn", F.lit(" "), F.coalesce("text", F.lit(""))), "[^A-Za-z0-9 ]", " "))
    turns = table(spark, sf_dir, "conversations").select("conv_id", F.struct("turn", "role", said.alias("content")).alias("t"))
    files = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    plain = lambda t: F.struct(t["role"].alias("role"), t["content"].alias("content"))
    ids = F.transform("ts", lambda t, i: F.concat(F.lit("n"), i))
    node = lambda t, i: F.struct(
        F.when(i > 0, F.concat(F.lit("n"), i - 1)).alias("parent"), F.struct(F.struct(t["role"].alias("role")).alias("author"), F.struct(F.array(t["content"]).alias("parts")).alias("content")).alias("message")
    )
    logged = lambda t: F.to_json(F.struct(t["role"].alias("type"), F.lit(False).alias("isSidechain"), F.struct(t["role"].alias("role"), t["content"].alias("content")).alias("message")))
    shapes = [
        F.to_json(F.transform("ts", plain)),
        F.array_join(F.transform("ts", lambda t: F.concat(t["role"], F.lit(": "), t["content"])), "\n"),
        F.to_json(F.struct(F.transform("ts", plain).alias("messages"))),
        F.array_join(F.transform("ts", lambda t: F.to_json(plain(t))), "\n"),
        F.to_json(F.transform("ts", lambda t: F.struct(F.concat(F.lit("s"), "conv_id").alias("session_id"), t["role"].alias("role"), t["content"].alias("content")))),
        F.to_json(F.struct(F.concat(F.lit("c"), "conv_id").alias("conversation_id"), F.map_from_arrays(ids, F.transform("ts", node)).alias("mapping"), F.element_at(ids, -1).alias("current_node"))),
        F.array_join(F.transform("ts", logged), "\n"),
    ]
    shape = F.coalesce(*[F.when(F.col("conv_id") % len(shapes) == i, s) for i, s in enumerate(shapes)])
    end = F.when(F.floor(F.col("conv_id") / len(shapes)) % 2 == 0, "\n").otherwise("")
    f = files.select(F.col("conv_id").cast("string").alias("id"), F.concat(shape, end).alias("text"))
    return Conv.read_any(f).select("session_id", "speaker", "content")
