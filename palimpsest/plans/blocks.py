"""Queries on evidence: provenance, browsing, spaces, display, model output."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest import vocabulary as V
from palimpsest.catalog import query
from palimpsest.functions import text as T
from palimpsest.operators import blocks as B
from palimpsest.operators import models as M
from palimpsest.operators.ordering import spread_rank
from palimpsest.plans.common import AS_OF, FACTS_SQL, QUERY, event_facts, stems_sql, values_sql
from palimpsest.plans.text import Q_LIST, bm25_sql, bm25_topk
from palimpsest.session import table


@query(
    "provenance_best",
    f"""WITH f AS (SELECT doc_id AS fact_id, n_chars AS rank, 'the ' || source AS text, doc_id % (SELECT count(*) FROM conversations) AS e FROM documents),
c AS (SELECT conv_id * 1000 + turn AS e0, row_number() OVER (ORDER BY conv_id, turn) - 1 AS e, text AS content, conv_id * 86400.0::DOUBLE + turn AS event_time FROM conversations),
j AS (SELECT f.*, c.e0, c.content, c.event_time, len(list_intersect({Q_LIST}, list_distinct({stems_sql('f.text')}))) AS a FROM f JOIN c ON f.e = c.e),
s AS (SELECT *, 8 * a + 3 * len(list_intersect(list_distinct({stems_sql('text')}), list_distinct({stems_sql('content')}))) + 2 * len(list_intersect({Q_LIST}, list_distinct({stems_sql('content')}))) AS score FROM j WHERE a > 0),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY e0 ORDER BY score DESC, rank) = 1)
SELECT e0 AS episode_id, fact_id, CAST(score AS INTEGER) AS score FROM b ORDER BY score DESC, rank, event_time DESC, e0 LIMIT 12""",
)
def provenance_best(spark, sf_dir):
    """Documents as ranked facts, each told of by one turn of a conversation."""
    c = table(spark, sf_dir, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("episode_id"), F.col("text").alias("content"), (F.col("conv_id") * 86400.0 + F.col("turn")).alias("event_time")
    )
    no = spread_rank(c.select("episode_id"), [F.asc("episode_id")], out="e").withColumn("e", F.col("e") - 1)
    turns = c.count()
    f = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("fact_id"), F.col("n_chars").alias("rank"), F.concat(F.lit("the "), "source").alias("text"), (F.col("doc_id") % turns).alias("e"))
    facts = f.join(no, "e").select("fact_id", "rank", "text", F.array("episode_id").alias("provenance"))
    return B.provenance(facts, c, QUERY, 12).select("episode_id", "fact_id", "score")


@query(
    "browse_facts",
    f"WITH {FACTS_SQL} SELECT event_id AS fact_id FROM facts WHERE NOT (ts_s <= {AS_OF} AND (invalid_at IS NULL OR invalid_at > {AS_OF})) AND contains(lower(event_type || ' ' || user_id), 'view 1') AND event_id % 5 <> 0",
)
def browse_facts(spark, sf_dir):
    f = event_facts(spark, sf_dir).withColumns({"text": F.concat_ws(" ", "predicate", "user_id"), "sensitive": F.col("fact_id") % 5 == 0})
    return B.browse(f, AS_OF, "superseded", "attributes", "VIEW 1").select("fact_id")


@query("readable_spaces", f"WITH {FACTS_SQL} SELECT CAST(user_id AS VARCHAR) AS user_id, count(*) AS n FROM facts WHERE user_id IN (1, 3, 4) GROUP BY 1")
def readable_spaces(spark, sf_dir):
    return B.readable(event_facts(spark, sf_dir), "1", ["3", "4"]).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


@query("head_and_tail", "SELECT doc_id, md5(CASE WHEN length(text) <= 1000 THEN text ELSE left(text, 350) || chr(10) || '…' || chr(10) || right(text, 650) END) AS digest FROM documents")
def head_and_tail(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(B.head_and_tail(F.col("text"), 1000).cast("binary")).alias("digest"))


SHOWN = [
    ("user", "likes", "火锅", "", "喜欢 火锅"), ("王伟", "works_at", "月之暗面", "", "王伟在 月之暗面 工作"), ("i", "favorite_food", "面条", "", "最喜欢的食物是 面条"),
    ("Wei", "works_at", "Tencent", "", "Wei works at Tencent"), ("Wei", "likes", "tea", "Wei likes green tea", "Wei likes green tea"), ("我", "rides_to", "公司", "", "rides to 公司"),
]


@query("display_text", values_sql(["subject", "object", "shown"], [(s, o, d) for s, _, o, _, d in SHOWN]))
def display_text(spark, sf_dir):
    df = spark.createDataFrame([r[:4] for r in SHOWN], "subject string, predicate string, object string, text string")
    return df.select("subject", "object", T.display(*[F.col(c) for c in ("subject", "predicate", "object", "text")]).alias("shown"))


@query("outcome_parts", values_sql(["statement", "why"], [("ship on Friday", "tests pass"), ("no grounds", "")]))
def outcome_parts(spark, sf_dir):
    df = spark.createDataFrame([("ship on Friday （依据：tests pass）",), ("no grounds ",)], "t string")
    return df.select(T.outcome_parts(F.col("t")).alias("p")).select("p.*")


@query("final_answers", values_sql(["id", "answer"], [(0, "Paris"), (1, "no mark here\nat all"), (2, "42")]))
def final_answers(spark, sf_dir):
    rows = [(0, "Let me think. ANSWER: Rome\nANSWER: Paris\nbye"), (1, "no mark here\nat all"), (2, "answer : 42")]
    return spark.createDataFrame(rows, "id bigint, t string").select("id", T.extract_answer(F.col("t")).alias("answer"))


def _shape_sql(kind: str) -> str:
    x = "lower(o)" if kind == "date" else "o"
    pattern = V.ANSWER_SHAPES[kind].replace("'", "''")
    return f"regexp_matches({x}, '{pattern}')" + (" AND length(trim(o)) <= 40 AND NOT contains(trim(o), ' ')" if kind == "id" else "")


ASKED = (("what's the project ID?", "id"), ("which email address?", "email"), ("how many cats?", "number"))


@query(
    "answer_types",
    "WITH w AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN source || '-' || n_chars WHEN 1 THEN source || '@' || lang || '.example.org' WHEN 2 THEN n_chars || ' cats' ELSE 'Wei' END AS o FROM documents) "
    + " UNION ALL ".join("SELECT doc_id, '{}' AS question, '{}' AS kind FROM w WHERE {}".format(q.replace("'", "''"), k, _shape_sql(k)) for q, k in ASKED),
)
def answer_types(spark, sf_dir):
    """What fits each of three questions, of objects made from the columns of documents."""
    no = F.col("doc_id") % 4
    obj = F.when(no == 0, F.concat_ws("-", "source", "n_chars")).when(no == 1, F.concat("source", F.lit("@"), "lang", F.lit(".example.org"))).when(no == 2, F.concat("n_chars", F.lit(" cats"))).otherwise("Wei")
    objs = table(spark, sf_dir, "documents").select("doc_id", obj.alias("o"))
    parts = [objs.where(T.of_answer_type(F.col("o"), T.answer_type(q))).select("doc_id", F.lit(q).alias("question"), F.lit(T.answer_type(q)).alias("kind")) for q, _ in ASKED]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("cached_answers", "SELECT text AS prompt, CAST(length(text) AS VARCHAR) AS answer FROM benchmark")
def cached_answers(spark, sf_dir):
    p = table(spark, sf_dir, "benchmark").select(F.col("text").alias("prompt"))
    return M.complete(p, lambda x: str(len(x)))[0].select("prompt", "answer")


@query("rerank_topk", f"WITH {bm25_sql()}, k AS (SELECT id FROM lex ORDER BY score DESC, id LIMIT 20) SELECT id, CAST(row_number() OVER (ORDER BY length(text), id) AS INTEGER) AS rank FROM k JOIN documents ON doc_id = id ORDER BY rank LIMIT 5")
def rerank_topk(spark, sf_dir):
    """BM25 candidates re-scored by a model that likes short texts."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    c = bm25_topk(spark, sf_dir).select("id").join(d, "id").select(F.lit(1).alias("qid"), F.lit(QUERY).alias("query"), "id", "text")
    return M.rerank(c, lambda q, t: -len(t), 5).select("id", "rank")


@query("preference_order", f"WITH {FACTS_SQL} SELECT event_id AS fact_id FROM facts WHERE event_type IN ('click', 'view') AND invalid_at IS NULL ORDER BY event_type <> 'view', ts_s DESC, event_id LIMIT 24")
def preference_order(spark, sf_dir):
    f = event_facts(spark, sf_dir).where("invalid_at IS NULL").withColumn("object", F.col("predicate"))
    f = f.withColumn("predicate", F.when(F.col("object").isin("click", "view"), F.lit("likes")).otherwise("did"))
    return B.preferences(f, "which view?", 24).select("fact_id")
