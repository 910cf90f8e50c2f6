"""Queries on texts, vectors and ranked lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest import vocabulary as V
from palimpsest.catalog import query
from palimpsest.functions import text as T
from palimpsest.operators import health as Health
from palimpsest.operators import ranking as R
from palimpsest.plans.common import QUERY, stems_sql
from palimpsest.session import table

Q_TERMS = sorted(set(T.py_stems(QUERY)))
Q_LIST = "[" + ", ".join(f"'{t}'" for t in Q_TERMS) + "]"


def bm25_sql(docs: str = "documents", id_col: str = "doc_id", text_col: str = "text") -> str:
    return f"""
d AS (SELECT {id_col} AS id, {stems_sql(text_col)} AS t FROM {docs}),
c AS (SELECT count(*) AS n, greatest(1.0, avg(len(t))) AS avgdl FROM d),
x AS (SELECT id, len(t) AS dl, unnest(t) AS term FROM d),
tf AS (SELECT id, dl, term, count(*) AS tf FROM x WHERE list_contains({Q_LIST}, term) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
lex AS (SELECT id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.5) / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 9) AS score
        FROM tf JOIN df USING (term), c GROUP BY id)"""


@query("tokenise_stem", f"SELECT doc_id, CAST(len(t) AS INTEGER) AS n_tokens, CAST(len(list_distinct(t)) AS INTEGER) AS n_distinct, md5(array_to_string(t, ' ')) AS digest FROM (SELECT doc_id, {stems_sql('text')} AS t FROM documents)")
def tokenise_stem(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", T.stems(F.col("text")).alias("t"))
    return d.select("doc_id", F.size("t").alias("n_tokens"), F.size(F.array_distinct("t")).alias("n_distinct"), F.md5(F.array_join("t", " ").cast("binary")).alias("digest"))


@query("term_df", f"SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct({stems_sql('text')})) AS term FROM documents) GROUP BY term")
def term_df(spark, sf_dir):
    return R.term_document_counts(table(spark, sf_dir, "documents"))


@query("bm25_topk", f"WITH {bm25_sql()} SELECT id, score FROM lex ORDER BY score DESC, id LIMIT 20")
def bm25_topk(spark, sf_dir):
    return R.bm25(table(spark, sf_dir, "documents"), QUERY, "doc_id").orderBy(F.desc("score"), "id").limit(20)


@query("date_terms", "SELECT event_id, strftime(ts, '%Y-%m-%d %Y %m ') || lower(monthname(ts)) AS terms FROM events")
def date_terms(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", T.date_terms(T.seconds_of("ts")).alias("terms"))


@query("token_overlap", f"SELECT doc_id, CAST(len(list_intersect(list_distinct({stems_sql('text')}), {Q_LIST})) AS INTEGER) AS overlap FROM documents")
def token_overlap(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.size(T.overlap_terms(F.lit(QUERY), F.col("text"))).alias("overlap"))


@query(
    "snippet_best_sentence",
    f"""WITH s AS (SELECT doc_id, unnest(list_filter(list_transform(regexp_split_to_array(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(10), 'g'), '\\n+'), lambda x: trim(x)), lambda x: x <> '')) AS s,
  generate_subscripts(list_filter(list_transform(regexp_split_to_array(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(10), 'g'), '\\n+'), lambda x: trim(x)), lambda x: x <> ''), 1) AS i FROM documents),
n AS (SELECT doc_id, s, i, len(list_intersect(list_distinct({stems_sql('s')}), {Q_LIST})) AS n FROM s)
SELECT doc_id, left(arg_max(s, n * 1000000 - i), 360) AS snippet FROM n GROUP BY doc_id""",
)
def snippet_best_sentence(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.best_snippet(F.col("text"), F.lit(QUERY)).alias("snippet")).where("snippet IS NOT NULL")


def _any_sql(hay: str, marks) -> str:
    return "(" + " OR ".join(f"contains({hay}, '{m}')" for m in marks) + ")"


@query(
    "classify_sensitive",
    "WITH h AS (SELECT doc_id, lower('note ' || text || ' ' || source) AS hay, text FROM documents) SELECT doc_id, CASE "
    + " ".join(f"WHEN {_any_sql('hay', marks)} THEN '{name}'" for name, marks in V.CATEGORIES)
    + f" ELSE '{V.OTHER}' END AS category, {_any_sql('hay', V.SENSITIVE_WORDS)} OR regexp_matches(text, '\\b\\d{{6,}}\\b') AS sensitive FROM h",
)
def classify_sensitive(spark, sf_dir):
    args = (F.lit("note"), F.col("text"), F.col("source"))
    d = table(spark, sf_dir, "documents").withColumn("hay", T.haystack(*args))
    return d.select("doc_id", T.category(*args, hay=F.col("hay")).alias("category"), T.sensitive(*args, hay=F.col("hay")).alias("sensitive"))


@query(
    "secret_redaction",
    "SELECT doc_id, md5("
    + "regexp_replace(" * 6
    + "text"
    + "".join(f", '{p}', '[REDACTED]', 'g')" for p in V.SECRET_SHAPES)
    + ", '(?i)"
    + V.SECRET_ASSIGNMENT.replace("'", "''")
    + "', '\\1[REDACTED]', 'g')) AS digest FROM documents",
)
def secret_redaction(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.redact_secrets(F.col("text")).cast("binary")).alias("digest"))


@query(
    "doc_kind",
    "SELECT page_id, CASE WHEN regexp_matches(lower(regexp_extract(url, '(\\.[^./\\\\]*)$', 1)), '^\\.(png|jpg|jpeg|webp|gif|bmp)$') THEN 'image' WHEN lower(regexp_extract(url, '(\\.[^./\\\\]*)$', 1)) = '.pdf' THEN 'pdf' "
    "WHEN lower(regexp_extract(url, '(\\.[^./\\\\]*)$', 1)) = '.docx' THEN 'docx' ELSE 'text' END AS kind FROM pages",
)
def doc_kind(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", T.document_kind(F.hex(F.substring("html", 1, 8)), F.col("url"), F.lit("text/html")).alias("kind"))


@query(
    "token_estimate",
    "SELECT conv_id, turn, CAST(len(regexp_extract_all(text, '[一-鿿]')) + len(regexp_extract_all(regexp_replace(text, '[一-鿿]', ' ', 'g'), '[A-Za-z0-9]+')) AS INTEGER) AS tokens FROM conversations",
)
def token_estimate(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.tokens_cjk(F.col("text")).alias("tokens"))


@query("route_scope", f"SELECT conv_id, turn, CASE WHEN {_any_sql('lower(text)', V.EPHEMERAL_MARKS)} THEN 'working' ELSE 'long' END AS scope FROM conversations")
def route_scope(spark, sf_dir):
    from palimpsest.operators.lifecycle import route

    c = table(spark, sf_dir, "conversations").withColumnRenamed("text", "content")
    return route(c).select("conv_id", "turn", "scope")


@query(
    "summary_excerpt",
    "SELECT conv_id, turn, left(trim(regexp_replace(text, '\\s+', ' ', 'g')), 400) AS summary FROM conversations",
)
def summary_excerpt(spark, sf_dir):
    from palimpsest.operators.lifecycle import summarise

    c = table(spark, sf_dir, "conversations").withColumnRenamed("text", "content").withColumn("summary", F.lit(None).cast("string"))
    return summarise(c).select("conv_id", "turn", "summary")


@query(
    "embedder_blindness",
    """WITH l AS (SELECT length(regexp_replace(text, '[^\\p{L}]', '', 'g')) AS l, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS a FROM documents),
b AS (SELECT l, l - a AS o, l > 0 AND (l - a) / l >= 0.5 AS b FROM l),
s AS (SELECT count(*) AS texts, count(*) FILTER (WHERE b) AS blind_texts, CAST(sum(l) AS BIGINT) AS letters, CAST(sum(CASE WHEN b THEN o ELSE 0 END) AS BIGINT) AS blind_letters FROM b)
SELECT *, blind_letters >= 200 AND blind_texts >= 0.2 * texts AS blind FROM s""",
)
def embedder_blindness(spark, sf_dir):
    return Health.embedder_blindness(table(spark, sf_dir, "documents"), "text")


@query(
    "vector_topk",
    "WITH q AS (SELECT list_transform(embedding, lambda x: x::DOUBLE) AS q FROM embeddings WHERE vec_id = 0) SELECT vec_id, round(list_cosine_similarity(list_transform(embedding, lambda x: x::DOUBLE), q), 9) AS score FROM embeddings, q ORDER BY score DESC, vec_id LIMIT 25",
)
def vector_topk(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return R.vector_top_k(e, _first_vector(e), 25, "embedding", "vec_id")


@query(
    "vector_topk_filtered",
    "WITH q AS (SELECT list_transform(embedding, lambda x: x::DOUBLE) AS q FROM embeddings WHERE vec_id = 0) SELECT vec_id, round(list_cosine_similarity(list_transform(embedding, lambda x: x::DOUBLE), q), 9) AS score FROM embeddings, q WHERE label = 3 ORDER BY score DESC, vec_id LIMIT 25",
)
def vector_topk_filtered(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return R.vector_top_k(e, _first_vector(e), 25, "embedding", "vec_id", F.col("label") == 3)


def _first_vector(e) -> list[float]:
    return list(e.where("vec_id = 0").select("embedding").first()[0])


@query(
    "near_pairs_theta",
    "WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), p AS (SELECT a.label, a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.e, b.e), 9) AS similarity FROM v a JOIN v b ON a.label = b.label AND a.vec_id < b.vec_id) SELECT * FROM p WHERE similarity BETWEEN 0.25 AND 0.94",
)
def near_pairs_theta(spark, sf_dir):
    return R.near_pairs(table(spark, sf_dir, "embeddings"), "label", "vec_id", "embedding", 0.25, 0.94)


RANKED_SQL = f"""{bm25_sql()},
s AS (SELECT 'lex' AS signal, id, score FROM lex WHERE score > 0
      UNION ALL SELECT 'rec', doc_id, exp(-doc_id / 1000.0) FROM documents
      UNION ALL SELECT 'sal', doc_id, n_chars / 1000.0 FROM documents),
r AS (SELECT signal, id, row_number() OVER (PARTITION BY signal ORDER BY score DESC, id) AS rank FROM s)"""


def _signals(spark, sf_dir):
    """Words found, and two priors that rank every document."""
    d = table(spark, sf_dir, "documents")
    lex = R.bm25(d, QUERY, "doc_id").where("score > 0").select(F.lit("lex").alias("signal"), "id", "score")
    rec = d.select(F.lit("rec").alias("signal"), F.col("doc_id").alias("id"), F.exp(-F.col("doc_id") / 1000.0).alias("score"))
    sal = d.select(F.lit("sal").alias("signal"), F.col("doc_id").alias("id"), (F.col("n_chars") / 1000.0).alias("score"))
    return R.rank_by(lex.unionByName(rec).unionByName(sal), by=("signal",), spread=True)


FUSED_SQL = "f AS (SELECT id, round(sum(CASE signal WHEN 'lex' THEN 0.6 WHEN 'rec' THEN 0.3 ELSE 0.25 END / (60 + rank)), 12) AS fused FROM r GROUP BY id)"


@query("rrf_fusion", f"WITH {RANKED_SQL}, {FUSED_SQL} SELECT id, fused FROM f")
def rrf_fusion(spark, sf_dir):
    return R.weighted_rrf(_signals(spark, sf_dir), {"lex": 0.6, "rec": 0.3, "sal": 0.25})


@query("hybrid_topk", f"WITH {RANKED_SQL}, {FUSED_SQL} SELECT id, fused FROM f ORDER BY fused DESC, id LIMIT 10")
def hybrid_topk(spark, sf_dir):
    return rrf_fusion(spark, sf_dir).orderBy(F.desc("fused"), "id").limit(10)


@query("minmax_scale", "SELECT doc_id AS id, round(CASE WHEN max(n_chars) OVER w - min(n_chars) OVER w < 1e-12 THEN 1 ELSE (n_chars - min(n_chars) OVER w) / (max(n_chars) OVER w - min(n_chars) OVER w) END, 9) AS scaled FROM documents WINDOW w AS (PARTITION BY lang)")
def minmax_scale(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "lang", F.col("n_chars").alias("score"))
    return R.minmax(d, by=("lang",)).select("id", F.round("scaled", 9).alias("scaled"))


@query(
    "rank_interleave",
    f"WITH {RANKED_SQL}, l AS (SELECT id, rank, CASE signal WHEN 'lex' THEN 0 WHEN 'rec' THEN 1 ELSE 2 END AS list_no FROM r), b AS (SELECT id, min((rank, list_no)) AS m FROM l GROUP BY id) SELECT id, m[1] AS rank, CAST(m[2] AS INTEGER) AS list_no FROM b ORDER BY m LIMIT 30",
)
def rank_interleave(spark, sf_dir):
    no = F.when(F.col("signal") == "lex", 0).when(F.col("signal") == "rec", 1).otherwise(2)
    return R.interleave(_signals(spark, sf_dir).select("id", F.col("rank").cast("long").alias("rank"), no.alias("list_no")), 30)


@query(
    "promotion_merge",
    f"WITH {RANKED_SQL}, l AS (SELECT id, CASE WHEN signal = 'lex' AND rank <= 5 THEN 0 WHEN signal = 'rec' THEN 1 ELSE 2 END AS tier, rank FROM r WHERE signal IN ('lex', 'rec')), b AS (SELECT id, min((tier, rank)) AS m FROM l GROUP BY id) SELECT id, CAST(m[1] AS INTEGER) AS tier, m[2] AS rank FROM b ORDER BY m LIMIT 10",
)
def promotion_merge(spark, sf_dir):
    s = _signals(spark, sf_dir).withColumn("rank", F.col("rank").cast("long"))
    return R.promote(s.where("signal = 'lex'"), s.where("signal = 'rec'"), 10)


@query("episode_topk", f"WITH d0 AS (SELECT conv_id * 1000 + turn AS k, text FROM conversations), {bm25_sql('d0', 'k', 'text')} SELECT id, score FROM lex ORDER BY score DESC, id LIMIT 12")
def episode_topk(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("k"), "text")
    return R.bm25(c, QUERY, "k").orderBy(F.desc("score"), "id").limit(12)


@query("paging", "SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 50 OFFSET 100")
def paging(spark, sf_dir):
    return R.page(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), [F.desc("n_chars"), "doc_id"], 100, 50)[0]


@query(
    "answer_in_context",
    "SELECT conv_id, turn, contains(lower(text), 'the') AS hit FROM conversations",
)
def answer_in_context(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.answer_in_context(F.col("text"), F.lit("the")).alias("hit"))


def _asked(spark, sf_dir):
    """Benchmark passages as questions, documents as facts of the user that their source is."""
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.concat(F.lit("src"), F.col("item_id") % 20).alias("user_id"), F.col("text").alias("query"))
    d = table(spark, sf_dir, "documents").select(
        F.col("source").alias("user_id"), F.col("doc_id").alias("fact_id"), "text", (F.col("doc_id") * 86400.0).alias("valid_at"), F.col("n_chars").alias("salience")
    )
    return q, d


@query(
    "question_facts",
    f"""WITH q AS (SELECT item_id AS qid, 'src' || item_id % 20 AS u, list_distinct({stems_sql('text')}) AS qs FROM benchmark),
d AS (SELECT source AS u, doc_id AS id, {stems_sql('text')} AS t, n_chars FROM documents),
c AS (SELECT u, count(*) AS n, greatest(1.0, avg(len(t))) AS avgdl FROM d GROUP BY u),
x AS (SELECT u, id, len(t) AS dl, unnest(t) AS term FROM d), tf AS (SELECT u, id, dl, term, count(*) AS tf FROM x GROUP BY ALL), df AS (SELECT u, term, count(*) AS df FROM tf GROUP BY ALL),
p AS (SELECT u, id, term, ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.5) / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl)) AS part FROM tf JOIN df USING (u, term) JOIN c USING (u)),
a AS (SELECT qid, u, unnest(qs) AS term FROM q), h AS (SELECT qid, id, round(sum(part), 9) AS score FROM a JOIN p USING (u, term) GROUP BY qid, id),
l AS (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS lex FROM h),
s AS (SELECT u, id, 0.3 / (60 + row_number() OVER (PARTITION BY u ORDER BY id DESC)) + 0.25 / (60 + row_number() OVER (PARTITION BY u ORDER BY n_chars DESC, id)) AS s FROM d),
f AS (SELECT q.qid, s.id, round(s + coalesce(0.6 / (60 + lex), 0), 12) AS fused FROM q JOIN s USING (u) LEFT JOIN l ON l.qid = q.qid AND l.id = s.id),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY fused DESC, id) AS rank FROM f)
SELECT qid, id AS fact_id, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 15""",
)
def question_facts(spark, sf_dir):
    from palimpsest.operators import context as Context

    return Context.question_facts(*_asked(spark, sf_dir)).select("qid", "fact_id", "rank")


@query("question_contexts")
def question_contexts(spark, sf_dir):
    """The contexts of all questions at once; documents are the episodes behind the facts."""
    from palimpsest.operators import context as Context

    q, d = _asked(spark, sf_dir)
    episodes = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("episode_id"), F.col("text").alias("content"))
    out = Context.question_contexts(q, d.withColumn("provenance", F.array("fact_id")), episodes, 2000)
    return out.select("qid", F.length("context").alias("size"), F.md5(F.col("context").cast("binary")).alias("digest"))
