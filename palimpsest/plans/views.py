"""Queries on small functions and views: forms of text, masks, identities, edges, access, haystacks."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest import vocabulary as V
from palimpsest.catalog import query
from palimpsest.functions import text as T
from palimpsest.operators.aggregates import ACTIONS
from palimpsest.operators import aggregates as Agg
from palimpsest.operators import blocks as B
from palimpsest.operators import graph as G
from palimpsest.operators import health as Health
from palimpsest.operators import lifecycle as Life
from palimpsest.operators import temporal as Time
from palimpsest.plans.common import AS_OF, FACTS_SQL, QUERY, event_facts, stems_sql
from palimpsest.session import table


def _list(words) -> str:
    return "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + ")"


PREDICATES = "CASE event_id % 4 WHEN 0 THEN 'Likes' WHEN 1 THEN 'works_at' WHEN 2 THEN 'favorite_song' ELSE event_type END"


@query(
    "fact_forms",
    f"""WITH p AS (SELECT *, {PREDICATES} AS p FROM events)
SELECT event_id, trim(user_id || ' ' || replace(p, '_', ' ') || ' ' || event_id) AS text, strftime(ts + INTERVAL 8 HOUR, '%Y-%m-%d %H:%M:%S') AS at, strftime(ts, '%Y-%m-%d') AS day,
CASE WHEN lower(p) IN {_list(V.PREFERENCE_PREDICATES)} OR starts_with(lower(p), 'favorite') THEN 1.25::DOUBLE WHEN lower(p) IN {_list(V.IDENTITY_PREDICATES)} THEN 1.15::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM p""",
)
def fact_forms(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    no = F.col("event_id") % 4
    p = F.when(no == 0, "Likes").when(no == 1, "works_at").when(no == 2, "favorite_song").otherwise(F.col("event_type"))
    at = T.seconds_of("ts")
    return e.select("event_id", T.fact_text(F.col("user_id"), p, F.col("event_id")).alias("text"), T.epoch_datetime_east8(at).alias("at"), T.epoch_date(at).alias("day"), T.type_weight(p).alias("weight"))


@query("normal_predicates", "SELECT DISTINCT o_orderpriority AS raw, regexp_replace(replace(replace(lower(trim(o_orderpriority)), '-', ' '), '/', ' '), '\\s+', '_', 'g') AS predicate FROM orders")
def normal_predicates(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("raw"), T.normal_predicate(F.col("o_orderpriority")).alias("predicate")).distinct()


@query("token_estimates", "SELECT doc_id, CAST(greatest(1, length(text) // 4) AS BIGINT) AS by_chars, CAST(len(regexp_extract_all(text, '[一-鿿]')) + len(regexp_extract_all(regexp_replace(text, '[一-鿿]', ' ', 'g'), '[A-Za-z0-9]+')) AS BIGINT) AS by_words FROM documents WHERE text IS NOT NULL")
def token_estimates(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    return d.select("doc_id", T.tokens_by_chars(F.col("text")).cast("long").alias("by_chars"), T.tokens_cjk(F.col("text")).cast("long").alias("by_words"))


@query(
    "value_mentions",
    f"""WITH v AS (SELECT DISTINCT doc_id, unnest(string_split(text, ' ')) AS x FROM documents WHERE text IS NOT NULL), s AS (SELECT *, lower(trim(x)) AS v, {stems_sql('x')} AS s FROM v), q AS (SELECT {stems_sql("'" + QUERY + "'")} AS qs)
SELECT doc_id, x AS value FROM s, q WHERE v <> '' AND (contains(lower('{QUERY}'), v) OR (len(s) > 0 AND len(list_filter(s, lambda t: NOT list_contains(qs, t))) = 0))""",
)
def value_mentions(spark, sf_dir):
    """The values of each document, its words, that the question holds, as text or as whole words."""
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    values = d.select("doc_id", F.explode(F.array_distinct(F.split("text", " "))).alias("value"))
    return values.where(T.mentions_value(F.lit(QUERY), F.col("value")))


@query("redacted_view", f"WITH {FACTS_SQL} SELECT event_id AS fact_id, CASE WHEN event_type = 'purchase' THEN '[redacted]' ELSE event_type END AS object, CASE WHEN event_type = 'purchase' THEN '[redacted]' ELSE user_id || ' ' || event_id END AS text FROM facts")
def redacted_view(spark, sf_dir):
    f = event_facts(spark, sf_dir).withColumns({"object": F.col("predicate"), "text": F.concat_ws(" ", "user_id", "fact_id"), "sensitive": F.col("predicate") == "purchase"})
    return Health.redacted(f).select("fact_id", "object", "text")


@query(
    "duration_evidence",
    r"""WITH s AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(regexp_replace(text, '([.!?])\s+', '\1' || chr(10), 'g'), '\n+'), lambda x: trim(x)), lambda x: x <> '') AS ss FROM documents WHERE text IS NOT NULL),
x AS (SELECT doc_id, unnest(ss) AS sentence, generate_subscripts(ss, 1) AS pos FROM s),
a AS (SELECT *, unnest(['the', 'of']) AS anchor FROM x WHERE regexp_matches(lower(sentence), '\b(and|end)'))
SELECT anchor, doc_id, md5(arg_min(sentence, pos)) AS digest FROM a WHERE contains(lower(sentence), anchor) GROUP BY anchor, doc_id""",
)
def duration_evidence(spark, sf_dir):
    eps = table(spark, sf_dir, "documents").where("text IS NOT NULL").select(F.col("doc_id").alias("episode_id"), F.lit(0.0).alias("event_time"), F.col("text").alias("content"))
    return Time.duration_evidence(eps, ["the", "of"], r"(?i)\b(and|end)").select("anchor", F.col("episode_id").alias("doc_id"), F.md5(F.col("sentence").cast("binary")).alias("digest"))


@query(
    "canonical_facts",
    f"WITH {FACTS_SQL}, u AS (SELECT DISTINCT user_id FROM events), r AS (SELECT user_id, min('u' || user_id) OVER (PARTITION BY user_id % 7) AS c FROM u) SELECT c AS user_id, count(*) AS n, count(DISTINCT facts.user_id) AS handles FROM facts JOIN r USING (user_id) GROUP BY c",
)
def canonical_facts(spark, sf_dir):
    """Users whose numbers leave one rest by seven are one person, told of in a chain of links."""
    from pyspark.sql import Window as W

    u = table(spark, sf_dir, "events").select("user_id").distinct()
    prev = F.lag("user_id").over(W.partitionBy(F.col("user_id") % 7).orderBy("user_id"))
    links = u.select(F.concat(F.lit("u"), prev).alias("a"), F.concat(F.lit("u"), "user_id").alias("b")).where("a IS NOT NULL")
    f = event_facts(spark, sf_dir).withColumns({"user_id": F.concat(F.lit("u"), "user_id"), "subject": F.col("user_id")})
    got = G.canonical(f, G.identity_roots(links))
    return got.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("subject").alias("handles"))


@query("touching_facts", f"WITH {FACTS_SQL} SELECT event_id AS fact_id FROM facts WHERE user_id IN (3, 5) OR event_type = 'signup'")
def touching_facts(spark, sf_dir):
    f = event_facts(spark, sf_dir).withColumn("object", F.col("predicate"))
    return G.touching(f, spark.createDataFrame([("3",), ("5",), ("signup",), ("nobody",)], "node string")).select("fact_id")


def _event_edges(spark, sf_dir):
    f = event_facts(spark, sf_dir)
    return f.select("fact_id", F.lit("u").alias("user_id"), F.concat(F.lit("u"), "user_id").alias("src"), F.col("predicate").alias("dst"), "valid_at", "invalid_at")


@query("invalidated_edges", f"WITH {FACTS_SQL} SELECT event_id AS fact_id, CASE WHEN event_id % 5 = 0 THEN coalesce(invalid_at, {AS_OF}) ELSE invalid_at END AS invalid_at FROM facts")
def invalidated_edges(spark, sf_dir):
    e = _event_edges(spark, sf_dir)
    return G.invalidate_edges(e, e.where("fact_id % 5 = 0"), AS_OF).select("fact_id", "invalid_at")


@query(
    "pruned_graph",
    f"WITH {FACTS_SQL}, r AS (SELECT * FROM facts WHERE user_id % 3 <> 0 AND event_type <> 'error'), k AS (SELECT 'u' || user_id AS key FROM r UNION SELECT event_type FROM r) SELECT 'entity' AS kind, count(*) AS n FROM k UNION ALL SELECT 'edge', count(*) FROM r",
)
def pruned_graph(spark, sf_dir):
    e = _event_edges(spark, sf_dir)
    ents = e.select("user_id", F.col("src").alias("key")).union(e.select("user_id", "dst")).distinct()
    left, rest = G.prune(ents, e, e.where("cast(substring(src, 2) as int) % 3 = 0 OR dst = 'error'"))
    return left.agg(F.count(F.lit(1)).alias("n")).select(F.lit("entity").alias("kind"), "n").union(rest.agg(F.count(F.lit(1)).alias("n")).select(F.lit("edge").alias("kind"), "n"))


@query(
    "space_access",
    """SELECT o_orderkey, CASE WHEN o_custkey NOT IN (SELECT c_custkey FROM customer) THEN false WHEN 's' || o_orderkey % 10 = 's' || o_custkey % 10 THEN true
WHEN o_orderstatus = 'F' THEN o_orderkey % 10 = 3 ELSE o_orderkey % 10 IN (1, 2, 3) END AS ok FROM orders""",
)
def space_access(spark, sf_dir):
    """Customers have a home of their own, may read s1 and s2, and write s3; orders ask, the finished ones to write."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("principal"), F.concat(F.lit("s"), F.col("c_custkey") % 10).alias("home"), T.words("s1", "s2").alias("readable"), T.words("s3").alias("writable"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("principal"), F.concat(F.lit("s"), F.col("o_orderkey") % 10).alias("space"), F.when(F.col("o_orderstatus") == "F", "write").otherwise("read").alias("mode"))
    return B.allowed(o, c).select("o_orderkey", "ok")


@query(
    "haystacks",
    """WITH s AS (SELECT conv_id % 10 AS qid, conv_id, string_agg('[' || role || '] ' || coalesce(text, ''), chr(10) ORDER BY turn) AS b FROM conversations GROUP BY conv_id)
SELECT qid, md5(left(string_agg(b, chr(10) ORDER BY conv_id DESC), 5000)) AS digest FROM s GROUP BY qid""",
)
def haystacks(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    m = c.select((F.col("conv_id") % 10).alias("qid"), F.col("conv_id").alias("session_id"), F.col("conv_id").cast("double").alias("event_time"), F.col("turn").alias("pos"), "role", F.col("text").alias("content"))
    return B.haystack(m, "qid", 5000, newest_first=True).select("qid", F.md5(F.col("text").cast("binary")).alias("digest"))


@query(
    "exported_graph",
    f"""WITH {FACTS_SQL}, e AS (SELECT event_id, user_id, event_type, {AS_OF} >= ts_s AND (invalid_at IS NULL OR invalid_at > {AS_OF}) AS live FROM facts WHERE event_type <> 'decision'),
w AS (SELECT *, bool_or(live) OVER (PARTITION BY user_id, event_type) AS any_live FROM e) SELECT event_id AS fact_id, live FROM w WHERE live OR NOT any_live""",
)
def exported_graph(spark, sf_dir):
    """A dead edge stays only where its user has no live one of the kind."""
    f = event_facts(spark, sf_dir).withColumn("object", F.col("predicate"))
    return G.export_graph(f, AS_OF).select("fact_id", "live")


@query(
    "evidence_snippets",
    "WITH t AS (SELECT doc_id * 1.0::DOUBLE AS date, trim(regexp_replace(CASE WHEN doc_id % 6 = 0 THEN 'user: I bought ' WHEN doc_id % 6 = 1 THEN 'we ordered ' ELSE '' END || text, '\\s+', ' ', 'g')) AS x, doc_id % 2 + 1 AS bonus FROM documents WHERE text IS NOT NULL), "
    "s AS (SELECT date, left(x, 500) AS x, len(list_intersect(list_distinct(regexp_extract_all(lower(x), '[a-z0-9]+')), ['how', 'many', 'the', 'and', 'things', 'bought'])) + bonus"
    + "".join(" + CASE WHEN regexp_matches(lower(x), '{}') THEN 4 ELSE 0 END".format(p.replace("'", "''")) for _, p in ACTIONS)
    + " + CASE WHEN contains(lower(x), 'user:') THEN 1 ELSE 0 END AS score FROM t), r AS (SELECT *, row_number() OVER (ORDER BY score DESC, date, x) - 1 AS n FROM s) SELECT 'E' || n AS source_id, date, md5(x) AS digest FROM r WHERE n < 60",
)
def evidence_snippets(spark, sf_dir):
    no = F.col("doc_id") % 6
    head = F.when(no == 0, "user: I bought ").when(no == 1, "we ordered ").otherwise("")
    said = table(spark, sf_dir, "documents").where("text IS NOT NULL").select(F.col("doc_id").cast("double").alias("date"), F.concat(head, F.col("text")).alias("text"), (F.col("doc_id") % 2 + 1).alias("bonus"))
    got = Agg.evidence_snippets(said, "how many of the things and bought")
    return got.select("source_id", "date", F.md5(F.col("text").cast("binary")).alias("digest"))


@query(
    "user_edits",
    f"""WITH {FACTS_SQL}, l AS (SELECT min(event_id) AS one, max(event_id) AS last FROM facts)
SELECT event_id AS fact_id, CASE WHEN event_id = one THEN 'corrected' ELSE event_type END AS object, CASE WHEN event_id = one THEN 'user' ELSE 'extracted' END AS source,
CASE WHEN event_id = one THEN NULL WHEN event_id = last THEN coalesce(invalid_at, {AS_OF}) ELSE invalid_at END AS invalid_at FROM facts, l WHERE event_id % 10 <> 7""",
)
def user_edits(spark, sf_dir):
    """The first fact is corrected, the last loses a conflict, and each that ends in 7 is deleted."""
    f = event_facts(spark, sf_dir)
    f = f.withColumns({"object": F.col("predicate"), "text": F.col("predicate"), "category": F.lit(""), "sensitive": F.lit(False)})
    r = f.agg(F.min("fact_id").alias("a"), F.max("fact_id").alias("b")).first()
    f = Life.resolve_conflict(Life.edit_fact(f, r["a"], object="corrected"), r["b"], r["a"], "newer", AS_OF)
    return Life.delete_facts(f, f.where("fact_id % 10 = 7")).select("fact_id", "object", "source", "invalid_at")


@query(
    "cleared_slot",
    f"WITH {FACTS_SQL}, s AS (SELECT min(user_id) AS u FROM facts WHERE event_type = 'view' AND invalid_at IS NULL) SELECT event_id AS fact_id FROM facts, s WHERE NOT (user_id = u AND event_type = 'view' AND invalid_at IS NULL)",
)
def cleared_slot(spark, sf_dir):
    """The live fact of one user's slot goes, as it is the one that was expected there."""
    f = event_facts(spark, sf_dir)
    u = f.where("predicate = 'view' AND invalid_at IS NULL").agg(F.min(F.col("user_id").cast("int"))).first()[0]
    return Life.clear_slot(f, str(u), str(u), "view", 1, 4e9).select("fact_id")
