"""Queries on answer logs, coverage and service measures, and unions of candidates."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from palimpsest import vocabulary as V
from palimpsest.catalog import query
from palimpsest.functions import text as T
from palimpsest.operators import evaluation as Ev
from palimpsest.operators import lifecycle as Life
from palimpsest.operators import ranking as R
from palimpsest.operators import vector_index as Index
from palimpsest.plans.reports import RANKS_SQL, RESULTS_SQL, _results, _weighted
from palimpsest.session import scratch, table

PRED_SQL = f"""{RESULTS_SQL}, rp AS (
  SELECT * REPLACE (CASE WHEN CAST(qid AS BIGINT) % 13 = 0 THEN qid || '_abs' ELSE qid END AS qid), CAST(qid AS BIGINT) AS no,
         CASE CAST(qid AS BIGINT) % 4 WHEN 0 THEN 'I am NOT sure.' WHEN 1 THEN 'It does not mention it' ELSE 'Paris' END AS pred FROM res)"""


def _answered(spark, sf_dir):
    """Results with what was said, and with each thirteenth question an abstention item."""
    r = _results(spark, sf_dir).withColumn("no", F.col("qid").cast("long"))
    said = F.when(F.col("no") % 4 == 0, "I am NOT sure.").when(F.col("no") % 4 == 1, "It does not mention it").otherwise("Paris")
    return r.withColumns({"pred": said, "qid": F.when(F.col("no") % 13 == 0, F.concat("qid", F.lit("_abs"))).otherwise(F.col("qid"))})


@query(
    "accuracy_with_abstention",
    f"WITH {PRED_SQL} SELECT system, cat, count(ok) AS n, count(*) FILTER (WHERE ok) AS \"right\", round(avg(tok) FILTER (WHERE ok IS NOT NULL), 6) AS avg_tokens, count(err) AS errors "
    "FROM (SELECT * REPLACE (CASE WHEN ends_with(qid, '_abs') THEN 'abstention' ELSE cat END AS cat) FROM rp) GROUP BY ROLLUP(system, cat) HAVING system IS NOT NULL",
)
def accuracy_with_abstention(spark, sf_dir):
    return Ev.accuracy(Ev.categories(_answered(spark, sf_dir)))


@query("answer_latencies", f"WITH {RESULTS_SQL} SELECT system, quantile_disc(tok / 1000.0::DOUBLE, 0.5) AS p50, quantile_disc(tok / 1000.0::DOUBLE, 0.95) AS p95 FROM res WHERE ok IS NOT NULL GROUP BY system")
def answer_latencies(spark, sf_dir):
    """Characters stand for milliseconds."""
    return Ev.latencies(_results(spark, sf_dir).withColumn("lat", F.col("tok") / 1000.0))


@query(
    "system_metrics",
    f"WITH {RESULTS_SQL} SELECT system, count(ok) FILTER (WHERE err IS NULL) AS n, count(err) AS errors, round(100.0 * count(*) FILTER (WHERE ok AND err IS NULL) / count(ok) FILTER (WHERE err IS NULL), 9) AS accuracy, round(avg(tok) FILTER (WHERE ok IS NOT NULL AND err IS NULL), 9) AS avg_tokens FROM res GROUP BY system",
)
def system_metrics(spark, sf_dir):
    return Ev.system_metrics(_results(spark, sf_dir))


@query(
    "lost_in_the_middle",
    f"""WITH {PRED_SQL}, p AS (SELECT coalesce(x.ok, false) AS a, coalesce(y.ok, false) AS b, y.no % 4 < 2 AS quiet FROM rp x JOIN rp y ON x.qid = y.qid AND x.system = 'a' AND y.system = 'b')
SELECT count(*) AS n, count(*) FILTER (WHERE NOT b) AS errors, count(*) FILTER (WHERE NOT b AND quiet) AS errors_abstained, count(*) FILTER (WHERE a AND NOT b) AS only_lean,
count(*) FILTER (WHERE a AND NOT b AND quiet) AS only_lean_abstained, count(*) FILTER (WHERE a AND NOT b AND NOT quiet) AS only_lean_wrong_value FROM p""",
)
def lost_in_the_middle(spark, sf_dir):
    return Ev.lost_in_the_middle(_answered(spark, sf_dir), "a", "b")


@query(
    "backbone_gaps",
    f"""WITH {RESULTS_SQL}, m AS (SELECT cat AS backbone, system, round(100.0 * count(*) FILTER (WHERE ok AND err IS NULL) / count(ok) FILTER (WHERE err IS NULL), 9) AS acc, round(avg(tok) FILTER (WHERE ok IS NOT NULL AND err IS NULL), 9) AS t FROM res GROUP BY ALL)
SELECT a.backbone, a.acc AS lean, b.acc AS "full", round(a.acc - b.acc, 9) AS gap, round(b.t / a.t, 6) AS token_ratio FROM m a JOIN m b USING (backbone) WHERE a.system = 'a' AND b.system = 'b'""",
)
def backbone_gaps(spark, sf_dir):
    """Languages stand for the models that answer."""
    return Ev.backbone_gaps(_results(spark, sf_dir).withColumn("backbone", F.col("cat")), "a", "b")


@query(
    "ablation_deltas",
    f"""WITH {RESULTS_SQL}, v AS (SELECT o.system, coalesce(o.ok, false) AS o, coalesce(b.ok, false) AS b FROM res b JOIN (SELECT * FROM res WHERE system = 'b' UNION ALL SELECT qid, cat, 'c', CAST(qid AS BIGINT) % 2 = 0, tok, err FROM res WHERE system = 'b') o USING (qid) WHERE b.system = 'a'),
g AS (SELECT system, count(*) AS n, count(*) FILTER (WHERE o) AS hits, count(*) FILTER (WHERE b) AS base_hits, count(*) FILTER (WHERE o AND NOT b) AS gained, count(*) FILTER (WHERE b AND NOT o) AS lost FROM v GROUP BY system)
SELECT *, round(100.0 * (gained - lost) / n, 6) AS delta, (gained - lost) ** 2 <= 4 * (gained + lost) AS noise FROM g""",
)
def ablation_deltas(spark, sf_dir):
    r = _results(spark, sf_dir)
    c = r.where("system = 'b'").withColumns({"system": F.lit("c"), "ok": F.col("qid").cast("long") % 2 == 0})
    return Ev.ablation(r.unionByName(c), "a")


def _any(marks, x: str) -> str:
    return "(" + " OR ".join("contains({}, '{}')".format(x, m.replace("'", "''")) for m in marks) + ")"


def _said_sql() -> str:
    return "SELECT doc_id, lower(CASE doc_id % 5 WHEN 0 THEN 'How many ' WHEN 1 THEN 'Can you Recommend ' WHEN 2 THEN 'There is No Information on ' ELSE '' END || text) AS x FROM documents WHERE text IS NOT NULL"


@query(
    "question_cues",
    f"WITH s AS ({_said_sql()}) SELECT doc_id, {_any(V.ABSTENTION_MARKS, 'x')} AS abstains, {_any(V.COUNT_QUESTIONS, 'x')} AS counts, {_any(V.ADVICE_QUESTIONS, 'x')} AS advice FROM s",
)
def question_cues(spark, sf_dir):
    no = F.col("doc_id") % 5
    head = F.when(no == 0, "How many ").when(no == 1, "Can you Recommend ").when(no == 2, "There is No Information on ").otherwise("")
    s = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.concat(head, F.col("text")).alias("x"))
    return s.select("doc_id", T.looks_abstaining(F.col("x")).alias("abstains"), T.asks_count(F.col("x")).alias("counts"), T.asks_advice(F.col("x")).alias("advice"))


@query(
    "model_verdicts",
    """WITH r AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN ' Yes, ' WHEN 1 THEN 'Oh yes ' ELSE '' END || text AS raw FROM documents WHERE text IS NOT NULL),
c AS (SELECT *, regexp_extract(upper(raw), '[ABCD]') AS l, lower(trim(raw)) AS v FROM r)
SELECT doc_id, CASE WHEN l = '' THEN -1 ELSE ascii(l) - 65 END AS choice, starts_with(v, 'y') OR contains(left(v, 5), 'yes') AS yes FROM c""",
)
def model_verdicts(spark, sf_dir):
    """The heads of documents as replies of a model: the letter chosen, and the judge's verdict."""
    no = F.col("doc_id") % 3
    raw = F.concat(F.when(no == 0, " Yes, ").when(no == 1, "Oh yes ").otherwise(""), F.col("text"))
    return table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", T.chosen_letter(raw).alias("choice"), T.says_yes(raw).alias("yes"))


@query(
    "service_metrics",
    """WITH l AS (SELECT event_type AS op, value / 100 AS s, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events),
w AS (SELECT op, list_sort(list(s)) AS v, round(avg(s) * 1000, 2) AS avg_ms, round(max(s) * 1000, 2) AS max_ms, count(*) AS "window" FROM l WHERE rn <= 512 GROUP BY op), n AS (SELECT op, count(*) AS n FROM l GROUP BY op)
SELECT op, n, avg_ms, max_ms, "window", round(v[CAST(floor(0.5 * ("window" - 1) + 0.5) AS INT) + 1] * 1000, 2) AS p50_ms, round(v[CAST(floor(0.95 * ("window" - 1) + 0.5) AS INT) + 1] * 1000, 2) AS p95_ms FROM w JOIN n USING (op)""",
)
def service_metrics(spark, sf_dir):
    log = table(spark, sf_dir, "events").select(F.col("event_type").alias("op"), F.struct("ts", "event_id").alias("at"), (F.col("value") / 100).alias("seconds"))
    return Ev.service_metrics(log)


@query(
    "coverage_report",
    """WITH s AS (SELECT o_orderkey, o_orderstatus <> 'P' AS finished, o_orderkey % 25 <> 0 AS closed, o_custkey % 4 AS facts, CASE WHEN o_orderkey % 25 <> 0 THEN o_totalprice / 10000 END AS lag_s FROM orders),
d AS (SELECT count(*) AS finished, count(*) FILTER (WHERE closed) AS closed, count(*) FILTER (WHERE closed AND facts > 0) AS distilled, quantile_disc(lag_s, 0.5) AS p50, quantile_disc(lag_s, 0.95) AS p95 FROM s WHERE finished),
w AS (SELECT strftime(ts, '%G-W%V') AS week, count(*) FILTER (WHERE event_type = 'view') AS recall FROM events GROUP BY 1),
u AS (SELECT list(recall ORDER BY week DESC)[1:2] AS r FROM w), o AS (SELECT count(*) FILTER (WHERE event_type <> 'error') AS live, count(*) FILTER (WHERE event_type = 'error') AS gone FROM events)
SELECT finished, closed, round(closed / finished, 4) AS coverage, distilled, round(distilled / closed, 4) AS yield, finished - closed AS backlog, round(ceil((finished - closed) / 25.0) * 900 / 3600, 1) AS drain_eta_h,
p50 AS lag_p50_s, p95 AS lag_p95_s, r[1] AS recall_week, round(gone / (live + gone), 4) AS supersession_rate, 'met' AS "L0", CASE WHEN round(closed / finished, 4) >= 0.9 AND p50 < 60 THEN 'met' ELSE 'not_met' END AS "L1",
CASE WHEN r[1] > 0 AND (len(r) < 2 OR r[1] >= r[2]) THEN 'met' ELSE 'not_met' END AS "L2", CASE WHEN round(gone / (live + gone), 4) = 0 THEN 'not_met' ELSE 'not_measurable' END AS "L3" FROM d, u, o""",
)
def coverage_report(spark, sf_dir):
    """Orders as sessions, those that are not pending finished, and all but each 25th closed; views as recalls."""
    closed = F.col("o_orderkey") % 25 != 0
    s = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("session_id"), F.lit("orders").alias("source"), (F.col("o_orderstatus") != "P").alias("finished"), closed.alias("closed"),
        (F.col("o_custkey") % 4).alias("facts"), F.when(closed, F.col("o_totalprice") / 10000).alias("lag_s"),
    )
    e = table(spark, sf_dir, "events")
    calls = Ev.weekly_counts(e.select(F.col("event_id").alias("call_id"), "ts", F.col("event_type").alias("tool")))
    weekly = calls.groupBy("week").agg(F.sum(F.when(F.col("tool") == "view", F.col("calls")).otherwise(0)).alias("recall"))
    outcomes = e.agg(F.count_if(F.col("event_type") != "error").alias("live"), F.count_if(F.col("event_type") == "error").alias("superseded"))
    return Ev.coverage_report(s, weekly, outcomes)


@query(
    "best_weights",
    f"""WITH {RANKS_SQL}, n AS (SELECT qid, count(*) AS need FROM gd GROUP BY qid),
h AS (SELECT 0 AS grid_id, qid, count(*) AS got FROM rk JOIN gd USING (qid, id) WHERE rank <= 10 GROUP BY ALL UNION ALL
      SELECT 1, qid, count(*) FROM (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY id) AS r FROM rk) JOIN gd USING (qid, id) WHERE r <= 10 GROUP BY ALL)
SELECT CAST(grid_id AS INTEGER) AS grid_id, round(sum(got / need) / (SELECT count(*) FROM n), 9) AS recall FROM h JOIN n USING (qid) GROUP BY grid_id ORDER BY recall DESC, grid_id LIMIT 1""",
)
def best_weights(spark, sf_dir):
    return Ev.best_weights(_weighted(spark, sf_dir, [(0, "x", 1.0), (0, "y", 0.0), (1, "x", 0.0), (1, "y", 1.0)], 10))


@query("relevant_facts", "SELECT DISTINCT o_custkey % 50 AS qid, l_partkey AS fact_id FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_custkey % 50 < 5 AND o_custkey % 3 = 0")
def relevant_facts(spark, sf_dir):
    """Parts as facts of the orders that name them; a customer's orders are a session."""
    o = table(spark, sf_dir, "orders")
    ep = o.select(F.col("o_orderkey").alias("episode_id"), F.col("o_custkey").alias("session_id"))
    facts = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("fact_id"), F.array("l_orderkey").alias("provenance"))
    gold = o.where("o_custkey % 50 < 5 AND o_custkey % 3 = 0").select((F.col("o_custkey") % 50).alias("qid"), F.col("o_custkey").alias("session_id")).distinct()
    return Ev.relevant_facts(facts, ep, gold)


@query(
    "candidate_fill",
    "WITH m AS (SELECT DISTINCT o_custkey % 100 AS item, o_orderpriority AS action FROM orders WHERE o_orderstatus = 'F'), r AS (SELECT DISTINCT o_custkey % 100 AS item, o_orderpriority AS action FROM orders WHERE o_totalprice > 300000) "
    "SELECT item, action, 'model' AS origin FROM m UNION ALL SELECT item, action, 'rule' FROM r WHERE (item, action) NOT IN (SELECT (item, action) FROM m)",
)
def candidate_fill(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 100).alias("item"), F.col("o_orderpriority").alias("action"), "o_orderstatus", "o_totalprice")
    return R.fill(o.where("o_orderstatus = 'F'").select("item", "action").distinct(), o.where("o_totalprice > 300000").select("item", "action").distinct(), ["item", "action"])


@query("summaries_beside_details", "SELECT DISTINCT conv_id FROM conversations WHERE turn = 0 AND conv_id NOT IN (SELECT conv_id FROM conversations WHERE role = 'user' AND turn % 4 = 2)")
def summaries_beside_details(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return R.without(c.where("turn = 0").select("conv_id").distinct(), c.where("role = 'user' AND turn % 4 = 2"), "conv_id")


VEC = [0.5, -0.25, 0.75, 0.125]


@query(
    "vector_pool",
    """WITH v AS (SELECT vec_id, label, embedding AS e FROM embeddings WHERE embedding IS NOT NULL AND vec_id IS NOT NULL),
s AS (SELECT vec_id, round(list_cosine_similarity(e::DOUBLE[], list_transform(range(len(e)), lambda i: [0.5, -0.25, 0.75, 0.125][i % 4 + 1]::DOUBLE)), 9) AS c FROM v),
p AS (SELECT vec_id FROM s ORDER BY c DESC, vec_id LIMIT 200)
SELECT vec_id AS id, 'vector' AS origin FROM p UNION ALL SELECT vec_id, 'graph' FROM v WHERE label = 3 AND vec_id NOT IN (SELECT vec_id FROM p)""",
)
def vector_pool(spark, sf_dir):
    """The 200 nearest to a vector that repeats four numbers, and what the anchor, label 3, is linked to."""
    v = table(spark, sf_dir, "embeddings").where("embedding IS NOT NULL AND vec_id IS NOT NULL")
    near = v.select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("e"))
    width = v.agg(F.max(F.size("embedding"))).first()[0] or 0
    return R.candidate_pool(near, [VEC[i % 4] for i in range(width)], v.where("label = 3").select(F.col("vec_id").alias("id")), 200, "e", "id").select("id", "origin")


@query("ivf_recall", "SELECT count(*) FILTER (vec_id % 20 = 0) AS questions, count(*) AS filed, true AS enough FROM embeddings")
def ivf_recall(spark, sf_dir):
    """Every vector filed in an inverted file; each question (ids divisible by 20) meets as many lists as other questions
    needed for 0.95 of their 20 nearest, and finds 0.9 of its own or more."""
    e = table(spark, sf_dir, "embeddings")
    index = Index.VectorIndex.build(e, f"{scratch(spark)}/ivf-{uuid.uuid4().hex}", "vec_id", "embedding")
    asked, others = e.where("vec_id % 20 = 0"), e.where("vec_id % 20 = 10")
    probes, _ = index.probes_for(others, 20, 0.95, "vec_id")
    got = Index.recall(index.search(asked, 20, probes, "vec_id", but_itself=True), Index.exact_search(e, asked, 20, "vec_id", but_itself=True))
    filed = index.rows().agg(F.count_distinct("id").alias("filed"))
    return got.crossJoin(filed).select("questions", "filed", (F.col("recall") >= 0.9).alias("enough"))


@query(
    "conflict_candidates",
    """WITH f AS (SELECT lpad(vec_id::VARCHAR, 12, '0') AS id, label, 'o' || vec_id % 40 AS o, 'p' || vec_id % 3 AS p, embedding::DOUBLE[] AS v FROM embeddings WHERE embedding IS NOT NULL)
SELECT a.id AS a, b.id AS b FROM f a JOIN f b ON a.label = b.label AND a.id < b.id
WHERE (a.o = b.o AND a.p <> b.p) OR ((a.o <> b.o OR a.p <> b.p) AND round(list_cosine_similarity(a.v, b.v), 9) BETWEEN 0.3 AND 0.94)""",
)
def conflict_candidates(spark, sf_dir):
    """Vectors as facts on their labels, a few subjects that hold all of them: pairs with one object, and near ones."""
    e = table(spark, sf_dir, "embeddings").where("embedding IS NOT NULL")
    facts = e.select(
        F.lit("u").alias("user_id"), F.lpad(F.col("vec_id").cast("string"), 12, "0").alias("fact_id"), F.col("label").cast("string").alias("subject"),
        F.concat(F.lit("p"), F.col("vec_id") % 3).alias("predicate"), F.concat(F.lit("o"), F.col("vec_id") % 40).alias("object"), "embedding",
    )
    return Life.conflict_pairs(facts, 0.3, 0.94).select("a", "b")
