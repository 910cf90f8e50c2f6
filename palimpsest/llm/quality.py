"""Quality by hierarchical empirical Bayes.

A document's own evidence is the log-likelihood ratio of its binned features, counted over
the labelled documents: five of shape, and the weight of the good and the bad words that
it holds. Words are hashed to buckets, whose weights one half of the labelled documents
gives; the other half gives the bins, so that no document vouches for its own words.
Sites and the paths below them have posteriors from all their documents, labelled or
not; a site with few shrinks toward the global mean and a path toward its site, by
precisions estimated from how far sites and paths really differ. Evidence and path
posterior add up in log odds; a document's own vote takes no part in its posterior.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.work import durable, read_spread, settled

BINS = 33  # values of a feature: 0 to 32
SYMBOLS = "|$%&*#!<>{}[]~^=_+@"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MARKS = ".,;:!?()"  # left out of words before they are hashed
SHAPES = ("size", "symbols", "capitals", "distinct", "echoes")
FEATURES = (*SHAPES, "bad_words", "good_words")
BEGIN = 4  # letters of a longer word's beginning, which counts beside it
BUCKETS = 1 << 16  # four hexadecimal digits of a word's MD5
LEAST = 3000  # thousandths of a log-likelihood ratio that a bucket must have to count: no word of four documents has it
TIMES = tuple(1000 << k for k in range(1, 9))  # sums of them at which a word feature rises by one
LIMIT = 30.0  # log odds that evidence may reach
PRECISION = (1.0, 10000.0)
ROW = ["_none", "_id", "_row", "_site", "_path"]  # what tells the rows of a table apart


def with_features(docs: DataFrame, text_col: str) -> DataFrame:
    """``docs`` with the shape features, whole numbers from 0 to 32, and ``grams``, the buckets of its
    distinct words and of their beginnings; a null text is empty, and an empty one has zeros.

    Words are split in a projection of their own, so that they are split once.
    """
    t, words, n = F.col("_t"), F.col("_words"), F.col("_n")
    split = F.filter(F.split(t, "[ \\t\\n\\r\\f\\x0B]+"), lambda w: w != "")
    own = docs.withColumn("_t", F.coalesce(F.col(f"`{text_col}`"), F.lit(""))).withColumn("_words", split)
    own = own.withColumns({"_n": F.size(words), "_size": F.length(t), "_own": F.array_distinct(words)})
    less = lambda chars: F.col("_size") - F.length(F.translate(t, chars, ""))

    def ratio(scale: int, x: Column, y: Column) -> Column:
        return F.when(y > 0, F.least(F.lit(BINS - 1), F.floor(F.lit(scale) * x / y))).otherwise(F.lit(0)).cast("int")

    echoes = F.size(F.filter(F.zip_with(words, F.slice(words, 2, n), lambda a, b: a == b), lambda same: same))
    made = [
        sum(((n >= 1 << k).cast("int") for k in range(20)), F.lit(0)),
        ratio(2, less(SYMBOLS), n),
        ratio(32, less(UPPER), F.col("_size")),
        ratio(32, F.size("_own"), n),
        ratio(32, echoes, n),
    ]
    plain = lambda w: F.translate(w, UPPER + MARKS, LOWER)
    begins = F.array_distinct(F.transform(F.filter("_own", lambda w: F.length(w) > BEGIN), lambda w: F.concat(F.lit("^"), F.substring(w, 1, BEGIN))))
    grams = F.transform(F.concat("_own", begins), lambda w: F.conv(F.substring(F.md5(plain(w)), 1, 4), 16, 10).cast("int"))
    return own.withColumns({**dict(zip(SHAPES, made, strict=True)), "grams": grams}).drop("_t", "_words", "_n", "_size", "_own")


def with_word_features(own: DataFrame, words: list[int]) -> DataFrame:
    """``own`` with bad_words and good_words, the sums of their ratios on a scale of 0 to 8, in place of ``grams``."""
    table = F.split(F.lit(",".join(map(str, words))), ",").cast("array<int>")
    own = own.withColumn("_w", F.transform("grams", lambda g: F.get(table, g)))
    total = lambda sign: F.aggregate("_w", F.lit(0).cast("long"), lambda a, w: a + F.greatest(F.lit(sign) * w, F.lit(0)))
    own = own.withColumns({"_bad": total(-1), "_ok": total(1)})
    made = {n: sum(((F.col(c) >= x).cast("int") for x in TIMES), F.lit(0)) for n, c in (("bad_words", "_bad"), ("good_words", "_ok"))}
    return own.withColumns(made).drop("_w", "_bad", "_ok", "grams")


@dataclass
class QualityModel:
    """words: weight of each bucket, in thousandths; weights: log-likelihood ratio of each feature's bins;
    prior: share of good labels; mean: of all sites; precisions: of sites and paths; places: DataFrame of
    (_site, _path, pg, pn, sg, sn), sums of votes and rows; rows: DataFrame of the fitted rows, by ROW, with
    their features and label."""

    words: list[int]
    weights: list[list[float]]
    prior: float
    mean: float
    precisions: tuple[float, float]
    places: DataFrame
    rows: DataFrame

    def evidence(self) -> Column:
        terms = [F.element_at(F.array(*[F.lit(x) for x in w]), F.col(n) + 1) for w, n in zip(self.weights, FEATURES, strict=True)]
        return F.greatest(F.least(sum(terms, F.lit(0.0)), F.lit(LIMIT)), F.lit(-LIMIT))

    def vote(self) -> Column:
        """A row's label, or else its chance of being good by its own evidence."""
        return F.coalesce(F.col("good").cast("double"), _chance(self.evidence() + math.log(self.prior / (1 - self.prior))))

    def theta(self, vote: Column | None = None) -> Column:
        """The posterior of a place, without one row's vote if that is given."""
        own, one = (F.lit(0.0), 0) if vote is None else (vote, 1)
        k_site, k_path = self.precisions
        site = (F.col("sg") - own + k_site * self.mean) / (F.col("sn") - one + k_site)
        return (F.col("pg") - own + k_path * site) / (F.col("pn") - one + k_path)

    @property
    def posteriors(self) -> DataFrame:
        return self.places.select("_site", "_path", self.theta().alias("_theta"))


def _logit(p: Column) -> Column:
    q = F.greatest(F.least(p, F.lit(1 - 1e-6)), F.lit(1e-6))
    return F.log(q / (1 - q))


def _chance(odds: Column) -> Column:
    return 1 / (1 + F.exp(-odds))


def _place(site_col: str, path_col: str) -> dict[str, Column]:
    return {n: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c, n in ((site_col, "_site"), (path_col, "_path"))}


def _row_keys(id_col: str, text_col: str, site_col: str, path_col: str) -> dict[str, Column]:
    own = F.col(f"`{id_col}`").cast("long")
    text = F.xxhash64(F.coalesce(F.col(f"`{text_col}`"), F.lit("")))
    return {"_none": own.isNull(), "_id": F.coalesce(own, F.lit(0).cast("long")), "_row": text, **_place(site_col, path_col)}


def _precision(mean: float, spread: float, groups: int, rows: float) -> float:
    """Of the beta prior whose variance is what the spread of rates shows beyond sampling."""
    noise = mean * (1 - mean) * groups / max(rows, 1.0)
    return min(PRECISION[1], max(PRECISION[0], mean * (1 - mean) / max(spread - noise, 1e-9) - 1))


def _ratios(got: dict, total: list[int], keys, more: int) -> list[float]:
    """ln of the smoothed rate among the good over that among the bad; got: key to (bad, good)."""
    if not sum(total):
        return [0.0 for _ in keys]
    both = [got.get(k, (0, 0)) for k in keys]
    return [math.log((y + 1) / (total[1] + more)) - math.log((n + 1) / (total[0] + more)) for n, y in both]


def fit_quality(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", path_col: str = "lang"
) -> QualityModel:
    """``labels`` has (id, good as 0 or 1); null ones take no part, and of several for one id the
    lowest counts. Without labels nothing is known: every score is one half.

    Texts are read once: their features are written. The driver gets the counts of at most
    BUCKETS buckets and of 7 features by 33 bins, in two classes, and two sums.
    """
    keyed = docs.withColumns(_row_keys(id_col, text_col, site_col, path_col)).select(*ROW, F.col(f"`{text_col}`").alias("_text"))
    own = durable(with_features(keyed, "_text").drop("_text"), "features")
    said = labels.toDF("_id", "_good").where("_id IS NOT NULL AND _good IS NOT NULL").groupBy("_id").agg(F.min("_good").cast("int").alias("good"))
    said = durable(said.select(F.col("_id").cast("long").alias("_id"), "good"), "labels")
    taught = own.where("NOT _none").join(said, "_id")
    first = taught.where("_id % 2 = 0")
    counted = lambda t, *by: t.groupBy(*by).agg(F.sum(1 - F.col("good")).alias("bad"), F.sum("good").alias("ok"))
    r = counted(first).first()
    total = [r["bad"] or 0, r["ok"] or 0]
    got = {r["b"]: (r["bad"], r["ok"]) for r in counted(first.select("good", F.explode("grams").alias("b")), "b").collect()}
    words = [x if abs(x) >= LEAST else 0 for x in (round(1000 * w) for w in _ratios(got, total, range(BUCKETS), 2))]
    own = durable(with_word_features(own, words), "row-features")
    pairs = F.explode(F.array(*[F.struct(F.lit(i).alias("f"), F.col(n).alias("b")) for i, n in enumerate(FEATURES)])).alias("x")
    # the bins of words are counted where the words were not
    taught = own.where("NOT _none").join(said, "_id").select("good", (F.col("_id") % 2 != 0).alias("odd"), pairs)
    use = taught.where(F.col("odd") | (F.col("x.f") < len(SHAPES)))
    got = {(r["f"], r["b"]): (r["bad"], r["ok"]) for r in counted(use, "x.f", "x.b").collect()}
    totals = [[sum(v[c] for (f, _), v in got.items() if f == i) for c in (0, 1)] for i in range(len(FEATURES))]
    weights = [_ratios(got, totals[i], [(i, b) for b in range(BINS)], BINS) for i in range(len(FEATURES))]
    bad, good = totals[0]
    said = said.select(F.lit(False).alias("_none"), "_id", "good")
    model = QualityModel(words, weights, (good + 1) / (bad + good + 2), 0.5, PRECISION[:1] * 2, own, own.join(said, ["_none", "_id"], "left"))
    soft = model.rows.select("_site", "_path", model.vote().alias("r"))
    paths = durable(soft.groupBy("_site", "_path").agg(F.sum("r").alias("pg"), F.count(F.lit(1)).alias("pn")), "paths")
    sites = paths.groupBy("_site").agg(F.sum("pg").alias("sg"), F.sum("pn").alias("sn"))
    r = sites.agg(F.sum("sg").alias("g"), F.sum("sn").alias("n")).first()
    mean = (r["g"] or 0.0) / r["n"] if r["n"] else 0.5
    both = paths.join(sites, "_site").withColumn("site_rate", F.col("sg") / F.col("sn"))
    s = sites.agg(F.sum(F.col("sn") * F.pow(F.col("sg") / F.col("sn") - mean, 2)).alias("v"), F.count(F.lit(1)).alias("k")).first()
    p = both.agg(F.sum(F.col("pn") * F.pow(F.col("pg") / F.col("pn") - F.col("site_rate"), 2)).alias("v"), F.count(F.lit(1)).alias("k")).first()
    rows = float(r["n"] or 0)
    k_site = _precision(mean, (s["v"] or 0.0) / max(rows, 1.0), s["k"] - 1, rows)
    k_path = _precision(mean, (p["v"] or 0.0) / max(rows, 1.0), p["k"] - s["k"], rows)
    model.mean, model.precisions, model.places = mean, (k_site, k_path), both.drop("site_rate")
    return model


def score_fitted(model: QualityModel) -> DataFrame:
    """The rows that the model was fitted on, by ROW, with quality_score (the chance of being good, 4 digits)
    and keep (at least one half). Each row's own vote is left out of its place's posterior."""
    known = model.rows.withColumn("_r", model.vote()).join(model.places, ["_site", "_path"])
    score = F.round(_chance(model.evidence() + _logit(model.theta(F.col("_r")))), 4)
    return known.select(*ROW, score.alias("quality_score")).withColumn("keep", F.col("quality_score") >= 0.5)


def classify_quality(
    docs: DataFrame, model: QualityModel, text_col: str = "text", site_col: str = "source", path_col: str = "lang"
) -> DataFrame:
    """``docs``, which the model need not have seen, with quality_score (the chance of being good, 4 digits) and
    keep (at least one half). A place that the model has not seen has the mean of all sites."""
    keep = [c for c in docs.columns if c not in ("quality_score", "keep")]
    at = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("_doc"), F.col(f"`{text_col}`").alias("_text"), *[c.alias(n) for n, c in _place(site_col, path_col).items()])
    known = with_word_features(with_features(at, "_text"), model.words).join(model.posteriors, ["_site", "_path"], "left")
    odds = model.evidence() + _logit(F.coalesce("_theta", F.lit(model.mean)))
    scored = known.withColumn("_p", F.round(_chance(odds), 4))
    return scored.select(*[F.col("_doc")[c].alias(c) for c in keep], F.col("_p").alias("quality_score"), (F.col("_p") >= 0.5).alias("keep"))


def keep_good(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", path_col: str = "lang"
) -> DataFrame:
    """The rows of ``docs`` that a model fitted on them keeps. Only the keys of the rejected rows meet the texts."""

    def rejected() -> DataFrame:
        model = fit_quality(docs, labels, id_col, text_col, site_col, path_col)
        return score_fitted(model).where("NOT keep").select(*ROW).distinct()

    bad = settled(rejected, "rejected")
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), *[c.alias(n) for n, c in _row_keys(id_col, text_col, site_col, path_col).items()])
    # the rejected grow with the corpus: the plan of a large one at any size
    return whole.join(bad.hint("merge"), ROW, "left_anti").select(*[F.col("_doc")[c].alias(c) for c in docs.columns])


def good_labels(spark, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("quality").alias("good"))


def op3_quality_classifier(spark, sf_dir: str) -> DataFrame:
    """Sites are sources, and the path below a site is the language."""
    docs = read_spread(spark, f"{sf_dir}/documents.parquet").select("doc_id", "text", "source", "lang")
    scored = settled(lambda: score_fitted(fit_quality(docs, good_labels(spark, sf_dir))), "scores")
    return scored.select(F.when(~F.col("_none"), F.col("_id")).cast(docs.schema["doc_id"].dataType).alias("doc_id"), "quality_score", "keep")


def _ratio_sql(scale: int, x: str, y: str) -> str:
    return f"CASE WHEN {y} > 0 THEN least({BINS - 1}, CAST(floor({scale} * ({x}) / ({y})) AS INTEGER)) ELSE 0 END"


def _less_sql(chars: str) -> str:
    return f"(size - length(translate(t, '{chars}', '')))"


_WORD = f"substr(md5(translate(x, '{UPPER + MARKS}', '{LOWER}')), 1, 4)"

OP3_SQL = f"""
WITH w AS (
  SELECT doc_id, coalesce(source, '') AS site, coalesce(lang, '') AS path, coalesce(text, '') AS t,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t\\n\\r\\f\\x0B]+'), lambda x: x <> '') AS words
  FROM documents),
c AS (SELECT *, len(words) AS n, length(t) AS size, list_distinct(words) AS own FROM w),
l AS (SELECT doc_id, min(quality) AS good FROM labels GROUP BY doc_id),
f AS (
  SELECT doc_id, site, path, good, list_transform(list_concat(own, list_distinct(list_transform(
      list_filter(own, lambda x: length(x) > {BEGIN}), lambda x: '^' || substr(x, 1, {BEGIN})))), lambda x: {_WORD}) AS grams, [
    {" + ".join(f"CAST(n >= {1 << k} AS INTEGER)" for k in range(20))},
    {_ratio_sql(2, _less_sql(SYMBOLS), "n")},
    {_ratio_sql(32, _less_sql(UPPER), "size")},
    {_ratio_sql(32, "len(own)", "n")},
    {_ratio_sql(32, "len(list_filter(list_zip(words[:-2], words[2:]), lambda x: x[1] = x[2]))", "n")}] AS shapes
  FROM c LEFT JOIN l USING (doc_id)),
gt AS (SELECT count(*) FILTER (WHERE good = 0) AS t0, count(*) FILTER (WHERE good = 1) AS t1 FROM f WHERE doc_id % 2 = 0),
gx AS (SELECT doc_id, good, unnest(grams) AS g FROM f),
gc AS (SELECT g, count(*) FILTER (WHERE good = 0) AS c0, count(*) FILTER (WHERE good = 1) AS c1 FROM gx WHERE doc_id % 2 = 0 GROUP BY g),
gw AS (SELECT g, CAST(round(1000 * (ln((c1 + 1) / (t1 + 2)) - ln((c0 + 1) / (t0 + 2)))) AS BIGINT) AS w FROM gc, gt WHERE t0 + t1 > 0),
gs AS (
  SELECT doc_id, sum(greatest(-w, 0)) AS bad, sum(greatest(w, 0)) AS ok FROM gx JOIN gw USING (g) WHERE abs(w) >= {LEAST} GROUP BY doc_id),
o AS (
  SELECT f.doc_id, site, path, good, list_concat(shapes, [
    {" + ".join(f"CAST(coalesce(bad, 0) >= {x} AS INTEGER)" for x in TIMES)},
    {" + ".join(f"CAST(coalesce(ok, 0) >= {x} AS INTEGER)" for x in TIMES)}]) AS b
  FROM f LEFT JOIN gs USING (doc_id)),
z AS (SELECT count(*) FILTER (WHERE good = 0) AS p0, count(*) FILTER (WHERE good = 1) AS p1 FROM o),
x AS (SELECT doc_id, good, unnest(b) AS bin, generate_subscripts(b, 1) AS i FROM o),
y AS (SELECT * FROM x WHERE good IS NOT NULL AND (i <= {len(SHAPES)} OR doc_id % 2 <> 0)),
n AS (SELECT i, count(*) FILTER (WHERE good = 0) AS n0, count(*) FILTER (WHERE good = 1) AS n1 FROM y GROUP BY i),
k AS (SELECT i, bin, count(*) FILTER (WHERE good = 0) AS c0, count(*) FILTER (WHERE good = 1) AS c1 FROM y GROUP BY i, bin),
e AS (
  SELECT doc_id, greatest({-LIMIT}, least({LIMIT}, sum(ln((coalesce(c1, 0) + 1) / (n1 + {BINS})) - ln((coalesce(c0, 0) + 1) / (n0 + {BINS}))))) AS ev
  FROM x JOIN n USING (i) LEFT JOIN k USING (i, bin) GROUP BY doc_id),
p AS (
  SELECT o.doc_id, site, path, ev, coalesce(CAST(good AS DOUBLE), 1 / (1 + exp(-(ev + ln((p1 + 1) / (p0 + 1)))))) AS r
  FROM o JOIN e USING (doc_id), z),
a AS (SELECT site, path, sum(r) AS pg, count(*) AS pn FROM p GROUP BY site, path),
s AS (SELECT site, sum(pg) AS sg, sum(pn) AS sn FROM a GROUP BY site),
g AS (SELECT sum(sg) / sum(sn) AS m, sum(sn) AS rows FROM s),
v AS (SELECT sum(sn * (sg / sn - m) ** 2) / max(rows) AS vs, count(*) AS ks FROM s, g),
u AS (SELECT sum(pn * (pg / pn - sg / sn) ** 2) / max(rows) AS vp, count(*) AS kp FROM a JOIN s USING (site), g),
q AS (
  SELECT m, least({PRECISION[1]}, greatest({PRECISION[0]}, m * (1 - m) / greatest(vs - m * (1 - m) * (ks - 1) / rows, 1e-9) - 1)) AS k1,
         least({PRECISION[1]}, greatest({PRECISION[0]}, m * (1 - m) / greatest(vp - m * (1 - m) * (kp - ks) / rows, 1e-9) - 1)) AS k2
  FROM g, v, u),
h AS (
  SELECT doc_id, ev, greatest(1e-6, least(1 - 1e-6, (pg - r + k2 * (sg - r + k1 * m) / (sn - 1 + k1)) / (pn - 1 + k2))) AS th
  FROM p JOIN a USING (site, path) JOIN s USING (site), q),
d AS (SELECT doc_id, round(1 / (1 + exp(-(ev + ln(th / (1 - th))))), 4) AS quality_score FROM h)
SELECT doc_id, quality_score, quality_score >= 0.5 AS keep FROM d
"""
