import random

import duckdb

from palimpsest.llm import quality as Q


def test_oracle(spark):
    d = "/root/testdata/sf0.01"
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.sql(f"create view {t} as from '{d}/{t}.parquet'")
    want = {r[0]: r[1:] for r in con.sql(Q.OP3_SQL).fetchall()}
    got = {r[0]: tuple(r[1:]) for r in Q.op3_quality_classifier(spark, d).collect()}
    assert got == want


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    labels = Q.good_labels(spark, d)
    model = Q.fit_quality(docs, labels.where("doc_id % 3 <> 0"))
    out = Q.classify_quality(docs, model).join(labels.where("doc_id % 3 = 0"), "doc_id").select("good", "keep").collect()
    good = [r["keep"] for r in out if r["good"]]
    bad = [r["keep"] for r in out if not r["good"]]
    assert sum(good) / len(good) > 0.998 and sum(bad) / len(bad) < 0.05, (sum(good) / len(good), sum(bad) / len(bad))


def test_sparse_places_shrink(spark):
    text = "some words of plain text here"
    rows = [(i, text, "big", "p") for i in range(400)] + [(1000 + i, text, "tiny", "p") for i in range(2)] + [(2000 + i, text, "poor", "p") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    labels = [(i, 1) for i in range(400)] + [(1000, 0), (1001, 0)] + [(2000 + i, int(i % 3 == 0)) for i in range(300)]
    model = Q.fit_quality(docs, spark.createDataFrame(labels, "doc_id long, good int"))
    theta = {r["_site"]: r["_theta"] for r in model.posteriors.collect()}
    assert theta["tiny"] > 0.1 and abs(theta["poor"] - 1 / 3) < 0.05 and theta["big"] > 0.97


def test_own_vote_is_left_out(spark):
    """Two rows alike in all but their own label have the same score if no one else votes at their place."""
    text = "some words of plain text here"
    rows = [(i, text, f"s{i}", "p") for i in range(40)] + [(100 + i, text, "big", "p") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(100 + i, 1) for i in range(60)], "doc_id long, good int")
    scores = {r["_id"]: r["quality_score"] for r in Q.score_fitted(Q.fit_quality(docs, labels)).collect()}
    assert len({scores[i] for i in range(0, 40, 2)}) == 1 and abs(scores[0] - scores[1]) < 0.05


def test_words_count(spark):
    """Texts alike in shape, some with words that only bad documents have."""
    rng = random.Random(1)
    vocab = [f"w{rng.randrange(10**6)}" for _ in range(300)]
    bad = ["wa999", "wb998", "wc997"]
    docs = []
    for i in range(600):
        words = [rng.choice(vocab) for _ in range(40)]
        if i % 5 == 0:
            words[3], words[20] = rng.sample(bad, 2)
        docs.append((i, " ".join(words), "s", "p"))
    df = spark.createDataFrame(docs, "doc_id long, text string, source string, lang string")
    model = Q.fit_quality(df, spark.createDataFrame([(i, int(i % 5 > 0)) for i in range(300)], "doc_id long, good int"))
    for scored in (Q.score_fitted(model).withColumnRenamed("_id", "doc_id"), Q.classify_quality(df, model)):
        kept = {r["doc_id"] for r in scored.where("keep").collect()}
        assert kept == {i for i in range(600) if i % 5}
    assert {r["doc_id"] for r in Q.keep_good(df, spark.createDataFrame([(i, int(i % 5 > 0)) for i in range(300)], "doc_id long, good int")).collect()} == kept


def test_odd_rows(spark):
    rows = [(None, None, None, None), (1, "", "a", None), (1, "a b", "a", "x"), (2, "x" * 100_000, "a", "x"), (3, "w " * 50_000, None, "x"), (3, "w", "b", "y")]
    docs = spark.createDataFrame([(*r, 0.1, 2) for r in rows], "doc_id long, text string, source string, lang string, quality_score double, n int")
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (2, None), (3, 1)], "doc_id long, good int")
    out = Q.classify_quality(docs, Q.fit_quality(docs, labels))
    assert out.columns == ["doc_id", "text", "source", "lang", "n", "quality_score", "keep"]
    assert len(out.collect()) == len(rows)
    fitted = Q.score_fitted(Q.fit_quality(docs, labels))
    assert len(fitted.collect()) == len(rows)
    kept = Q.keep_good(docs, labels)
    assert kept.columns == docs.columns and len(kept.collect()) == fitted.where("keep").count()
    none = Q.classify_quality(docs, Q.fit_quality(docs, labels.limit(0))).collect()
    assert {(r["quality_score"], r["keep"]) for r in none} == {(0.5, True)}
    assert Q.classify_quality(docs.limit(0), Q.fit_quality(docs.limit(0), labels)).collect() == []
