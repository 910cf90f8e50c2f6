"""The inverted file against a search of every row."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.operators import vector_index as V

D = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def table(spark):
    return spark.read.parquet(f"{D}/embeddings.parquet")


@pytest.fixture(scope="module")
def index(table, tmp_path_factory):
    return V.VectorIndex.build(table, f"file://{tmp_path_factory.mktemp('ivf')}", "vec_id", "embedding", keep=("label",))


def test_every_row_is_filed_once(index, table):
    assert index.rows().count() == table.count() == index.rows().select("id").distinct().count()
    assert index.rows().select("list").distinct().count() > 20


def test_recall(index, table):
    asked = table.where("vec_id % 50 = 0")
    truth = V.exact_search(table, asked, 20, "vec_id", "embedding").cache()
    probes, share = index.probes_for(table.where("vec_id % 50 = 1"), 20, 0.92, "vec_id")
    assert share >= 0.92 and probes < len(index.centroids)
    found = V.recall(index.search(asked, 20, probes, "vec_id"), truth).first()
    assert found["questions"] == asked.count() and found["recall"] >= 0.9
    every = index.search(asked, 20, 10_000, "vec_id")
    cols = ["qid", "id", "score", "rank"]
    assert sorted(map(tuple, every.select(*cols).collect())) == sorted(map(tuple, truth.select(*cols).collect()))


def test_exact_search_is_exact(table):
    rows = {r["vec_id"]: np.asarray(r["embedding"], float) for r in table.limit(300).collect()}
    some = table.where(F.col("vec_id").isin(*rows))
    asked = sorted(rows)[:3]
    got = V.exact_search(some, some.where(F.col("vec_id").isin(*asked)), 5, "vec_id", "embedding", but_itself=True)
    want = []
    for q in asked:
        score = sorted((-round(float(rows[q] @ v / np.linalg.norm(rows[q]) / np.linalg.norm(v)), 9), i) for i, v in rows.items() if i != q)
        want += [(q, i, n) for n, (_, i) in enumerate(score[:5], 1)]
    assert sorted((r["qid"], r["id"], r["rank"]) for r in got.collect()) == sorted(want)


def test_filters_and_graph_candidates(index, table):
    asked = table.where("vec_id IN (0, 1)")
    got = index.search(asked, 5, 10_000, "vec_id", where=F.col("label") == 1)
    assert got.join(table.select(F.col("vec_id").alias("id"), "label"), "id").where("label <> 1").isEmpty() and got.count() == 10
    linked = table.sparkSession.createDataFrame([(0, 0), (0, 1999), (0, 1999)], "qid long, id long")
    both = index.candidates(asked, linked, pool=4, probes=2, id_col="vec_id")
    assert both.where("qid = 0").count() == 5 and both.where("id = 1999 AND origin = 'graph'").count() == 1


def test_odd_vectors(spark, tmp_path):
    rows = [(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [None, 1.0]), (7, [0.0, 1.0]), (None, [1.0, 1.0])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "id long, embedding array<double>, list string")
    index = V.VectorIndex.build(df, f"file://{tmp_path}/odd")
    assert {r["id"] for r in index.rows().collect()} == {1, 2, 7}
    assert [r["id"] for r in index.search(df.where("id = 1"), 2, 9, but_itself=True).orderBy("rank").collect()] == [2, 7]
    with pytest.raises(ValueError):
        V.VectorIndex.build(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "id long, embedding array<double>"), f"file://{tmp_path}/wide")
    none = V.VectorIndex.build(df.limit(0), f"file://{tmp_path}/none")
    assert none.rows().count() == 0 and none.search(df, 3, 2).count() == 0


def test_rows_leave_in_bounded_batches(spark):
    """A row goes out once for each list: batches are cut by that, whatever came in at once, and hold the same rows."""
    from pyspark.sql import functions as F

    from palimpsest.operators import vector_index

    rows = spark.range(0, 500, 1, 1).select("id", F.array(*[F.sin(F.col("id") * k + k) for k in (1.0, 2.0, 3.0)]).alias("v"))
    centroids = vector_index._unit(np.random.default_rng(1).normal(size=(20, 3)))
    want = vector_index._nearest(rows, centroids, 10).collect()
    was, vector_index.FILED = vector_index.FILED, 64
    try:
        got = vector_index._nearest(rows, centroids, 10).collect()
    finally:
        vector_index.FILED = was
    assert got == want and len(got) == 5000
    assert {r["list"] for r in got if r["id"] == 7 and r["place"] == 0} == {int((centroids @ np.array([np.sin(7 * k + k) for k in (1.0, 2.0, 3.0)])).argmax())}
