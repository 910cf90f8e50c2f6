import math

import duckdb
import numpy as np

from palimpsest.llm import topk as K


def slow(rows, k=20, every=20):
    vec = {}
    for i, v in rows:
        if i is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        w = [math.floor(64 * x) for x in v]
        vec[i] = min(vec.get(i, w), w)
    out = []
    for q, v in vec.items():
        if q % every == 0:
            s = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), c) for c, w in vec.items() if c != q and len(w) == len(v))
            out += [(q, r + 1, c, -x) for r, (x, c) in enumerate(s[:k])]
    return sorted(out)


def run(spark, tmp_path, rows):
    spark.createDataFrame(rows, "vec_id long, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    return sorted(tuple(r) for r in K.op2_exact_topk(spark, str(tmp_path)).collect())


def test_equals_brute_force(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(K, "ROWS", 100)
    monkeypatch.setattr(K, "QUERIES", 7)
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(0, 0.2, 9).tolist()) for i in range(700)]
    rows += [(1000 + i, rows[0][1]) for i in range(90)] + [(2000 + i, [-0.5] * 9) for i in range(40)]
    rows += [(3000, None), (3020, [1.0, None]), (3040, [float("nan")] * 9), (3060, [float("inf")] * 9), (3080, [0.5]), (3081, [0.1])]
    rows += [(3100, []), (3101, []), (None, [0.1] * 9), (0, rows[0][1]), (20, [9.0] * 9), (4000, [3e7] * 9), (4001, [-2e7] * 9)]
    assert run(spark, tmp_path, rows) == slow(rows)


def test_negative_scores_and_few_rows(spark, tmp_path):
    rows = [(0, [1.0, 1.0]), (20, [-1.0, -1.0]), (21, [-2.0, 0.0]), (22, [0.0, -3.0])]
    assert run(spark, tmp_path, rows) == slow(rows)


def test_empty(spark, tmp_path):
    assert run(spark, tmp_path, []) == []


def test_oracle(spark):
    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"create view embeddings as from '{d}/embeddings.parquet'")
    assert sorted(con.sql(K.OP2_SQL).fetchall()) == sorted(tuple(r) for r in K.op2_exact_topk(spark, d).collect())


def test_clashing_columns(spark, tmp_path):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(0, 1, 4).tolist()) for i in range(60)]
    extra = "vec_id long, embedding array<double>, v string, dim int, block int, cut long, score long, query_id long, rank int"
    spark.createDataFrame([(*r, "x", 1, 2, 3, 4, 5, 6) for r in rows], extra).write.parquet(f"{tmp_path}/embeddings.parquet")
    assert sorted(tuple(r) for r in K.op2_exact_topk(spark, str(tmp_path)).collect()) == slow(rows)


def test_lists_that_cannot_reach_the_cutoff_are_passed_over():
    rng = np.random.default_rng(4)
    q, x = rng.integers(-50, 50, (30, 6)), rng.integers(-50, 50, (200, 6))
    x[:, 3:] //= 25  # short vectors in the second list
    parts = [(g, np.ascontiguousarray(x[:, g].T.astype(np.float64))) for g in (slice(0, 3), slice(3, 6))]
    total = q @ x.T
    for cut in (np.sort(total, axis=1)[:, -5], np.full(30, K.FLOOR), np.full(30, 10**6)):
        a, b = K._enough(q, x, cut, parts)
        got = set(zip(a.tolist(), b.tolist(), strict=True))
        assert {(i, j) for i in range(30) for j in range(200) if total[i, j] >= cut[i]} <= got
        assert cut[0] < 10**6 or not got
