import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from palimpsest.llm import simhash as S
from palimpsest.llm.graph import connected_components


def slow_fp(text):
    t = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    if not words:
        return 0
    sh = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


def slow_classes(fps, radius=3):
    ids = [d for d, _ in fps]
    up = {i: i for i in range(len(fps))}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i][1] ^ fps[j][1]).count("1") <= radius:
                up[find(i)] = find(j)
    low = {}
    for i in range(len(fps)):
        if ids[i] is not None:
            low[find(i)] = min(low.get(find(i), ids[i]), ids[i])
    return [low.get(find(i)) for i in range(len(fps))]


def near(rng, base, most):
    for b in rng.choice(64, rng.integers(0, most + 1), replace=False):
        base ^= 1 << int(b)
    return base


def test_sliced_hits_equal_popcount():
    rng = np.random.default_rng(0)
    for radius in (0, 1, 3, 5, 18):
        base = int(rng.integers(0, 2**63))
        fp = np.asarray([near(rng, base, 2 * radius + 2) for _ in range(203)], np.uint64)
        key = np.sort(rng.integers(0, 9, 203))
        for shift in (1, 2, 17, 202, 300):
            got = set(S.sliced_hits(fp, key, shift, radius).tolist())
            want = {i for i in range(203 - shift) if key[i] == key[i + shift] and bin(int(fp[i]) ^ int(fp[i + shift])).count("1") <= radius}
            assert got == want


def test_masks_hold_every_near_pair():
    rng = np.random.default_rng(1)
    for levels in (1, 2):
        masks = S._masks(3, levels)
        for _ in range(300):
            a = int(rng.integers(0, 2**63))
            b = near(rng, a, 3)
            assert any(a & m == b & m for m in masks)


def test_classes_equal_brute_force(spark):
    rng = np.random.default_rng(2)
    fps = [int(x) for x in rng.integers(0, 2**63, 40)]
    for base in list(fps[:10]):
        x = base
        for _ in range(12):
            x = near(rng, x, 4)
            fps.append(x)
    rows = [(i if i % 17 else None, f) for i, f in enumerate(fps + fps[:5] + [2**64 - 1, 2**64 - 2])]
    df = spark.createDataFrame([(d, S._signed(f)) for d, f in rows], "doc_id long, fp long")
    for hot in (4096, 3):
        keys = S.candidate_keys(df.select("fp").distinct(), 3, hot)
        root = connected_components(S.link_edges(keys, 3))
        one = df.select("fp").distinct().join(root.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"))
        low = df.join(one, "fp").groupBy("root").agg(F.min("doc_id").alias("c"))
        got = sorted((str(r["doc_id"]), r["fp"], str(r["c"])) for r in df.join(one, "fp").join(low, "root").collect())
        want = sorted((str(d), S._signed(f), str(c)) for (d, f), c in zip(rows, slow_classes(rows), strict=True))
        assert got == want


def test_query_on_texts(spark, tmp_path):
    base = "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()
    texts = [None, "", " \t", "one", "one two", "One  Two\x0b", " ".join(base * 20), " ".join(base * 20 + ["x"]), "É é " * 9, "x " * 30000]
    rows = [(i, t, 7) for i, t in enumerate(texts)] + [(3, "one", 8), (None, "one", 9)]
    spark.createDataFrame(rows, "doc_id long, text string, fp long").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((str(r[0]), r[1], str(r[2])) for r in S.op5_simhash_dedup(spark, str(tmp_path)).collect())
    fps = [(d, slow_fp(t)) for d, t, _ in rows]
    want = sorted((str(d), f"{f:016x}", str(c)) for (d, f), c in zip(fps, slow_classes(fps), strict=True))
    assert got == want


def test_query_on_table(spark):
    d = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], slow_fp(r["text"])) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted(tuple(r) for r in S.op5_simhash_dedup(spark, d).collect())
    assert got == sorted((d, f"{f:016x}", c) for (d, f), c in zip(rows, slow_classes(rows), strict=True))


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert S.op5_simhash_dedup(spark, str(tmp_path)).collect() == []


def test_components(spark):
    rng = np.random.default_rng(3)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(i, i + 1) for i in range(1000, 1060)] + [(None, 1), (5, None), (7, 7)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = find(a), find(b)
            up[max(x, y)] = min(x, y)
    assert got == {x: find(x) for x in list(up)}
