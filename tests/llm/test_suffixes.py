import hashlib

import numpy as np
import pyarrow as pa
import pytest

from palimpsest.llm import suffixes as S


def slow(rows, length):
    """rows: distinct (id, text); per document: bytes, removed spans, what is kept."""
    docs = sorted({(d is None, d or 0, t or "") for d, t in rows})
    seen, out = set(), {}
    for null, d, t in docs:
        data = t.encode()
        gone = np.zeros(len(data), bool)
        for s in range(len(data) - length + 1):
            w = data[s : s + length]
            if w in seen:
                gone[s : s + length] = True
            seen.add(w)
        edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(int), [0]])))
        out[(None if null else d, t)] = (len(data), [tuple(x) for x in edge.reshape(-1, 2).tolist()], bytes(b for b, g in zip(data, gone, strict=True) if not g))
    return sorted(((str(d), *out[(d, t or "")]) for d, t in rows), key=str)


def fast(df, length):
    got = S.remove_repeats(df, length).collect()
    return sorted(((str(r["doc_id"]), r["n_bytes"], [(s["start"], s["end"]) for s in r["spans"]], bytes(r["kept"])) for r in got), key=str)


def corpus(rng):
    words = ["".join(rng.choice(list("abcdeé"), rng.integers(1, 7))) for _ in range(60)]
    text = lambda n: " ".join(rng.choice(words, n))
    passages = [text(12) for _ in range(6)]
    out = []
    for i in range(120):
        t = text(rng.integers(0, 30))
        for p in rng.choice(6, rng.integers(0, 3)):
            t += passages[p][rng.integers(0, 5) :] + text(rng.integers(0, 3))
        out.append((i * 3 % 119, t))
    out += [(500 + i, out[5][1]) for i in range(9)] + [(600, "ab" * 700), (601, "b" * 900), (602, "xab" * 300), (603, "ab" * 20), (604, "kj" + "abcdefg" * 3 + "zq"), (605, "u " + "hijklmno" * 5 + "p")]
    return out


@pytest.mark.parametrize(("batch", "hot", "windows"), [(1 << 16, 4096, 1 << 19), (64, 4096, 300), (50, 2, 1 << 19)])
def test_equals_brute_force(spark, monkeypatch, batch, hot, windows):
    for name, value in (("BATCH", batch), ("HOT", hot), ("WINDOWS", windows)):
        monkeypatch.setattr(S, name, value)
    rows = corpus(np.random.default_rng(batch))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for length in (10, 25):
        assert fast(df, length) == slow(rows, length)


def test_blocks_do_not_matter(spark, monkeypatch):
    monkeypatch.setattr(S, "BLOCK", 37)
    rows = corpus(np.random.default_rng(9))
    found = [S.text_runs(t.encode(), 12) for _, t in rows]
    assert all(int(f[3].sum()) == max(0, len(t.encode()) - 11) for f, (_, t) in zip(found, rows, strict=True))


def test_one_family_serves_all_batches():
    """The path of the query: whole texts in batches of some windows; the levels of all stay and merge."""
    rng = np.random.default_rng(6)
    rows = list(enumerate(t for _, t in corpus(rng) if len(t.encode()) >= 20))
    fam, levels, spans = S.SuffixFamily(), [], []
    data = [t.encode() for _, t in rows]
    for i in range(0, len(rows), 7):
        part = data[i : i + 7]
        cols = [pa.array(np.arange(i, i + len(part))), pa.array(np.zeros(len(part), np.int32)), pa.array(np.zeros(len(part), np.int64))]
        cols += [pa.array([len(t) - 19 for t in part], pa.int64()), pa.array(part, pa.binary())]
        for out in S.merge_scan([pa.RecordBatch.from_arrays(cols, ["d", "ord", "at", "n", "text"])], 20, fam, 40):
            spans += [tuple(r.values()) for r in out.to_pylist()]
            sizes = list(map(len, fam.levels))
            assert all(a > 2 * b for a, b in zip(sizes[:-1], sizes[1:], strict=True))
            assert all((x[:-1] < x[1:]).all() for x in fam.levels)
            levels.append(len(sizes))
    assert max(levels) >= 3 and len(levels) > 20
    want = {d: [(s, e) for s, e in spans_of] for (d, _), spans_of in zip(rows, (w[2] for w in slow_in_order(rows, 20)), strict=True)}
    got = {d: [] for d, _ in rows}
    for d, _, s, e in spans:
        got[d].append((s, e))
    assert {d: S.merge_spans(*map(np.asarray, zip(*v, strict=True))) if v else [] for d, v in got.items()} == want


def slow_in_order(rows, length):
    by = {r[0]: r for r in slow(rows, length)}
    return [by[str(d)] for d, _ in rows]


def test_odd_rows(spark):
    a = "the quick brown fox jumps over the lazy dog"
    rows = [(1, a), (1, a), (1, a + "!"), (None, a), (None, None), (2, None), (3, ""), (4, "short"), (5, a[5:30])]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, d long, z long")
    assert fast(df, 20) == slow(rows, 20)


def test_levels_merge_geometrically():
    rng = np.random.default_rng(3)
    fam, seen = S.SuffixFamily(), set()
    for _ in range(64):
        w = np.unique(rng.integers(0, 3000, 50).astype("S8"))
        hit = fam.holds(w)
        assert hit.tolist() == [x in seen for x in w.tolist()]
        fam.add(w[~hit])
        seen |= set(w.tolist())
        assert len(fam.levels) <= 9
    assert sum(map(len, fam.levels)) == len(seen)


def test_query(spark):
    d = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    want = [(i, n, sum(b - a for a, b in s), len(s), hashlib.sha256(k).hexdigest()) for i, n, s, k in slow(rows, 100)]
    assert sorted(((str(r[0]), *r[1:]) for r in S.op6_suffix_dedup(spark, d).collect()), key=str) == sorted(want, key=str)


def test_empty(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert S.op6_suffix_dedup(spark, str(tmp_path)).collect() == []
