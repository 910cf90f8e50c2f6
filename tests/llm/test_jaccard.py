import random

import duckdb
import pytest

from palimpsest.llm import jaccard as J

KEEP = "doc_id long, text string"


def shingles(text, words):
    t = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = [x for x in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in t).split(" ") if x]
    return {tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()


def slow(rows, words=5, percent=80):
    sets = [(d, shingles(t, words)) for d, t in rows]
    up = {d: d for d, _ in rows if d is not None}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if a is not None and b is not None and x and y and 100 * len(x & y) >= percent * len(x | y):
                lo, hi = sorted((find(a), find(b)))
                up[hi] = lo
    return sorted(((d, len(s), find(d) if d is not None else None) for d, s in sets), key=str)


def got(spark, rows, **kw):
    return sorted((tuple(r) for r in J.jaccard_classes(spark.createDataFrame(rows, KEEP), **kw).collect()), key=str)


def edited(rng, words, edits):
    out = list(words)
    for _ in range(edits):
        i = rng.randrange(len(out))
        out[i : i + rng.choice([0, 1])] = [rng.choice("pqrstuvw") + str(rng.randrange(99))]
    return out


def families(seed, kinds=14, most=14):
    """Chains of edits of texts of 1 to 200 words, with a passage that many share."""
    rng = random.Random(seed)
    passage = [f"shared{i}" for i in range(30)]
    rows = []
    for _ in range(kinds):
        words = [f"w{rng.randrange(400)}" for _ in range(rng.choice([1, 4, 5, 8, 9, 10, 12, 14, 18, 40, 90, 200]))]
        if rng.random() < 0.5:
            words += passage
        for _ in range(rng.randrange(1, most)):
            rows.append(" ".join(words))
            words = edited(rng, words, rng.choice([0, 0, 1, 1, 2, 3]))
    rng.shuffle(rows)
    return [(i + 1, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    rows = families(seed) + [(900, None), (901, ""), (902, " \t\n"), (903, "One Two"), (904, "one\ttwo"), (905, "x " * 3000), (906, "y z " * 3000)]
    rows += [(None, "one two"), (None, rows[0][1]), rows[3], (rows[4][0], rows[4][1]), (950, rows[0][1].upper())]
    want = slow(rows)
    assert len({r[2] for r in want}) < len(want) - 30
    assert got(spark, rows) == want


@pytest.mark.parametrize("border", [0, 9, 16])
def test_any_border_gives_the_same_classes(spark, monkeypatch, border):
    monkeypatch.setattr(J, "light_border", lambda *a: border)
    rows = families(10 + border, kinds=12)
    assert got(spark, rows, words=2) == slow(rows, words=2)


def test_other_similarity(spark):
    rows = families(5, kinds=10)
    assert got(spark, rows, words=3, percent=60) == slow(rows, 3, 60)


def test_a_group_around_no_centre(spark, monkeypatch):
    """Every copy is edited at another place: many are similar to few others."""
    monkeypatch.setattr(J, "SIDE", 16)
    rng = random.Random(3)
    base = [f"b{i}" for i in range(120)]
    rows = [(i, " ".join(edited(rng, base, rng.choice([1, 2, 3, 4])))) for i in range(1, 120)]
    assert got(spark, rows) == slow(rows)


def test_bounds():
    for m in range(1, 60):
        for n in J.partners(m):
            o = next(c for c in range(min(m, n) + 1) if 100 * c >= 80 * (m + n - c)) if m and n else 0
            assert J.overlap(m, n) == o
            assert min(J.listed(m) - (m - o), J.listed(n) - (n - o)) >= max(J.common(m), J.common(n))
            assert J.listed(m) <= m


def test_empty_and_further_columns(spark):
    assert got(spark, []) == []
    rows = [(1, "a b c d e f"), (2, "a b c d e f"), (3, "z")]
    df = spark.createDataFrame([(*r, "x", 7) for r in rows], KEEP + ", id string, size int")
    assert sorted(tuple(r) for r in J.jaccard_classes(df).collect()) == [(1, 2, 1), (2, 2, 1), (3, 1, 3)]


def test_oracle(spark):
    d = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.sql(f"create view documents as from '{d}/documents.parquet'")
    found = sorted(tuple(r) for r in J.op13_ngram_jaccard(spark, d).collect())
    assert found == sorted(con.sql(J.OP13_SQL).fetchall())
    assert sum(r[0] != r[2] for r in found) > 50
