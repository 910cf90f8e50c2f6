import random
import re
from collections import Counter

import duckdb
import pytest

from palimpsest.llm import collocations as C

KEEP = "doc_id long, text string, lang string"


def slow(rows, least, inside, first):
    f, n = Counter(), Counter()
    for _, text, lang in rows:
        lang = lang or "und"
        t = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n-\r]", t):
            w = tuple(x for x in re.split("[ \t]+", piece) if x)
            n[lang] += len(w)
            for k in (1, 2, 3):
                for i in range(len(w) - k + 1):
                    f[lang, w[i : i + k]] += 1
    out = []
    for lang in n:
        mine = {w: a for (g, w), a in f.items() if g == lang}
        kept = []
        for w, a in mine.items():
            if len(w) < 2 or a < least:
                continue
            longer = [b for v, b in mine.items() if b >= least and len(v) == 3 and len(w) == 2 and w in (v[:2], v[1:])]
            if any(100 * b >= inside * a for b in longer):
                continue
            cuts = [(10**6 * a * a // (mine[w[:k]] * mine[w[k:]]), k, mine[w[:k]], mine[w[k:]]) for k in range(1, len(w))]
            s, _, l, r = min(cuts)
            kept.append((-s, -a, " ".join(w).encode(), l, r))
        for i, (s, a, p, l, r) in enumerate(sorted(kept)[:first], 1):
            out.append((lang, i, p.decode(), -a, l, r, n[lang], -s))
    return sorted(out)


def random_rows(seed, docs=120, vocab=9):
    rng = random.Random(seed)
    word = [*"abcdefg", "É", "it's", "A", "B"][: vocab + 2]
    sep = [" ", " ", " ", "  ", "\t", ". ", "\n", ",", "!?"]
    made = []
    for i in range(docs):
        text = "".join(rng.choice(word) + rng.choice(sep) for _ in range(rng.randrange(40)))
        made.append((i, rng.choice([text, text + " new york city hall "]), rng.choice(["en", "fr", None, "und"])))
    return made + [(1, None, "en"), (2, "", "xx"), (None, "only here", "yy"), (3, "x " * 5000, "en"), made[0], made[0]]


@pytest.mark.parametrize(("least", "inside", "first"), [(10, 50, 2000), (3, 90, 7), (2, 20, 40)])
def test_equals_brute_force(spark, least, inside, first):
    rows = random_rows(least)
    df = spark.createDataFrame([(*r, 1, "clash") for r in rows], KEEP + ", f int, w1 string")
    got = C.collocations(df, least, inside, first)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    want = slow(rows, least, inside, first)
    assert len(want) > 10
    assert sorted(tuple(r) for r in got.collect()) == want


def test_products_beyond_64_bits(spark):
    row = {"lang": "en", "w1": 1, "w2": 2, "w3": 0, "n": 2, "f": 3 * 10**12, "l1": 4 * 10**12, "r1": 5 * 10**12, "l2": 0, "r2": 0, "ext": 0}
    got = C.scored(spark.createDataFrame([tuple(row.values())], "lang string, " + ", ".join(f"{c} long" for c in C.STREAM[1:]))).first()
    assert got["score"] == 10**6 * 9 // 20


def test_words_that_share_a_hash_are_counted_again(spark, monkeypatch):
    real = C.word_counts
    calls = []

    def worse(docs, seed):
        calls.append(seed)
        made = real(docs, seed)
        return made.selectExpr("lang", "w1", "word", "f", "2L AS same") if seed == 42 else made

    monkeypatch.setattr(C, "word_counts", worse)
    rows = random_rows(1)
    got = C.collocations(spark.createDataFrame(rows, KEEP))
    assert calls == [42, 43] and sorted(tuple(r) for r in got.collect()) == slow(rows, 10, 50, 2000)


def test_empty(spark):
    assert C.collocations(spark.createDataFrame([], KEEP)).collect() == []


def test_oracle(spark):
    d = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.sql(f"create view documents as from '{d}/documents.parquet'")
    found = C.op11_phrase_collocations(spark, d)
    want = con.sql(C.OP11_SQL)
    assert found.columns == want.columns
    assert sorted(tuple(r) for r in found.collect()) == sorted(want.fetchall())
