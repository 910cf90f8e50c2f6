import hashlib
import random
import zlib

import duckdb
import pytest

from palimpsest.llm import trie as T

KEEP = "conv_id long, turn long, role string, text string"


def slow(rows):
    own = {}
    for c, turn, role, text in sorted(((r[0], r[1], r[2] or "", r[3] or "") for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode())):
        own.setdefault(c, []).append((role, text))
    made = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        made[c] = own.get(c - c % 5, [])[:h] + own[c][h:]
    nodes = {}
    for c, seq in made.items():
        for d in range(len(seq) + 1):
            nodes.setdefault(tuple(seq[:d]), []).append(c)
    kids = {}
    for k in nodes:
        if k:
            kids.setdefault(k[:-1], []).append(k)

    def below(k):
        leaves, saved = int(k not in kids), (len(nodes[k]) - 1) * (len(k[-1][1].encode()) if k else 0)
        for x in kids.get(k, []):
            a, b = below(x)
            leaves, saved = leaves + a, saved + b
        return leaves, saved

    out = []
    for k, cs in nodes.items():
        ends = ",".join(str(c) for c in sorted(c for c in cs if len(made[c]) == len(k)))
        out.append((min(cs), len(k), min(nodes[k[:-1]]) if k else None, len(cs), len(kids.get(k, [])), *below(k), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def got(spark, rows, **kw):
    return sorted((tuple(r) for r in T.prefix_trie(spark.createDataFrame(rows, KEEP), **kw).collect()), key=str)


def random_rows(seed, convs=60, most=12):
    rng = random.Random(seed)
    rows = [(c, t, rng.choice(["user", "assistant", None]), rng.choice(["a", "b", "é", "", None])) for c in range(convs) for t in range(rng.randrange(1, most))]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("height", [2, 3, 16])
def test_equals_brute_force(spark, height):
    rows = random_rows(height) + [(7, None, "user", "first"), (7, None, None, None), (8, 1, "user", "tie"), (8, 1, "user", "a tie"), (9, 3, "x", "y"), (9, 3, "x", "y"), (None, 0, "user", "none")]
    assert got(spark, rows, height=height) == slow(rows)


def test_long_conversations_over_several_levels(spark):
    rng = random.Random(1)
    rows = [(c, t, "user", f"{t}" if t < 40 * (c % 5) + 9 else f"{t}-{c}") for c in range(10) for t in range(rng.choice([70, 90, 120]))]
    assert got(spark, rows, height=3) == slow(rows)


def test_many_ends_at_one_node(spark, monkeypatch):
    monkeypatch.setattr(T, "ENDS", 7)
    rows = [(c, t, "user", "same") for c in range(300) for t in range(2)]
    assert got(spark, rows) == slow(rows)


def test_empty_and_further_columns(spark):
    assert got(spark, []) == []
    rows = random_rows(5, 20)
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], KEEP + ", depth string, g int")
    assert sorted((tuple(r) for r in T.prefix_trie(df).collect()), key=str) == slow(rows)


def test_oracle(spark):
    d = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.sql(f"create view conversations as from '{d}/conversations.parquet'")
    found = T.op12_conversation_trie(spark, d)
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, con.sql(T.OP12_SQL).fetchall()))
    assert found.columns == [c[0] for c in con.sql(T.OP12_SQL).description]
