import duckdb
import pytest

from palimpsest.llm import lines as L


def slow(rows, min_sites):
    sites = {}
    for _, t, s in rows:
        for x in (t or "").split("\n"):
            if x.strip(" "):
                sites.setdefault(x.strip(" "), set()).add(s or "")
    bad = {x for x, s in sites.items() if len(s) >= min_sites}
    first = {}
    for d, t, _ in rows:
        for p, x in enumerate((t or "").split("\n")):
            x = x.strip(" ")
            if x in bad:
                first[x] = min(first.get(x, (2,)), (d is None, d or 0, p))
    out = []
    for d, t, _ in rows:
        kept = [x for p, x in enumerate((t or "").split("\n")) if x.strip(" ") not in bad or first[x.strip(" ")] == (d is None, d or 0, p)]
        gone = len((t or "").split("\n")) - len(kept)
        out.append((str(d), "\n".join(kept) if gone else t, len((t or "").split("\n")), gone))
    return sorted(out, key=str)


@pytest.mark.parametrize("min_sites", [1, 2, 3])
def test_equals_brute_force(spark, min_sites):
    rows = [
        (1, "All rights\nfoo\n\nbar", "a"), (2, " All rights \nbaz", "b"), (3, "All rights", "c"), (4, "x\nAll rights\nAll rights\ny", None),
        (5, None, "a"), (6, "", "b"), (7, "foo", "b"), (None, "foo\nzz", "c"), (1, "All rights\nfoo\n\nbar", "a"), (8, "q\n" * 3000 + "All rights\n" * 3000, "d"),
    ]
    df = spark.createDataFrame([(*r, 1, "clash") for r in rows], "doc_id long, text string, source string, n_lines int, pos string")
    got = L.dedup_lines(df, min_sites)
    assert got.columns == ["doc_id", "text", "source", "pos", "n_lines", "n_removed"]
    assert sorted(((str(r["doc_id"]), r["text"], r["n_lines"], r["n_removed"]) for r in got.collect()), key=str) == slow(rows, min_sites)


def test_oracle(spark):
    d = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.sql(f"create view documents as from '{d}/documents.parquet'")
    got = sorted(tuple(r) for r in L.op10_line_dedup(spark, d).collect())
    assert got == sorted(con.sql(L.OP10_SQL).fetchall())
    assert sum(r[2] for r in got) > 100


def test_sketch_and_exact_count_meet(spark):
    rows = [(h, f"s{i}") for h, n in ((1, 5000), (2, 1000), (3, 1060), (4, 999), (5, 940)) for i in range(n)]
    seen = spark.createDataFrame([(h, -h, s, i) for i, (h, s) in enumerate(rows * 2)], "h long, g long, site string, at long")
    assert {r["h"] for r in L.boilerplate_lines(seen, 1000).collect()} == {1, 2, 3}


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    assert L.dedup_lines(df).collect() == []
