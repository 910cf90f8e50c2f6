import itertools
import re

import duckdb
import numpy as np
import pytest

from palimpsest.llm import urls as U


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), path


def rule_of(host, path):
    fits = [r for r in U.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits, key=lambda r: len(r.text), default=None)


def tokens(host, path):
    return sorted({"h:" + x for x in host.split(".") if x} | {"p:" + x for x in re.split("[^a-z0-9]+", path.lower()) if x})


def slow(pages, labels, m):
    bad = {}
    for d, b in labels:
        if d is not None and b is not None:
            bad[d] = bad.get(d, False) or b
    rows = [(tokens(*parts(u)), bad[p]) for p, u in pages if p in bad]
    least = max(m.min_rows, int(np.ceil(m.min_share * len(rows)))) if rows else 0
    n = {}
    for t, b in rows:
        for k in range(1, m.most_tokens + 1):
            for c in itertools.combinations(t, k):
                x = n.setdefault(c, [0, 0])
                x[0] += 1
                x[1] += b
    rules = [set(c) for c, (a, y) in n.items() if y >= least and y / a >= m.min_confidence]
    out = []
    for p, u in pages:
        h, q = parts(u)
        r = rule_of(h, q)
        hit = any(x <= set(tokens(h, q)) for x in rules)
        out.append((p, h, q, r and r.text, r.verdict if r else "block" if hit else "allow"))
    return sorted(out, key=str), rules


ODD = [
    None, "", "no scheme", "://", "http://", "HTTP://WWW.Example.ORG/es/x", "http://org", "http://org/", "http://example.org/en/12?x#y", "http://notexample.org/es/",
    "https://a.com/fr/1", "https://a.com/de/1#z", "http://com/de/", "x://a.com?/de/", "http://É.com/de/", "http://a.com/\n/de/", "http://a://b/c", "http://a.net/de/" + "x" * 9000,
]


@pytest.mark.parametrize("seed", [0, 1])
def test_equals_brute_force(spark, seed):
    rng = np.random.default_rng(seed)
    hosts = [f"{a}.{b}.{c}" for a in ("www", "m", "spam") for b in ("win", "news", "pills") for c in ("net", "org", "com")]
    pages = [(i, f"http://{rng.choice(hosts)}/{rng.choice(['en', 'es', 'fr', 'de'])}/{rng.integers(0, 4)}") for i in range(300)]
    pages += [(1000 + i, u) for i, u in enumerate(ODD)] + [(None, pages[0][1]), (5, pages[5][1])]
    labels = [(i, bool(("win" in u and "spam" in u) or rng.random() < 0.2)) for i, u in pages[:200]] + [(1, None), (None, True), (3, True), (1003, True)]
    m = U.Mining(min_share=0.02, min_rows=3)
    want, rules = slow(pages, labels, m)
    p = spark.createDataFrame([(*x, "clash", 1) for x in pages], "page_id long, url string, verdict string, tokens int")
    out = U.filter_urls(p, spark.createDataFrame(labels, "doc_id long, bad boolean"), mining=m)
    assert out.columns == ["page_id", "url", "tokens", "host", "path", "rule", "verdict"]
    got = sorted(((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in out.collect()), key=str)
    assert got == want and any(len(r) == 2 for r in rules)


def test_rule_of_four_tokens(spark):
    """Bad is one of 16 sections: no three of its tokens have the confidence."""
    kinds = list(itertools.product("ab", "cd", "ef", "gh"))
    pages = [(i, "http://{}.{}.net/{}/{}".format(*kinds[i % 16])) for i in range(160)]
    labels = [(i, i % 16 == 0) for i in range(128)]
    want, rules = slow(pages, labels, U.Mining())
    out = U.filter_urls(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(labels, "doc_id long, bad boolean"))
    assert sorted((tuple(r[c] for c in ("page_id", "host", "path", "rule", "verdict")) for r in out.collect()), key=str) == want
    assert min(map(len, rules)) == 4 and [w[0] for w in want if w[4] == "block"] == sorted(range(0, 160, 16), key=lambda i: str((i,)))


def test_nothing_to_learn_from(spark):
    p = spark.createDataFrame([(1, "http://a.net/x")], "page_id long, url string")
    none = spark.createDataFrame([], "doc_id long, bad boolean")
    assert [r["verdict"] for r in U.filter_urls(p, none).collect()] == ["allow"]
    assert U.filter_urls(p.limit(0), none).collect() == []


def test_oracle(spark):
    d = "/root/testdata/sf0.1"
    con = duckdb.connect()
    for t in ("pages", "labels"):
        con.sql(f"create view {t} as from '{d}/{t}.parquet'")
    got = sorted((tuple(r) for r in U.op4_url_filter(spark, d).collect()), key=str)
    assert got == sorted(con.sql(U.OP4_SQL).fetchall(), key=str)
