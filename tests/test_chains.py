"""Walks over supersession links against a walk of one question at a time."""

import random

import pytest

from palimpsest.operators import chains as C

FACT = "fact_id string, user_id string, subject string, predicate string, valid_at double, supersedes string, sensitive boolean"


def slow(facts, seeds, t, limit, redact=False):
    facts = [f for f in facts if not (redact and f[6])]
    by_id = {f[0]: f for f in facts}
    out = []
    for qid in sorted({q for q, _ in seeds}):
        got = set()
        for _, s in (x for x in seeds if x[0] == qid and x[1] in by_id):
            seen, cur = {s}, by_id[s]
            while cur[5] in by_id and by_id[cur[5]][1] == cur[1] and cur[5] not in seen:
                cur = by_id[cur[5]]
                seen.add(cur[0])
            queue = [s]
            while queue:
                x = queue.pop(0)
                for f in facts:
                    if f[5] == x and f[1] == by_id[x][1] and f[0] not in seen:
                        seen.add(f[0])
                        queue.append(f[0])
            got |= seen
        shown = sorted((by_id[x] for x in got if by_id[x][4] <= t), key=lambda f: (f[2].lower(), f[3].lower(), f[4], f[0]))
        out += [(qid, f[0], i) for i, f in enumerate(shown[:limit], 1) if len(shown) > 1]
    return sorted(out)


def walk(spark, facts, seeds, t, limit=12, redact=False):
    got = C.chain_walk(spark.createDataFrame(facts, FACT), spark.createDataFrame(seeds, "qid long, fact_id string"), t, limit, redact)
    return sorted((r["qid"], r["fact_id"], r["place"]) for r in got.select("qid", "fact_id", "place").collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_forks_circles_and_strangers(spark, seed):
    rng = random.Random(seed)
    facts = []
    for i in range(120):
        link = rng.choice([None, f"f{rng.randrange(max(1, i))}", f"f{rng.randrange(120)}", "f_unknown", f"f{i}"]) if i % 3 else f"f{max(0, i - 1)}"
        facts.append((f"f{i}", f"u{i % 2 if rng.random() < 0.1 else 0}", rng.choice(["Wei", "wei", "Ada"]), rng.choice(["works_at", "likes"]), float(rng.randrange(50)), link, rng.random() < 0.1))
    seeds = [(q, f"f{rng.randrange(125)}") for q in range(12) for _ in range(rng.randrange(1, 3))]
    for redact in (False, True):
        assert walk(spark, facts, seeds, 40.0, 12, redact) == slow(facts, seeds, 40.0, 12, redact)


def test_chain_of_5000_links_with_forks(spark):
    facts = [(f"c{i:05d}", "u", "s", "p", float(i), f"c{i - 1:05d}" if i else None, False) for i in range(5001)]
    facts += [(f"x{i:05d}", "u", "s", "q", float(i), f"c{i:05d}", False) for i in range(0, 5000, 500)]
    got = C.chain_members(spark.createDataFrame(facts, FACT), spark.createDataFrame([(1, "c02500"), (2, "x01000")], "qid long, fact_id string"))
    n = {q: {r["node"] for r in got.where(f"qid = {q}").collect()} for q in (1, 2)}
    assert n[1] == {f[0] for f in facts if f[0][0] == "c" or f[0] >= "x02500"}
    assert n[2] == {"x01000"} | {f"c{i:05d}" for i in range(1001)}


def test_nothing(spark):
    assert walk(spark, [], [(1, "a")], 1.0) == []
    assert walk(spark, [("a", "u", "s", "p", 1.0, None, None)], [(1, "a"), (1, None)], 2.0) == []
