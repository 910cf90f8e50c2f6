"""The indexed fold against the rules taken over all known facts."""

import copy
import random
import time

import pytest

from palimpsest.operators.reconcile import Fold
from tests.slow_fold import Fold as SlowFold

PREDICATES = ["works_at", "likes", "dislikes", "lives_in", "loves", "hates", "studies", "visited"]
OBJECTS = ["tea", "green tea", "strong green tea", "Tea ", "Acme", "acme corp", "jazz", "old jazz records", "it", ""]


def facts(seed, n, ordered):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        at = float(rng.randrange(40))
        out.append({
            "fact_id": f"f{i}", "user_id": "u", "subject": rng.choice(["Wei", "wei", "wei "]), "predicate": rng.choice(PREDICATES), "object": rng.choice(OBJECTS),
            "valid_at": at, "created_at": at if ordered else float(rng.randrange(40)), "invalid_at": rng.choice([None] * 9 + [float(rng.randrange(60))]), "expired_at": None, "supersedes": None,
            "source": rng.choice(["extracted"] * 4 + ["user"]), "salience": 1.0, "provenance": [f"e{rng.randrange(30)}"], "seq": i,
            "embedding": [rng.random(), rng.random(), rng.random()] if rng.random() < 0.8 else None,
        })
    return sorted(out, key=lambda f: (f["valid_at"], f["created_at"], f["seq"])) if ordered else out


@pytest.mark.parametrize("ordered", [True, False])
@pytest.mark.parametrize("similar", [None, 0.95])
def test_equals_the_plain_rules(ordered, similar):
    judge = (lambda a, b: len(a["object"]) > len(b["object"])) if similar else None
    for seed in range(150):
        rows = facts(seed, 60, ordered)
        fast, slow = Fold(similar, judge), SlowFold(similar, judge)
        for f in rows:
            assert fast.take(copy.deepcopy(f)) == slow.take(copy.deepcopy(f)), (seed, f)
        assert fast.facts == slow.facts, seed


def test_one_key_of_100000_facts():
    row = {"user_id": "u", "subject": "user", "invalid_at": None, "expired_at": None, "supersedes": None, "source": "extracted", "salience": 1.0, "provenance": []}
    fold, t = Fold(), time.perf_counter()
    for i in range(100_000):
        many = i % 2 == 0
        fold.take({**row, "fact_id": f"f{i}", "predicate": "visited" if many else "works_at", "object": f"place{i} street{i % 977}", "valid_at": float(i), "created_at": float(i), "seq": i})
    assert len(fold.facts) == 100_000 and sum(f["expired_at"] is None for f in fold.facts) == 50_001
    assert time.perf_counter() - t < 120


def test_stream_equals_batch_fold(spark, tmp_path):
    from pyspark.sql import functions as F

    from palimpsest.operators.reconcile import FACT, reconcile
    from palimpsest.streaming import folds

    names = [c.split()[0] for c in FACT.split(", ")]
    rows = [f | {"user_id": f"u{f['seq'] % 3}", "invalid_at": None} for f in facts(3, 300, True)]
    every = spark.createDataFrame([tuple(f[c] for c in names) for f in rows], FACT)
    stream = folds.FoldedFacts(spark, f"file://{tmp_path}/state")
    for lo, hi in ((-1, 9), (9, 20), (20, 30), (30, 99)):
        stream.add(every.where(f"valid_at > {lo} AND valid_at <= {hi}"))
    cols = sorted(set(names) - {"salience"})
    want = sorted(map(str, reconcile(every).select(*cols).collect()))
    assert sorted(map(str, stream.facts().select(*cols).collect())) == want
    again = folds.FoldedFacts(spark, f"file://{tmp_path}/state")
    assert again.facts().count() == len(want) and again.facts().where(F.col("expired_at").isNotNull()).count() > 20
    again.add(every.limit(0))
    again.add(every.where("valid_at > 38"))  # known already: nothing is new
    assert again.facts().count() == len(want)


def test_few_facts_are_one_value_of_the_state():
    """A key of few live facts is read and written once a batch; one that has grown keeps the same facts in maps."""
    from palimpsest.streaming import folds

    class Map(dict):
        calls = 0

        def _count(self, x):
            Map.calls += 1
            return x

        getValue = lambda self, k: self._count(self[k])  # noqa: E731, N815
        containsKey = lambda self, k: self._count(k in self)  # noqa: E731, N815
        updateValue = lambda self, k, v: self._count(self.__setitem__(k, v))  # noqa: E731, N815
        removeKey = lambda self, k: self._count(self.pop(k))  # noqa: E731, N815

    class Value:
        held = None
        get = lambda self: self.held
        update = lambda self, v: setattr(self, "held", v)

    rows = [{c: f[c] for c in folds.NAMES} | {"invalid_at": None, "object": f"{f['object']} {f['seq'] % 41}"} for f in facts(5, 400, True)]
    for few, quiet in ((10_000, True), (folds.FEW, False), (3, False)):
        folds.FEW, keep, was = few, folds._Keep({}), folds.FEW
        keep.few, keep.facts, keep.lists, Map.calls, newest = Value(), Map(), Map(), 0, {}
        for lo in range(0, 40, 5):
            part = [copy.deepcopy(f) for f in rows if lo <= f["valid_at"] < lo + 5]
            newest |= {r["fact_id"]: r.asDict() for r in keep.handleInputRows(("u",), iter(part), None)}
        folds.FEW = was
        plain = Fold()
        for f in copy.deepcopy(rows):
            plain.take(f)
        assert newest == {f["fact_id"]: f for f in plain.facts} and (Map.calls == 0) == quiet
