"""Conflict resolution between new facts and known ones.

Every rule compares facts of one user and one normalised subject, so that pair is the
key of an independent fold in arrival order. The fold keeps what is live; retired
facts keep their rows with their intervals closed.
"""

from __future__ import annotations

import bisect
import math
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from palimpsest import vocabulary as V

OUT = 8192  # folded facts that leave a task at once
FACT = (
    "fact_id string, user_id string, subject string, predicate string, object string, valid_at double, created_at double, "
    "invalid_at double, expired_at double, supersedes string, source string, salience double, provenance array<string>, seq long"
)


@lru_cache(4096)
def single_valued(predicate: str) -> bool:
    p = predicate.lower()
    return p not in V.MULTI_VALUED and not any(p.startswith(m + "_") for m in V.MULTI_VALUED)


@lru_cache(4096)
def polarity(predicate: str) -> str | None:
    p = predicate.lower()
    if p in V.LIKE_PREDICATES or p.startswith(V.LIKE_PREFIXES):
        return "like"
    return "dislike" if p in V.DISLIKE_PREDICATES or p.startswith(V.DISLIKE_PREFIXES) else None


@lru_cache(65536)
def content_words(obj: str) -> frozenset:
    return frozenset(w for w in re.findall("[a-z0-9]+", obj.lower()) if len(w) > 2 and w not in V.OBJECT_STOP)


def _cosine(a, b) -> float:
    if not len(a) or not len(b):
        return 0.0
    size = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(y * y for y in b))
    return sum(x * y for x, y in zip(a, b, strict=False)) / size if size else 0.0


def _norm(x: str) -> str:
    return x.strip().lower()


def _end(f: dict) -> float:
    """From when on a fact is not live any more."""
    return min(math.inf if f[c] is None else f[c] for c in ("expired_at", "invalid_at"))


class Shelf:
    """Facts under one heading: those without an end, and the ended by their ends, so that neither a long history nor
    a fact taken out of order needs a look at all of them."""

    def __init__(self):
        self.open: dict[int, dict] = {}
        self.ended: list[tuple[float, int, dict]] = []

    def put(self, no: int, f: dict) -> None:
        self.open.pop(no, None)
        if (end := _end(f)) == math.inf:
            self.open[no] = f
        elif not self.ended or self.ended[-1][:2] <= (end, no):
            self.ended.append((end, no, f))
        else:
            bisect.insort(self.ended, (end, no, f), key=lambda e: e[:2])

    def live(self, t: float) -> list[tuple[int, dict]]:
        """(number, fact) of those live at t, in the order of arrival."""
        if not self.ended or self.ended[-1][0] <= t:
            return sorted((no, f) for no, f in self.open.items() if f["valid_at"] <= t)
        late = self.ended[bisect.bisect_right(self.ended, t, key=lambda e: e[0]) :]
        found = {no: f for end, no, f in late if _end(f) == end} | self.open  # a fact may have been ended again
        return sorted((no, f) for no, f in found.items() if f["valid_at"] <= t)


class Fold:
    """Known facts of one (user, subject) key, taken in one at a time.

    Each fact stands under the headings by which a rule looks for it: its slot, its slot and object, each content
    word of its object in its slot, and its side of a preference with the object. So a new fact meets those that it
    can touch and no others, and a key of n facts is not folded in n * n steps.
    """

    def __init__(self, similar: float | None = None, judge=None, band: float = 0.12):
        self.similar, self.judge, self.band = similar, judge, band
        self.by_no: dict[int, dict] = {}  # facts by their numbers, in the order of arrival
        self.shelves: dict[tuple, Shelf] = {}
        self.headings: dict[int, list[tuple]] = {}
        self.next = 0

    @property
    def facts(self) -> list[dict]:
        return list(self.by_no.values())

    def _headings(self, f: dict) -> list[tuple]:
        slot = (f["subject"].lower(), f["predicate"].lower())
        out = [("object", *slot, _norm(f["object"]))]
        if single_valued(f["predicate"]):
            out += [("slot", *slot), ("single",)]
        if side := polarity(f["predicate"]):
            out.append((side, _norm(f["object"])))
        return out + [("word", *slot, w) for w in content_words(f["object"])]

    def keep(self, f: dict) -> None:
        """A fact that is known already."""
        no, self.next = self.next, self.next + 1
        self._file(no, f)

    def _file(self, no: int, f: dict) -> None:
        self.by_no[no], self.headings[no] = f, self._headings(f)
        for h in self.headings[no]:
            self._shelf(h).put(no, f)

    def _shelf(self, heading: tuple) -> Shelf:
        return self.shelves.setdefault(heading, Shelf())

    def _live(self, heading: tuple, t: float) -> list[tuple[int, dict]]:
        return self._shelf(heading).live(t)

    def take(self, new: dict) -> bool:
        """Whether the fact is kept; what it replaces is retired either way."""
        t, slot = new["created_at"], (new["subject"].lower(), new["predicate"].lower())
        if self._live(("object", *slot, _norm(new["object"])), t):
            return False
        single, by_user = single_valued(new["predicate"]), new["source"] == "user"
        same_slot = self._live(("slot", *slot), t) if single else []
        if single and not by_user and any(f["source"] == "user" for _, f in same_slot):
            return False
        gone: dict[int, dict] = {}

        def offer(found) -> None:
            """Retires those of the facts that yield to the new one."""
            for no, old in found:
                if no not in gone and (by_user or old["source"] != "user") and new["valid_at"] >= old["valid_at"]:
                    old["invalid_at"] = new["valid_at"] if old["invalid_at"] is None else old["invalid_at"]
                    old["expired_at"] = t
                    gone[no] = old
                    for h in self.headings[no]:
                        self._shelf(h).put(no, old)

        if side := polarity(new["predicate"]):
            other = {"like": "dislike", "dislike": "like"}[side]
            offer((no, f) for no, f in self._live((other, _norm(new["object"])), t) if _norm(f["subject"]) == _norm(new["subject"]))
        kept = self._subsume(slot, content_words(new["object"]), t, offer)
        if not kept:
            return False  # what was retired above stays retired
        offer(same_slot)
        if single and self.similar is not None and new.get("embedding") is not None and not by_user:
            offer(self._similar(new, slot, t, gone))
        if gone:
            new["supersedes"] = max(gone.values(), key=lambda f: f["valid_at"])["fact_id"]
        self.keep(new)
        return True

    def _subsume(self, slot: tuple, said: frozenset, t: float, offer) -> bool:
        """False if a fact of the slot says more; facts that say less yield. Facts count in the order of arrival."""
        near = {no: f for w in said for no, f in self._live(("word", *slot, w), t)}
        for no, old in sorted(near.items()):
            known = content_words(old["object"])
            if said < known:
                return False
            if known < said:
                offer([(no, old)])
        return True

    def _similar(self, new: dict, slot: tuple, t: float, gone: dict):
        """Facts of other slots that mean the same attribute; never one said in the same breath."""
        for no, old in self._live(("single",), t):
            if (old["subject"].lower(), old["predicate"].lower()) == slot or no in gone or old.get("embedding") is None:
                continue
            if _norm(old["subject"]) != _norm(new["subject"]) or _norm(old["object"]) == _norm(new["object"]):
                continue
            if new["valid_at"] < old["valid_at"] or old["source"] == "user" or set(new["provenance"] or ()) & set(old["provenance"] or ()):
                continue
            near = _cosine(new["embedding"], old["embedding"])
            if near >= self.similar or (self.judge and near >= self.similar - self.band and self.judge(new, old)):
                yield no, old


def reconcile(facts: DataFrame, similar: float | None = None, judge=None) -> DataFrame:
    """The facts that stay, with their intervals; duplicates are dropped.

    ``facts`` come in the order of (valid_at, created_at, seq). With ``similar`` they have
    an ``embedding``. The key is (user, subject): one busy user spreads over subjects. A task
    has its keys one after the other, as a sorted stream, and holds one at a time.
    """
    names = [c.split()[0] for c in FACT.split(", ")]
    extra = ["embedding"] if similar is not None else []
    kind = to_arrow_schema(StructType.fromDDL(FACT))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            for r in b.to_pylist():
                yield {k: None if isinstance(v, float) and math.isnan(v) else v for k, v in r.items()}

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for _, same in groupby(rows(batches), key=lambda r: (r["user_id"], r["_key"])):
            state = Fold(similar, judge)
            for f in same:
                del f["_key"]
                state.take(f)
            out += [{k: f[k] for k in names} for f in state.by_no.values()]
            while len(out) >= OUT:
                yield pa.RecordBatch.from_pylist(out[:OUT], kind)
                out = out[OUT:]
        if out:
            yield pa.RecordBatch.from_pylist(out, kind)

    key = ["user_id", "_key"]
    src = facts.select(*names, *extra, F.lower(F.trim("subject")).alias("_key")).repartition(*key)
    order = [F.asc_nulls_last(c) for c in ("valid_at", "created_at", "seq")]
    return src.sortWithinPartitions(*key, *order).mapInArrow(fold, FACT)
