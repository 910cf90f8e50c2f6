"""Removal of long repeats by a family of sparse suffix arrays.

Every window of ``length`` bytes has a key: the least hash among its short grams.
Equal windows have equal keys, so windows are dealt out by key, consecutive windows
of one key travelling as a run. Runs equal as a whole collapse by their hash, and a
key with a single run needs no text. What remains are the ends of repeats. Their
texts are dealt by key, and those of a key with very many runs by the hash of each
window. A task takes its share in the order of the corpus, in batches: each batch gets
a suffix array cut at ``length`` bytes, is merge-scanned against the sorted levels of
all earlier batches, and joins them; levels of about equal size merge, so a share of n
windows has log n levels. There are as many shares as keep each within WINDOWS.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.llm.work import durable, own_columns, read_spread, settled

BLOCK = 1 << 20  # windows of a text handled at once; a run cut here is only a shorter run
BATCH = 1 << 16  # windows in a suffix array
WINDOWS = 1 << 19  # windows in a task's share
HOT = 4096  # different runs of a key beyond which its windows are dealt one by one
LAST = (1 << 63) - 1  # where a null id sorts

_TABLE = np.random.Generator(np.random.PCG64(7)).integers(0, 2**64, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if not _POWERS or len(_POWERS[0]) <= n:
        size = 1 << max(12, int(n + 1).bit_length())
        one = np.uint64(1)
        for i, b in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            p = np.cumprod(np.concatenate([[one], np.full(size, b, np.uint64)]), dtype=np.uint64)
            _POWERS[i : i + 1] = [p]
    return _POWERS[0], _POWERS[1]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def _occurrences(grams: np.ndarray, key: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """How often each key stands among its grams[start:end]."""
    keys, which = np.unique(key, return_inverse=True)
    some = np.zeros(1 << 16, bool)
    some[(keys >> np.uint64(48)).astype(np.int64)] = True
    at = np.flatnonzero(some[(grams >> np.uint64(48)).astype(np.int64)])
    k = np.minimum(np.searchsorted(keys, grams[at]), len(keys) - 1)
    hit = keys[k] == grams[at]
    size = len(grams) + 1
    places = np.sort(k[hit] * size + at[hit])
    return np.searchsorted(places, which * size + end) - np.searchsorted(places, which * size + start)


def text_runs(data: bytes, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, hash of the run's bytes, first window, number of windows, twice) of maximal runs of one
    key. ``twice``: the key's gram occurs twice in the run, so its own windows may be equal."""
    gram = max(1, length // 3)
    span_of = length - gram + 1  # grams in a window
    out: tuple[list, ...] = ([], [], [], [], [])
    for lo in range(0, len(data) - length + 1, BLOCK):
        part = data[lo : lo + BLOCK + length - 1]
        n = len(part)
        power, inverse = _powers(n)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(_TABLE[np.frombuffer(part, np.uint8)] * inverse[:n], dtype=np.uint64, out=total[1:])
        grams = low = _mix((total[gram:] - total[:-gram]) * power[: n - gram + 1])
        span = 1
        while span * 2 <= span_of:
            low = np.minimum(low[:-span], low[span:])
            span *= 2
        if span < span_of:
            low = np.minimum(low[: len(low) - (span_of - span)], low[span_of - span :])
        start = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
        end = np.append(start[1:], len(low))
        whole = _mix((total[end - 1 + length] - total[start]) * power[start] ^ (end - start).astype(np.uint64))
        twice = _occurrences(grams, low[start], start, end + span_of - 1) > 1
        for o, x in zip(out, (low[start], whole, start + lo, end - start, twice), strict=True):
            o.append(x)
    if not out[0]:
        e = np.zeros(0, np.int64)
        return e.astype(np.uint64), e.astype(np.uint64), e, e, e > 0
    return tuple(np.concatenate(x) for x in out)


def _documents(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(d, ord, z): each distinct (id, text) once, z its compressed bytes. ord tells unequal texts of one id apart."""
    src = own_columns(docs, id_col, text_col).select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("d"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    )
    many = src.groupBy("d").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("d")
    if many.isEmpty():
        return src.withColumn("ord", F.lit(0))
    again = src.join(many, "d").select("d", "text").distinct().withColumn("ord", F.row_number().over(W.partitionBy("d").orderBy("text")) - 1)
    both = src.join(many, "d", "left_anti").withColumn("ord", F.lit(0)).unionByName(again.select("d", "text", F.col("ord").cast("int")))
    return durable(both, "texts")  # what follows must see one order of rows each time


RUN = "kh long, ck long, d long, ord int, at long, n long, state byte"
ONCE, TWICE, SETTLED = 0, 1, 2


def runs(texts: DataFrame, length: int) -> DataFrame:
    """Runs of every text. Of equal runs in one batch of rows all but the first are settled
    here, before anything is shuffled: what adjoins among them becomes one row in state
    SETTLED, under a key of its own. The others are TWICE if they may repeat within, or ONCE."""

    def work(batches):
        for b in batches:
            got = [text_runs(t.as_buffer().to_pybytes(), length) for t in b.column(1)]
            size = np.asarray([len(g[0]) for g in got], np.int64)
            d = np.repeat(b.column(0).to_numpy(), size)
            o = np.repeat(b.column(2).to_numpy(), size)
            key, whole, at, n, twice = (np.concatenate([g[i] for g in got]) if got else np.zeros(0, np.int64) for i in range(5))
            order = np.lexsort((at, o, d, whole, key))
            again = np.zeros(len(order), bool)
            again[order[1:]] = (key[order[1:]] == key[order[:-1]]) & (whole[order[1:]] == whole[order[:-1]])
            a = np.flatnonzero(again)
            a = a[np.lexsort((at[a], o[a], d[a]))]
            step = (d[a[1:]] != d[a[:-1]]) | (o[a[1:]] != o[a[:-1]]) | (at[a[1:]] != at[a[:-1]] + n[a[:-1]])
            first = a[np.concatenate([[True], step])] if len(a) else a
            total = np.add.reduceat(n[a], np.flatnonzero(np.concatenate([[True], step]))) if len(a) else n[a]
            rest = np.flatnonzero(~again)
            join = lambda x, y: np.concatenate([x[rest], y])
            spread = _mix(d[first].astype(np.uint64) ^ at[first].astype(np.uint64))
            cols = [join(key, spread).view(np.int64), join(whole, spread).view(np.int64), join(d, d[first])]
            cols += [join(o, o[first]).astype(np.int32), join(at, at[first]), join(n, total)]
            cols.append(np.concatenate([np.where(twice[rest], TWICE, ONCE), np.full(len(first), SETTLED)]).astype(np.int8))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["kh", "ck", "d", "ord", "at", "n", "state"])

    return texts.select("d", "text", "ord").mapInArrow(work, RUN)


def compare_runs(found: DataFrame) -> DataFrame:
    """(kh, d, ord, at, n, known): runs of one key side by side, sorted, a row at a time.

    ``known``: all its windows came earlier, as an equal run did. Others are kept
    if their key has a different run, or if they are TWICE: their windows must be compared.
    """
    dealt = found.repartition("kh").sortWithinPartitions(F.col("state") == SETTLED, "kh", "ck", "d", "ord", "at")
    names = ["kh", "d", "ord", "at", "n", "known"]

    def work(batches):
        last = None  # (key, hash of the current run), and the key's first run if it still waits
        wait = None
        for b in batches:
            if not b.num_rows:
                continue
            kh, ck, d, o, at, n, state = (b.column(i).to_numpy(zero_copy_only=False) for i in range(7))
            settled = state == SETTLED
            if settled.any():
                cols = [x[settled] for x in (kh, d, o, at, n, settled)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names)
                kh, ck, d, o, at, n, state = (x[~settled] for x in (kh, ck, d, o, at, n, state))
            if not len(kh):
                continue
            old_k = np.concatenate([[kh[0] if last is None else last[0]], kh[:-1]])
            old_c = np.concatenate([[ck[0] if last is None else last[1]], ck[:-1]])
            same_key = kh == old_k
            if last is None:
                same_key[0] = False
            known = same_key & (ck == old_c)
            start = np.flatnonzero(~same_key)
            group = np.cumsum(~same_key)
            other = np.bincount(group, weights=(same_key & ~known), minlength=int(group[-1]) + 1 if len(group) else 1) > 0
            emit = known | (other[group] & ~known) | (~known & (state == TWICE))
            rows = [np.stack([kh, d, o.astype(np.int64), at, n, known.astype(np.int64)])[:, emit]]
            if wait is not None and other[0]:
                rows.insert(0, wait)
                wait = None
            if len(start):  # the last key begun here may go on in the next batch
                s = int(start[-1])
                wait = None if emit[s] else np.asarray([[kh[s]], [d[s]], [o[s]], [at[s]], [n[s]], [0]], dtype=np.int64)
            last = (kh[-1], ck[-1])
            out = np.concatenate(rows, axis=1)
            cols = [pa.array(out[0]), pa.array(out[1]), pa.array(out[2].astype(np.int32)), pa.array(out[3]), pa.array(out[4]), pa.array(out[5] > 0)]
            yield pa.RecordBatch.from_arrays(cols, names)

    return dealt.select("kh", "ck", "d", "ord", "at", "n", "state").mapInArrow(work, "kh long, d long, ord int, at long, n long, known boolean")


class SuffixFamily:
    """Sorted levels of the distinct windows seen so far, each less than half as long as the one before it."""

    def __init__(self):
        self.levels: list[np.ndarray] = []

    def holds(self, windows: np.ndarray) -> np.ndarray:
        """Merge-scan of sorted ``windows`` against every level."""
        hit = np.zeros(len(windows), bool)
        for level in self.levels:
            at = np.minimum(np.searchsorted(level, windows), len(level) - 1)
            hit |= level[at] == windows
        return hit

    def add(self, windows: np.ndarray) -> None:
        if len(windows):
            self.levels.append(windows)
        while len(self.levels) > 1 and len(self.levels[-2]) <= 2 * len(self.levels[-1]):
            new, old = self.levels.pop(), self.levels.pop()
            self.levels.append(merge(old, new))


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One sorted array of two that share no element."""
    out = np.empty(len(a) + len(b), a.dtype)
    at = np.searchsorted(a, b) + np.arange(len(b))
    rest = np.ones(len(out), bool)
    rest[at] = False
    out[at], out[rest] = b, a
    return out


def suffix_array(text: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of ``starts`` by the ``length`` bytes at each, equal ones as given, and those bytes in order."""
    view = np.lib.stride_tricks.sliding_window_view(text, length)
    cut = np.ascontiguousarray(view[starts]).view(f"S{length}").ravel()
    order = np.argsort(cut, kind="stable")
    return order, cut[order]


def _pieces(n, texts, length, most):
    """Windows of whole runs, about ``most`` at a time: (run of each window, offset in it, text, start in text)."""
    i = 0
    while i < len(n):
        j, total = i, 0
        while j < len(n) and (j == i or total + n[j] <= most):
            total += int(n[j])
            j += 1
        text = np.frombuffer(b"".join(texts[i:j]), np.uint8)
        size = np.asarray([len(t) for t in texts[i:j]], np.int64)
        base = np.cumsum(size) - size
        run = np.repeat(np.arange(i, j), n[i:j])
        off = np.arange(total) - np.repeat(np.cumsum(n[i:j]) - n[i:j], n[i:j])
        yield run, off, text, np.repeat(base, n[i:j]) + off
        i = j


def merge_scan(batches, length: int, family: SuffixFamily, most: int):
    """Batches of (d, ord, at, n, text) in the order of the corpus as (d, ord, start, end): spans of windows that
    came earlier, in the batch or in the family, which takes in the others."""
    for b in batches:
        d, o, at, n = (b.column(i).to_numpy(zero_copy_only=False) for i in range(4))
        texts = [t.as_buffer().to_pybytes() for t in b.column(4)]
        for run, off, text, start in _pieces(n, texts, length, most):
            order, cut = suffix_array(text, start, length)
            new = np.concatenate([[True], cut[1:] != cut[:-1]])
            firsts = np.flatnonzero(new)
            old = family.holds(cut[firsts])
            family.add(cut[firsts[~old]])
            seen = ~new
            seen[firsts] = old
            again = np.empty(len(cut), bool)
            again[order] = seen
            edge = np.flatnonzero(again & ~np.concatenate([[False], again[:-1] & (run[1:] == run[:-1])]))
            stop = np.flatnonzero(again & ~np.concatenate([again[1:] & (run[1:] == run[:-1]), [False]]))
            r, first = run[edge], at[run[edge]] + off[edge]
            cols = [pa.array(d[r]), pa.array(o[r].astype(np.int32)), pa.array(first), pa.array(first + (stop - edge) + length)]
            yield pa.RecordBatch.from_arrays(cols, ["d", "ord", "start", "end"])


def match_runs(fragments: DataFrame, length: int, shares: int) -> DataFrame:
    """(share, d, ord, at, n, text) as (d, ord, start, end): spans of windows that came earlier.

    Equal windows have equal ``share``, so they meet in one of the ``shares`` tasks.
    """
    dealt = fragments.repartition(shares, "share").sortWithinPartitions("d", "ord", "at")
    rows, most = dealt.select("d", "ord", "at", "n", "text"), BATCH
    return rows.mapInArrow(lambda batches: merge_scan(batches, length, SuffixFamily(), most), "d long, ord int, start long, end long")


def _compressed(texts: DataFrame) -> DataFrame:
    """(d, ord, z): texts as they travel between tasks."""

    def work(batches):
        c = zstandard.ZstdCompressor(level=1)
        for b in batches:
            z = [c.compress(t.as_buffer().to_pybytes()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(z, pa.binary())], ["d", "ord", "z"])

    return texts.select("d", "text", "ord").mapInArrow(work, "d long, ord int, z binary")


def fragments_of(texts: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """The bytes of the runs (kh, d, ord, at, n, hot), cut from their texts: whole and shared by key, or, if hot,
    window by window and shared by each window's hash."""
    lists = wanted.groupBy("d", "ord").agg(*[F.collect_list(c).alias(c) for c in ("kh", "at", "n", "hot")])
    both = _compressed(texts).join(lists, ["d", "ord"]).select("d", "ord", "z", "kh", "at", "n", "hot")

    def work(batches):
        dc = zstandard.ZstdDecompressor()
        for b in batches:
            for i in range(b.num_rows):
                data = dc.decompress(b.column(2)[i].as_buffer().to_pybytes())
                kh, at, n, hot = (b.column(c)[i].values.to_numpy(zero_copy_only=False) for c in (3, 4, 5, 6))
                one, many = np.flatnonzero(hot), np.flatnonzero(~hot)
                start = np.concatenate([at[many], *[at[k] + np.arange(n[k]) for k in one]])
                size = np.concatenate([n[many], np.ones(len(start) - len(many), np.int64)])
                part = [data[s : s + k + length - 1] for s, k in zip(start.tolist(), size.tolist(), strict=True)]
                own = np.asarray([xxhash.xxh3_64_intdigest(p) for p in part[len(many) :]], np.uint64).view(np.int64)
                cols = [pa.array(np.concatenate([kh[many], own])), pa.array(np.full(len(part), b.column(0)[i].as_py())), pa.array(np.full(len(part), b.column(1)[i].as_py(), np.int32))]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(start), pa.array(size), pa.array(part, pa.binary())], ["share", "d", "ord", "at", "n", "text"])

    return both.mapInArrow(work, "share long, d long, ord int, at long, n long, text binary")


def end_spans(texts: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """Spans of the windows of the runs ``wanted`` (kh, d, ord, at, n) that came earlier."""
    hot = wanted.groupBy("kh").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") > HOT).select("kh", F.lit(True).alias("hot"))
    hot = durable(hot, "hot-keys")
    total = wanted.agg(F.sum("n").alias("n")).first()["n"] or 0
    shares = max(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // WINDOWS))
    marked = wanted.join(hot, "kh", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
    return match_runs(fragments_of(texts, marked, length), length, shares)


def remove_repeats(docs: DataFrame, length: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, spans, kept): what stays of each text's UTF-8 when every byte goes that a
    string of ``length`` bytes covers which also starts earlier (smaller id, or earlier in the text).

    Strings are judged on the input and never cross texts. A null text is empty; a null
    id counts as the largest. Unequal texts of one id are ordered by text; rows equal in
    id and text are one document, given back once for each row.
    """
    texts = _documents(docs, id_col, text_col)

    def repeats() -> DataFrame:
        kept = durable(compare_runs(runs(texts, length)), "runs")
        stop = (F.col("at") + F.col("n") + F.lit(length - 1)).alias("end")
        known = kept.where("known").select("d", "ord", F.col("at").alias("start"), stop)
        return known.unionByName(end_spans(texts, kept.where(~F.col("known")).drop("known"), length))

    spans = settled(repeats, "repeats")
    lists = spans.groupBy("d", "ord").agg(F.collect_list(F.struct("start", "end")).alias("s"))
    both = _compressed(texts).join(lists, ["d", "ord"], "left").select("d", "ord", "z", "s")

    def cut(batches):
        dc = zstandard.ZstdDecompressor()
        for b in batches:
            size, told, left = [], [], []
            for z, s in zip(b.column(2), b.column(3), strict=True):
                data = dc.decompress(z.as_buffer().to_pybytes())
                merged = merge_spans(s.values.field(0).to_numpy(), s.values.field(1).to_numpy()) if s.is_valid else []
                size.append(len(data))
                told.append([{"start": a, "end": e} for a, e in merged])
                edge = [0, *[x for m in merged for x in m], len(data)]
                left.append(b"".join(data[a:e] for a, e in zip(edge[::2], edge[1::2], strict=True)))
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            cols = [b.column(0), b.column(1), pa.array(size, pa.int64()), pa.array(told, kind), pa.array(left, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["d", "ord", "n_bytes", "spans", "kept"])

    out = both.mapInArrow(cut, "d long, ord int, n_bytes long, spans array<struct<start:bigint,end:bigint>>, kept binary")
    src = own_columns(docs, id_col, text_col).select(
        F.col(id_col).alias("doc_id"), F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("d"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    )
    if not _repeats(src):
        return out.select(F.col("d").alias("doc_id"), "n_bytes", "spans", "kept")
    return src.join(texts.select("d", "text", "ord"), ["d", "text"]).join(out, ["d", "ord"]).select("doc_id", "n_bytes", "spans", "kept")


def _repeats(src: DataFrame) -> bool:
    """Some id is null or stands on several rows."""
    return not src.groupBy("d").agg(F.count(F.lit(1)).alias("n"), F.max(F.col("doc_id").isNull()).alias("x")).where("n > 1 OR x").isEmpty()


def merge_spans(start: np.ndarray, end: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs covered by the spans, which may overlap or touch."""
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    first = np.concatenate([[True], start[1:] > end[:-1]])
    last = np.concatenate([first[1:], [True]])
    return list(zip(start[first].tolist(), end[last].tolist(), strict=True))


def op6_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """What is left of each document without the 100-byte strings that stand earlier in the corpus; null texts are empty."""
    out = remove_repeats(read_spread(spark, f"{sf_dir}/documents.parquet"), 100)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return out.select(
        "doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )
