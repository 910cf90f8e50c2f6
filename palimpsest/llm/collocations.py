"""Phrases whose words keep company, by sorted count streams.

Counts of one, two and three words are streams of rows. Only what can still be frequent
is counted: a phrase whose parts all are, by a bitmap of fixed size that may let too much
pass but never too little. The streams of two and three words are laid out in prefix order
(by their first two words) and then in suffix order (by their last two), and one pass over
either runs along both in step: a phrase of three takes the counts of its left or right
part from the row before it, and a phrase of two learns its most frequent extension, with
one row of state and no hash table.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.llm.work import dealt, durable, own_columns, read_spread

LEAST, INSIDE, FIRST = 10, 50, 2000  # occurrences, percent of them within a longer phrase, phrases a language
HELD = (1 << 20) - 8  # words counted at once; three places among them fit 63 bits
KNOWN = 1 << 19  # words whose hashes a task holds
SLOTS = 27  # the bitmap has 2**SLOTS bits
SALTS = 64  # parts of a language that are ranked by themselves first
STREAM = ["lang", "w1", "w2", "w3", "n", "f", "l1", "r1", "l2", "r2", "ext"]
_ODD = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)]

_TABLE = bytearray(range(256))
_TABLE[65:91] = bytes(range(97, 123))
_TABLE[9] = 32
for _c in b".,;:!?\n\x0b\x0c\r":
    _TABLE[_c] = 46
_TABLE = bytes(_TABLE)
BREAK = b"."  # stands between pieces; no word holds it


def words_of(text: bytes) -> list[bytes]:
    """Its words in order, A-Z lower-cased, and BREAK between pieces."""
    return text.translate(_TABLE).replace(BREAK, b" . ").split()


class _Hashes(dict):
    """word -> signed XXH64, 0 for BREAK."""

    def __init__(self, seed: int):
        self.seed = seed
        self[BREAK] = 0

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word, self.seed)
        self[word] = h = h - (1 << 64) if h >> 63 else h
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > KNOWN:
            self.clear()
            self[BREAK] = 0
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


def _slots(*hashes: np.ndarray) -> np.ndarray:
    """The bits of words or of pairs of words in the bitmap."""
    x = np.zeros(len(hashes[0]), np.uint64)
    for h in hashes:
        x = (x ^ h.view(np.uint64)) * _ODD[0]
        x ^= x >> np.uint64(29)
    return (x * _ODD[1]) >> np.uint64(64 - SLOTS)


def _held(bitmap: np.ndarray, *hashes: np.ndarray) -> np.ndarray:
    at = _slots(*hashes)
    return (bitmap[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)


def bitmap_of(rows: DataFrame, names: list[str]) -> np.ndarray:
    """2**SLOTS bits, set for each row's words: at most 2**(SLOTS - 6) longs reach the driver, whatever the rows."""

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            at = np.unique(_slots(*[c.to_numpy(zero_copy_only=False) for c in b.columns]))
            slot, begin = np.unique(at >> np.uint64(6), return_index=True)
            bits = np.bitwise_or.reduceat(np.uint64(1) << (at & np.uint64(63)), begin)
            yield pa.RecordBatch.from_arrays([pa.array(slot.view(np.int64)), pa.array(bits.view(np.int64))], ["slot", "bits"])

    got = rows.select(*names).mapInArrow(run, "slot long, bits long").groupBy("slot").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(1 << (SLOTS - 6), np.uint64)
    out[got["slot"].to_numpy()] = got["bits"].to_numpy().view(np.uint64)
    return out


def _texts(docs: DataFrame) -> DataFrame:
    src = own_columns(docs, "lang", "text")
    return src.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))


def word_counts(docs: DataFrame, seed: int) -> DataFrame:
    """(lang, w1, word, f, same): all words; same counts the words of a language that share a hash."""

    def run(batches):
        counts, known = {}, _Hashes(seed)

        def rows():
            for lang, n in counts.items():
                n.pop(BREAK, None)
                for at in range(0, len(words := list(n)), HELD):
                    part = words[at : at + HELD]
                    cols = [pa.array([lang] * len(part), pa.string()), pa.array(known.of(part)), pa.array(part, pa.binary()).cast(pa.string()), pa.array([n[w] for w in part], pa.int64())]
                    yield pa.RecordBatch.from_arrays(cols, ["lang", "w1", "word", "f"])
            counts.clear()

        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                counts.setdefault(lang, Counter()).update(words_of(text.as_buffer().to_pybytes()))
            if sum(map(len, counts.values())) > KNOWN // 2:
                yield from rows()
        yield from rows()

    made = _texts(docs).mapInArrow(run, "lang string, w1 long, word string, f long").repartition("lang", "w1")
    made = made.groupBy("lang", "w1", "word").agg(F.sum("f").alias("f"))
    return made.withColumn("same", F.count(F.lit(1)).over(W.partitionBy("lang", "w1")))


def phrase_counts(docs: DataFrame, n: int, bitmap: np.ndarray, seed: int, least: int) -> DataFrame:
    """(lang, w1, .., wn, f) of the phrases of ``n`` words with f of at least ``least``; their words, or for three
    their pairs, are in the bitmap. A task counts HELD words at a time before anything is shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)
    names = [f"w{i + 1}" for i in range(n)]

    def run(batches):
        bits, known, held, size = shared.value, _Hashes(seed), {}, 0

        def rows():
            for lang, parts in held.items():
                x = np.concatenate(parts)
                for at in range(0, len(x), HELD):
                    yield from counted(lang, x[at : at + HELD + n - 1])  # the next part's phrases begin in the next part
            held.clear()

        def counted(lang, x):
            ok = x != 0
            if n == 2:
                ok &= _held(bits, x)
                ok = ok[:-1] & ok[1:]
            else:
                pair = ok[:-1] & ok[1:]
                pair[pair] = _held(bits, x[:-1][pair], x[1:][pair])
                ok = pair[:-1] & pair[1:]
            at = np.flatnonzero(ok)
            if not len(at):
                return
            word, place = np.unique(x, return_inverse=True)
            code = np.zeros(len(at), np.int64)
            for i in range(n):
                code = code * len(word) + place[at + i]
            code, f = np.unique(code, return_counts=True)
            cols = []
            for _ in range(n):
                code, i = np.divmod(code, len(word))
                cols.insert(0, pa.array(word[i]))
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(f), pa.string()), *cols, pa.array(f.astype(np.int64))], ["lang", *names, "f"])

        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                words = words_of(text.as_buffer().to_pybytes())
                words.append(BREAK)
                held.setdefault(lang, []).append(known.of(words))
                size += len(words)
                if size >= HELD:
                    yield from rows()
                    size = 0
        yield from rows()

    kind = f"lang string, {', '.join(f'{c} long' for c in names)}, f long"
    made = _texts(docs).mapInArrow(run, kind)
    return made.groupBy("lang", *names).agg(F.sum("f").alias("f")).where(F.col("f") >= least)


def in_step(stream: DataFrame, suffix: bool) -> DataFrame:
    """The rows of STREAM after one pass in prefix or suffix order.

    A row of two words is the context of the rows of three whose first (last) two words it is. Those take
    from it the counts of their left (right) parts; it takes the largest of their counts as ``ext``.
    """
    three = F.col("n") == 3
    x, y = (F.when(three, F.col("w2")).otherwise(F.col("w1")), F.when(three, F.col("w3")).otherwise(F.col("w2"))) if suffix else (F.col("w1"), F.col("w2"))
    laid = dealt(stream.withColumns({"x": x, "y": y}), "lang", "x", "y").sortWithinPartitions("lang", "x", "y", "n").select(*STREAM)
    outer, part, whole = ("r1", "r2", "r1") if suffix else ("l1", "l1", "l2")  # of the context; what three words take of it

    def run(batches):
        held, most = None, 0  # the context at work and the largest count of its extensions so far
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b] if held is None else [held, b])
            col = {c: t[c].to_numpy().copy() for c in STREAM[1:]}
            begin = np.flatnonzero(col["n"] == 2)
            mine = np.searchsorted(begin, np.arange(t.num_rows), "right") - 1
            long = col["n"] == 3
            context = begin[mine[long]]
            col[part][long], col[whole][long] = col[outer][context], col["f"][context]
            best = np.maximum.reduceat(np.where(long, col["f"], 0), begin)
            best[0] = max(best[0], most)
            col["ext"][begin] = np.maximum(col["ext"][begin], best)
            done = np.ones(t.num_rows, bool)
            done[begin[-1]] = False  # waits for the next batch
            held, most = t.slice(int(begin[-1]), 1).combine_chunks().to_batches()[0], int(best[-1])
            made = pa.Table.from_arrays([t["lang"], *[pa.array(col[c]) for c in STREAM[1:]]], STREAM).filter(pa.array(done))
            yield from made.combine_chunks().to_batches()
        if held is not None:
            ext = pa.array([max(most, held.column("ext")[0].as_py())], pa.int64())
            yield pa.RecordBatch.from_arrays([*held.columns[:-1], ext], STREAM)

    return laid.mapInArrow(run, ", ".join(["lang string", *[f"{c} long" for c in STREAM[1:]]]))


def scored(stream: DataFrame, inside: int = INSIDE) -> DataFrame:
    """(lang, w1, w2, w3, a, l, r, score) of the candidates that stay. Products are decimals of 38 digits."""
    big = lambda c: F.col(c).cast("decimal(19,0)")
    ratio = lambda l, r: F.call_function("div", big("f") * big("f") * F.lit(1000000).cast("decimal(7,0)"), big(l) * big(r))
    rows = stream.where(100 * F.col("ext") < inside * F.col("f")).withColumn("s1", ratio("l1", "r1"))
    rows = rows.withColumn("s2", F.when(F.col("n") == 3, ratio("l2", "r2")))
    first = F.coalesce(F.col("s1") <= F.col("s2"), F.lit(True))
    pick = lambda a, b: F.when(first, F.col(a)).otherwise(F.col(b))
    w3 = F.when(F.col("n") == 3, F.col("w3"))
    return rows.select("lang", "w1", "w2", w3.alias("w3"), F.col("f").alias("a"), pick("l1", "l2").alias("l"), pick("r1", "r2").alias("r"), pick("s1", "s2").alias("score"))


def _named(rows: DataFrame, words: DataFrame) -> DataFrame:
    """rows with their phrase; only the words that they hold are read from ``words``."""
    ids = [F.col(c) for c in ("w1", "w2", "w3")]
    wanted = rows.select("lang", F.explode(F.array(*ids)).alias("w1")).where("w1 IS NOT NULL").distinct()
    found = durable(words.select("lang", "w1", "word").join(wanted, ["lang", "w1"]), "phrase-words")
    for i in (1, 2, 3):
        rows = rows.join(found.toDF("lang", f"w{i}", f"t{i}"), ["lang", f"w{i}"], "left")
    return rows.withColumn("phrase", F.concat_ws(" ", "t1", "t2", "t3"))


def _best(rows: DataFrame, first: int) -> DataFrame:
    """The first rows of each language by (score, a), with all that tie with the last of them: in salted parts,
    then together, so that no task ranks a whole language."""
    order = [F.desc("score"), F.desc("a")]
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("w1", "w2", "w3"), F.lit(SALTS)))
    rows = rows.withColumn("rank", F.rank().over(W.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= first)
    return rows.withColumn("rank", F.rank().over(W.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= first).drop("rank", "salt")


def collocations(docs: DataFrame, least: int = LEAST, inside: int = INSIDE, first: int = FIRST) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first phrases of two or three words.

    Null languages are ``und``; null texts are empty. Repeated rows count each; further columns play no part; no
    words or no phrase frequent enough: no rows. Words go by 64-bit hashes; should two words of a language share
    one, which is seen in the counts of all words, all is counted again under another seed.
    """
    for seed in range(42, 58):
        words = durable(word_counts(docs, seed), "words")
        if words.where("same > 1 OR w1 = 0").isEmpty():
            break
    else:
        raise RuntimeError("words share hashes under every seed")
    often = words.where(F.col("f") >= least)
    pairs = durable(phrase_counts(docs, 2, bitmap_of(often, ["w1"]), seed, least), "pairs")
    threes = durable(phrase_counts(docs, 3, bitmap_of(pairs, ["w1", "w2"]), seed, least), "threes")
    one = often.select("lang", "w1", F.col("f").alias("g")).hint("merge")
    zero = F.lit(0).cast("long")
    two = pairs.join(one.toDF("lang", "w1", "l1"), ["lang", "w1"]).join(one.toDF("lang", "w2", "r1"), ["lang", "w2"])
    two = two.select("lang", "w1", "w2", zero.alias("w3"), F.lit(2).cast("long").alias("n"), "f", "l1", "r1", zero.alias("l2"), zero.alias("r2"), zero.alias("ext"))
    three = threes.select("lang", "w1", "w2", "w3", F.lit(3).cast("long").alias("n"), "f", *[zero.alias(c) for c in STREAM[6:]])
    stream = durable(in_step(in_step(durable(two.unionByName(three), "stream"), False), True), "counts")
    best = durable(_best(scored(stream, inside), first), "best")
    named = _named(best, words)
    rank = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")).cast("long")
    total = words.groupBy("lang").agg(F.sum("f").alias("n"))
    out = named.withColumn("rank", rank).where(F.col("rank") <= first).join(total, "lang")
    return out.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_phrase_collocations(spark, sf_dir: str) -> DataFrame:
    """Each language's first 2000 phrases of all documents; null texts are empty, null languages ``und``."""
    return collocations(read_spread(spark, f"{sf_dir}/documents.parquet"))


OP11_SQL = f"""
WITH d AS (
  SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM d),
w AS (SELECT lang, list_filter(string_split_regex(piece, '[ \\x09]+'), lambda x: x <> '') AS ws FROM p),
g AS (
  SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase, ws[i:i + k - 1] AS v
  FROM (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM w, (VALUES (1), (2), (3)) x(k) WHERE len(ws) >= k)),
f AS MATERIALIZED (SELECT lang, k, phrase, any_value(v) AS v, count(*) AS f FROM g GROUP BY 1, 2, 3),
c AS MATERIALIZED (SELECT * FROM f WHERE k > 1 AND f >= {LEAST}),
h AS MATERIALIZED (
  SELECT c.lang, c.phrase, c.k, c.f AS a, j, f.f AS l, array_to_string(c.v[j + 1:], ' ') AS rest
  FROM c JOIN (VALUES (1), (2)) z(j) ON j < c.k JOIN f ON f.lang = c.lang AND f.phrase = array_to_string(c.v[1:j], ' ')),
s AS (
  SELECT h.lang, h.phrase, h.k, a, j, l, f.f AS r, 1000000::HUGEINT * a * a // (l::HUGEINT * f.f) AS score
  FROM h JOIN f ON f.lang = h.lang AND f.phrase = rest),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
e AS (
  SELECT lang, part, max(f) AS ext
  FROM (SELECT lang, unnest([array_to_string(v[1:2], ' '), array_to_string(v[2:3], ' ')]) AS part, f FROM c WHERE k = 3) GROUP BY 1, 2),
t AS (SELECT b.* FROM b LEFT JOIN e ON b.k = 2 AND e.lang = b.lang AND e.part = b.phrase WHERE NOT coalesce(100 * ext >= {INSIDE} * a, false)),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score::BIGINT AS score
FROM t JOIN n USING (lang) QUALIFY rank <= {FIRST}
"""
