"""Vector best-fit packing of token sequences.

Every item has three demands: tokens, one document, and attention cost (tokens
squared). All three follow from its length, so the corpus reduces to a histogram
of at most ``max_tokens`` lengths. The driver runs best-fit decreasing on that
histogram, whose size does not depend on the corpus; items then find their place
by their rank within their length.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict, deque
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from palimpsest.llm.work import durable, own_columns, read_spread

SALTS = 1024  # parts that the ranking of one length is split into


class ChunkTokenizer:
    """Token ids of text, remembered per whitespace-free chunk of bytes.

    The pre-tokenizer never joins across ASCII white space, nor an ASCII letter with
    the ASCII punctuation after it, so such chunks encode independently. As it lower-
    cases, ASCII letters may be lower-cased first, unless a combining mark (which may
    compose with a lower-case letter only) or a special token's "<|" occurs. One
    memory serves all tasks of a worker; it is emptied at ``limit`` chunks.
    """

    MARK = "\x01"  # stands between new chunks; chunks holding it are encoded alone
    PARTED = re.compile(rb"(?<=[a-z])(?=[!-&(-/:-@\[-`{-~])")
    shared: dict[str, ChunkTokenizer] = {}

    @classmethod
    def of(cls, path: str) -> ChunkTokenizer:
        if path not in cls.shared:
            cls.shared[path] = cls(path)
        return cls.shared[path]

    def __init__(self, path: str, limit: int = 1_000_000):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.limit, self.known = limit, {}
        mark = self._encode(self.MARK)
        self.mark = int(mark[0]) if len(mark) == 1 else None

    def _encode(self, text: str) -> np.ndarray:
        return np.asarray(self.tok.encode(text, add_special_tokens=False).ids, dtype="<u4")

    def _learn(self, chunks: list[bytes]) -> None:
        if len(self.known) > self.limit:
            self.known.clear()
        new = [c for c in set(chunks) if c not in self.known]
        odd = [c for c in new if self.mark is None or b"\x01" in c]
        for c in odd:
            self.known[c] = self._encode(c.decode()).tobytes()
        plain = [c for c in new if self.mark is not None and b"\x01" not in c]
        for i in range(0, len(plain), 4096):
            part = plain[i : i + 4096]
            ids = self._encode(f" {self.MARK} ".join([c.decode() for c in part]))
            ends = np.flatnonzero(ids == self.mark)
            at = 0
            for c, e in zip(part, [*ends.tolist(), len(ids)], strict=True):
                self.known[c] = ids[at:e].tobytes()
                at = e + 1

    def ids(self, data: bytes) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if b"<|" not in data and b"\xcc" not in data and b"\xcd" not in data:
            data = self.PARTED.sub(b" ", data.lower())
        chunks = data.split()
        try:
            return b"".join(map(self.known.__getitem__, chunks))
        except KeyError:
            self._learn(chunks)
            return b"".join(map(self.known.__getitem__, chunks))


def tokenize_pieces(
    docs: DataFrame,
    tokenizer_path: str,
    max_tokens: int = 2048,
    end_id: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_ids: bool = True,
) -> DataFrame:
    """One row per piece of at most ``max_tokens`` ids; only longer documents are cut.

    A null or empty text has just the end id. Rows with equal ids stay apart.
    Columns: id, piece, start, length, ids_crc32 and, if asked for, ids.
    """
    src = own_columns(docs, id_col, text_col).select(
        F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    )
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if with_ids else "")

    def run(batches):
        tok = ChunkTokenizer.of(tokenizer_path)
        end = np.asarray([end_id], dtype="<u4").tobytes()
        width = 4 * max_tokens
        for batch in batches:
            doc, piece, start, length, crc, ids = [], [], [], [], [], []
            for d, t in zip(batch.column(0), batch.column(1), strict=True):
                data = tok.ids(t.as_buffer().to_pybytes()) + end
                d = d.as_py()
                for i in range(0, len(data), width):
                    part = data[i : i + width]
                    doc.append(d)
                    piece.append(i // width)
                    start.append(i // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    if with_ids:
                        ids.append(np.frombuffer(part, dtype="<i4"))
            cols = [pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64())]
            cols += [pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                cols.append(pa.array(ids, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(cols, names)

    return src.mapInArrow(run, schema)


@dataclass
class Capacity:
    """What one sequence holds. Every limit given takes part in the fit, with its residual in the state of a
    sequence and in the score, also where it cannot bind."""

    tokens: int = 2048
    documents: int | None = None
    attention: int | None = None
    weights: tuple[float, float, float] = (1.0, 0.1, 0.1)
    score: str = "residual_norm"  # or "dot_product"

    def limits(self) -> list[tuple[int, float, int]]:
        """(dimension, weight, capacity) of those given."""
        given = zip(self.weights, (self.tokens, self.documents, self.attention), strict=True)
        return [(i, w, c) for i, (w, c) in enumerate(given) if c is not None]


@dataclass
class Plan:
    """Placement of ranks: rank r >= rank_start of a length goes to sequence
    seq_start + (r - rank_start) // copies at offset + ((r - rank_start) % copies) * length."""

    length: list[int] = field(default_factory=list)
    rank_start: list[int] = field(default_factory=list)
    copies: list[int] = field(default_factory=list)
    seq_start: list[int] = field(default_factory=list)
    offset: list[int] = field(default_factory=list)
    sequences: int = 0


def demand(length: int) -> tuple[int, int, int]:
    return (length, 1, length * length)


def best_fit_plan(histogram: dict[int, int], cap: Capacity) -> Plan:
    """Best-fit decreasing over lengths, many equal items at a time.

    Open sequences with the same residual vector form one class. For each length,
    longest first, the class that fits under every limit with the least weighted
    residual norm (or the greatest weighted dot product of demand and residual)
    takes items; ties go to the smaller residual vector, then to the older
    sequence. An item alone in its sequence is never refused for its attention cost.
    """
    limits = cap.limits()
    scale = np.asarray([w / c for _, w, c in limits]) if limits else np.zeros(0)
    full = tuple(c for _, _, c in limits)
    open_: dict[tuple, deque] = defaultdict(deque)
    plan, norm = Plan(), cap.score == "residual_norm"
    if cap.score not in ("residual_norm", "dot_product"):
        raise ValueError(f"unknown score {cap.score!r}")

    def put(state: tuple, need: tuple, first: int, n: int, copies: int, at: int, length: int) -> None:
        plan.length.append(length)
        plan.rank_start.append(at)
        plan.copies.append(copies)
        plan.seq_start.append(first)
        plan.offset.append(full[0] - state[0])
        left = tuple(s - copies * d for s, d in zip(state, need, strict=True))
        if left[0] > 0 and all(x >= 0 for x in left):
            open_[left].append((first, n))

    for length in sorted(histogram, reverse=True):
        count, done = histogram[length], 0
        if not 0 < length <= cap.tokens:
            raise ValueError(f"length {length} does not fit {cap.tokens} tokens")
        all_need = demand(length)
        need = tuple(all_need[d] for d, _, _ in limits)
        while count:
            states = [s for s in open_ if all(a >= b for a, b in zip(s, need, strict=True))]
            if not states:
                per = max(1, min(c // n for c, n in zip(full, need, strict=True)))
                for bins, copies in ((count // per, per), (1, count % per)):
                    if bins and copies:
                        put(full, need, plan.sequences, bins, copies, done, length)
                        plan.sequences += bins
                        done += bins * copies
                break
            table = np.asarray(states, dtype=float)
            rest = ((table - np.asarray(need)) * scale) ** 2
            worth = rest.sum(axis=1) if norm else -(table * scale * (np.asarray(need) * scale)).sum(axis=1)
            state = min((s for s, x in zip(states, worth, strict=True) if x == worth.min()))
            most = min(s // n for s, n in zip(state, need, strict=True)) if norm else 1
            first, n = open_[state].popleft()
            # by norm a sequence that has taken an item remains the best one, so it is filled
            bins = min(n, count // most)
            copies = most
            if bins == 0:
                bins, copies = 1, count
            if n > bins:
                open_[state].appendleft((first + bins, n - bins))
            if not open_[state]:
                del open_[state]
            put(state, need, first, bins, copies, done, length)
            done += bins * copies
            count -= bins * copies
    return plan


def best_fit_pack(pieces: DataFrame, cap: Capacity | None = None, length_col: str = "length") -> DataFrame:
    """``pieces`` with sequence_id and offset.

    ``pieces`` is read twice, so pass a written table if it is dear to make. Rows of
    null or zero length take no part and are dropped; equal rows are placed one by
    one. Ranks within a length are counted in SALTS parts, so that a length shared by
    a third of all rows is not ranked in one task.
    """
    cap = cap or Capacity()
    keys = ["_salt", "_len"]
    src = pieces.where(F.col(length_col) > 0).withColumn("_len", F.col(length_col).cast("long"))
    rows = src.withColumn("_salt", F.pmod(F.xxhash64(*[src[f"`{c}`"] for c in pieces.columns if _plain(pieces, c)]), F.lit(SALTS)))
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    sizes = durable(sizes, "pack-sizes")
    histogram = {r["_len"]: r["n"] for r in sizes.groupBy("_len").agg(F.sum("_n").alias("n")).collect()}
    plan = best_fit_plan(histogram, cap)
    base = W.partitionBy("_len").orderBy("_salt").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select(*keys, F.coalesce(F.sum("_n").over(base), F.lit(0)).alias("_base"))
    w = W.partitionBy(*keys).orderBy(*[F.col(f"`{c}`") for c in pieces.columns if _plain(pieces, c)])
    ranked = rows.withColumn("_rank", F.row_number().over(w) - 1).join(starts, keys)
    order = np.lexsort((plan.rank_start, plan.length))
    cols = {k: np.asarray(getattr(plan, k), dtype=np.int64)[order] for k in ("length", "rank_start", "copies", "seq_start", "offset")}
    shared = pieces.sparkSession.sparkContext.broadcast(cols)  # bounded: it follows the number of lengths

    @F.pandas_udf("sequence_id long, offset long")
    def place(length, rank):
        import pandas as pd

        p = shared.value
        n, r = length.to_numpy(), rank.to_numpy()
        wide = np.int64(1) << 44
        at = np.searchsorted(p["length"] * wide + p["rank_start"], n * wide + r, side="right") - 1
        k = r - p["rank_start"][at]
        return pd.DataFrame(
            {"sequence_id": p["seq_start"][at] + k // p["copies"][at], "offset": p["offset"][at] + k % p["copies"][at] * n}
        )

    placed = ranked.withColumn("_to", place(F.col("_len"), F.col("_rank") + F.col("_base")))
    return placed.select(
        *[F.col(f"`{c}`") for c in pieces.columns if c not in ("sequence_id", "offset")],
        F.col("_to.sequence_id").alias("sequence_id"),
        F.col("_to.offset").alias("offset"),
    )


def _plain(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, (T.NumericType, T.StringType))


def op1_best_fit_pack(spark, sf_dir: str) -> DataFrame:
    """documents in sequences of at most 2048 tokens, as many documents and the square as attention cost."""
    import public_tokenizers

    docs = read_spread(spark, f"{sf_dir}/documents.parquet")
    made = tokenize_pieces(docs, public_tokenizers.path("word_bpe_49k.json"), with_ids=False)
    pieces = durable(made, "pieces")
    packed = best_fit_pack(pieces, Capacity(tokens=2048, documents=2048, attention=2048 * 2048))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
