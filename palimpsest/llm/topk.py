"""Exact inner-product top-k by a three-phase uniform threshold.

A vector's dimensions are cut into ``lists`` groups; a candidate's score is the sum
of its partial scores in them. Phase one gathers from every block of rows the best
partial scores of each list, with the totals of those rows; the k-th best total
gathered is a safe cutoff. Phase two sends the cutoff t back to the blocks: a row
whose total reaches t has a partial score of at least t / lists somewhere, so only
such entries are collected, and a list that no row of a block can bring there, by the
lengths of its vectors, is not multiplied at all. Phase three resolves just those
entries exactly and ranks what reaches t.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.llm.work import durable, own_columns

ROWS = 8192  # candidates in a block
QUERIES = 8192  # queries in a block
STEP = 256  # queries scored at once inside a block
PAIRS = 65536  # entries resolved at once
FLOOR = -(1 << 63)


def whole_vectors(table: DataFrame, scale: float = 64.0, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, v): v = floor(scale * x) as longs. Null vectors, and those with a null or
    non-finite component, take no part; of several rows with one id the least counts."""
    ok = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    src = own_columns(table, id_col, vec_col)
    v = src.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v"))
    v = v.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull()).where(ok)
    return v.select("vec_id", F.transform("v", lambda x: F.floor(x * F.lit(scale))).alias("v")).groupBy("vec_id").agg(F.min("v").alias("v"))


def _blocks(rows: DataFrame, size: int, with_cut: bool = False) -> DataFrame:
    """(dim, block, blocks, ids, vectors[, cuts]): at most about ``size`` rows packed in one row."""
    n = rows.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).select("dim", F.ceil(F.col("n") / size).cast("int").alias("blocks"))
    cut = "cut" if with_cut else "vec_id"
    dealt = rows.join(n, "dim").withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int"))

    def pack(t: pa.Table) -> pa.Table:
        m = t["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype("<i8")
        row = {k: t[k].slice(0, 1).combine_chunks() for k in ("dim", "block", "blocks")}
        row["ids"] = pa.array([t["vec_id"].to_numpy().astype("<i8").tobytes()], pa.binary())
        row["vectors"] = pa.array([m.tobytes()], pa.binary())
        row["cuts"] = pa.array([t[cut].to_numpy().astype("<i8").tobytes()], pa.binary())
        return pa.table(row)

    return dealt.groupBy("dim", "block").applyInArrow(pack, "dim int, block int, blocks int, ids binary, vectors binary, cuts binary")


def _pairs(queries: DataFrame, rows: DataFrame) -> DataFrame:
    """Every block of queries beside every block of rows of its dimension."""
    q, r = queries.toDF("dim", "qb", "qn", "q_ids", "q_vectors", "cuts"), rows.drop("cuts").toDF("dim", "rb", "rn", "r_ids", "r_vectors")
    n = rows.select("dim", F.col("blocks").alias("rn")).distinct()
    m = queries.select("dim", F.col("blocks").alias("qn")).distinct()
    q = q.join(n, "dim").withColumn("rb", F.explode(F.sequence(F.lit(0), F.col("rn") - 1))).drop("rn")
    r = r.drop("rn").join(m, "dim").withColumn("qb", F.explode(F.sequence(F.lit(0), F.col("qn") - 1))).drop("qn")
    return q.drop("qn").join(r, ["dim", "qb", "rb"]).select("dim", "q_ids", "q_vectors", "cuts", "r_ids", "r_vectors")


def _groups(dim: int, lists: int) -> list[slice]:
    edge = np.linspace(0, dim, min(lists, max(dim, 1)) + 1).astype(int)
    return [slice(a, b) for a, b in zip(edge[:-1], edge[1:], strict=True)]


def _exact(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pair in the cheapest type in which their inner products are exact."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    kind = np.float32 if most < 2**24 else np.float64 if most < 2**53 else np.int64
    return a.astype(kind), b.astype(kind)


def _blocks_of(batches, lists: int):
    """For each STEP of queries of each pair: query ids, cuts, row ids, their vectors, and for each list its dimensions
    and the rows' part of it, in a type in which products are exact."""
    for batch in batches:
        for r in batch.to_pylist():
            dim = r["dim"]
            qi, ri = np.frombuffer(r["q_ids"], "<i8"), np.frombuffer(r["r_ids"], "<i8")
            cut = np.frombuffer(r["cuts"], "<i8")
            q = np.frombuffer(r["q_vectors"], "<i8").reshape(len(qi), dim)
            x = np.frombuffer(r["r_vectors"], "<i8").reshape(len(ri), dim)
            _, typed = _exact(q, x)
            parts = [(g, np.ascontiguousarray(typed[:, g].T)) for g in _groups(dim, lists)]
            for i in range(0, len(qi), STEP):
                some = slice(i, i + STEP)
                yield qi[some], cut[some], ri, q[some], x, parts


def _scored(batches, lists: int):
    """For each STEP of queries of each pair: query ids, row ids, partial scores."""
    for qi, _, ri, q, _, parts in _blocks_of(batches, lists):
        yield qi, ri, [q[:, g].astype(p.dtype) @ p for g, p in parts]


def _enough(q: np.ndarray, x: np.ndarray, cut: np.ndarray, parts: list) -> tuple[np.ndarray, np.ndarray]:
    """(query, row) of the entries that reach cut / lists in some list."""
    t = np.where(cut == FLOOR, -np.inf, cut.astype(np.float64) / len(parts))
    t -= 1e-9 * np.maximum(1, np.abs(np.where(np.isfinite(t), t, 0)))  # rounding may only admit more
    found = []
    for g, p in parts:
        longest = np.sqrt((p.astype(np.float64) ** 2).sum(axis=0).max(initial=0))
        own = np.sqrt((q[:, g].astype(np.float64) ** 2).sum(axis=1))
        can = np.flatnonzero(own * longest * (1 + 1e-9) >= t)
        if len(can):
            a, b = np.nonzero(q[can][:, g].astype(p.dtype) @ p >= t[can][:, None])
            found.append(can[a] * len(x) + b)
    code = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
    return np.divmod(code, max(1, len(x)))


def local_lists(pairs: DataFrame, k: int, lists: int) -> DataFrame:
    """Phase one: (query_id, score) of the rows that lead some list of some block."""

    def run(batches):
        for qi, ri, parts in _scored(batches, lists):
            n = min(k + 1, len(ri))  # one more, as the query itself may be among them
            lead = [np.argpartition(-p, n - 1, axis=1)[:, :n] if n < len(ri) else np.tile(np.arange(len(ri)), (len(qi), 1)) for p in parts]
            at = np.sort(np.concatenate(lead, axis=1), axis=1)
            total = sum(np.take_along_axis(p, at, axis=1) for p in parts).astype(np.int64)
            use = np.ones(at.shape, bool)
            use[:, 1:] = at[:, 1:] != at[:, :-1]
            use &= ri[at] != qi[:, None]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.broadcast_to(qi[:, None], at.shape)[use]), pa.array(total[use])], ["query_id", "score"]
            )

    return pairs.mapInArrow(run, "query_id long, score long")


def sufficient(pairs: DataFrame, k: int, lists: int) -> DataFrame:
    """Phases two and three in each block: (query_id, vec_id, score) of what reaches the cutoff,
    the best k of a block by score and then by smaller id."""

    def run(batches):
        for qi, cut, ri, q, x, parts in _blocks_of(batches, lists):
            a, b = _enough(q, x, cut, parts)
            score = np.concatenate([np.zeros(0, np.int64), *[np.einsum("ij,ij->i", q[a[i : i + PAIRS]], x[b[i : i + PAIRS]]) for i in range(0, len(a), PAIRS)]])
            ok = (score >= cut[a]) & (ri[b] != qi[a])
            a, b, score = a[ok], b[ok], score[ok]
            order = np.lexsort((ri[b], -score, a))
            a, b, score = a[order], b[order], score[order]
            first = np.searchsorted(a, a, side="left")
            top = np.arange(len(a)) - first < k
            yield pa.RecordBatch.from_arrays(
                [pa.array(qi[a[top]]), pa.array(ri[b[top]]), pa.array(score[top])], ["query_id", "vec_id", "score"]
            )

    return pairs.mapInArrow(run, "query_id long, vec_id long, score long")


def exact_top_k(vectors: DataFrame, queries: DataFrame, k: int, lists: int = 2) -> DataFrame:
    """(query_id, rank, vec_id, score): for each of ``queries`` its k best of ``vectors``.

    Both have (vec_id, v array<long>); a query never finds its own id, and vectors of
    another length take no part in it. Scores must fit a long. Queries meet rows in
    blocks, each pair of blocks in a task of its own.
    """
    dim = F.size("v").cast("int")
    rows = durable(_blocks(vectors.withColumn("dim", dim), ROWS), "row-blocks")
    asked = queries.select("vec_id", "v").withColumn("dim", dim)
    one = _pairs(_blocks(asked, QUERIES), rows)
    w = W.partitionBy("query_id").orderBy(F.desc("score"))
    led = local_lists(one, k, lists).withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k)
    cut = led.where(F.col("rn") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("cut"))
    cut = durable(asked.join(cut, "vec_id", "left").fillna({"cut": FLOOR}), "cutoffs")
    two = _pairs(_blocks(cut, QUERIES, with_cut=True), rows)
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = sufficient(two, k, lists).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op2_exact_topk(spark, sf_dir: str) -> DataFrame:
    """Each query's 20 best rows of all embeddings. Rows with a null vector, or null or non-finite components, take no part; ties go to the smaller vec_id."""
    v = durable(whole_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet")), "vectors")
    return exact_top_k(v, v.where("vec_id % 20 = 0"), 20)


OP2_SQL = """
WITH v AS (
  SELECT vec_id, min(list_transform(embedding, lambda x: floor(64 * x::DOUBLE))) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
  GROUP BY vec_id),
p AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e)
  WHERE q.vec_id % 20 = 0),
r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
  FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
