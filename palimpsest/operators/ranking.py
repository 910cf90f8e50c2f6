"""Scoring and rank fusion: BM25, vector top-k, reciprocal rank fusion, merges of ranked lists."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from palimpsest.functions import text as T
from palimpsest.functions import vectors as Vec
from palimpsest.operators.ordering import spread_rank


BLOCK = 1024  # vectors of a group on one side of a task


def bm25(docs: DataFrame, query: str, id_col: str = "id", text_col: str = "text", k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """(id, score) of the documents that hold a query term.

    Corpus figures come from all of ``docs``. Terms outside the query are dropped before
    the only explode, so the shuffle carries query hits and not the vocabulary.
    """
    terms = sorted(set(T.py_stems(query)))
    toks = docs.select(F.col(id_col).alias("id"), T.stems(F.col(text_col)).alias("t")).withColumn("dl", F.size("t"))
    q = T.words(*terms)
    corpus = toks.agg(F.count(F.lit(1)).alias("n"), F.greatest(F.lit(1.0), F.avg("dl")).alias("avgdl"))
    hits = toks.select("id", "dl", F.explode(F.filter("t", lambda x: F.array_contains(q, x))).alias("term"))
    tf = hits.groupBy("id", "dl", "term").agg(F.count(F.lit(1)).alias("tf"))
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))  # at most as many rows as the query has terms
    x = tf.join(F.broadcast(df), "term").crossJoin(F.broadcast(corpus))  # one row of corpus figures
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * (F.col("tf") * (k1 + 1)) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    return x.groupBy("id").agg(F.round(F.sum(part), 9).alias("score"))


def term_document_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    return docs.select(F.explode(F.array_distinct(T.stems(F.col(text_col)))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def vector_top_k(rows: DataFrame, query: list[float], k: int, vec_col: str, id_col: str, where: Column | None = None) -> DataFrame:
    """Exact cosine top-k, ties to the smaller id; k rows per task reach the last step."""
    src = rows.where(where) if where is not None else rows
    q = F.array(*[F.lit(float(x)) for x in query])
    return src.select(F.col(id_col), F.round(Vec.cosine(F.col(vec_col), q), 9).alias("score")).orderBy(F.desc("score"), id_col).limit(k)


def rank_by(scores: DataFrame, score: str = "score", tie: str = "id", by: tuple[str, ...] = (), spread: bool = False) -> DataFrame:
    """Ranks from 1; with ``spread`` a group may be larger than a task holds."""
    if spread:
        return spread_rank(scores, [F.desc(score), F.asc(tie)], by)
    return scores.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(F.desc(score), tie)))


def weighted_rrf(ranked: DataFrame, weights: dict[str, float], k: int = 60, by: tuple[str, ...] = ()) -> DataFrame:
    """(.., id, fused): the sum of weight / (k + rank) over signals; ``ranked`` has signal, id and rank."""
    w = F.create_map(*[x for s, v in weights.items() for x in (F.lit(s), F.lit(float(v)))])
    return ranked.groupBy(*by, "id").agg(F.round(F.sum(w[F.col("signal")] / (F.lit(k) + F.col("rank"))), 12).alias("fused"))


def minmax(scores: DataFrame, score: str = "score", by: tuple[str, ...] = ()) -> DataFrame:
    """Scaled to [0, 1]; all 1 where they are equal."""
    w = W.partitionBy(*by)
    lo, hi = F.min(score).over(w), F.max(score).over(w)
    return scores.withColumn("scaled", F.when(hi - lo < 1e-12, F.lit(1.0)).otherwise((F.col(score) - lo) / (hi - lo)))


def interleave(ranked: DataFrame, k: int) -> DataFrame:
    """Round robin over lists (list_no, rank, id): first places first, each id once, k in all."""
    best = ranked.groupBy("id").agg(F.min(F.struct("rank", "list_no")).alias("m"))
    return best.orderBy("m.rank", "m.list_no").limit(k).select("id", "m.rank", "m.list_no")


def promote(promoted: DataFrame, retrieved: DataFrame, k: int) -> DataFrame:
    """At most max(1, k // 2) promoted ids, then the retrieved, then promoted ones again; both have (id, rank)."""
    head = max(1, k // 2)
    a = promoted.select("id", F.when(F.col("rank") <= head, 0).otherwise(2).alias("tier"), "rank")
    b = retrieved.select("id", F.lit(1).alias("tier"), "rank")
    best = a.unionByName(b).groupBy("id").agg(F.min(F.struct("tier", "rank")).alias("m"))
    return best.orderBy("m.tier", "m.rank").limit(k).select("id", "m.tier", "m.rank")


def without(rows: DataFrame, shown: DataFrame, id_col: str = "id") -> DataFrame:
    """``rows`` whose id is not among those shown already."""
    return rows.join(shown.select(id_col).distinct(), id_col, "left_anti")


def fill(first: DataFrame, more: DataFrame, keys: list[str]) -> DataFrame:
    """``first`` as of origin model, and what it lacks of ``more`` by ``keys`` as of origin rule."""
    rest = more.join(first.select(*keys).distinct(), keys, "left_anti")
    return first.withColumn("origin", F.lit("model")).unionByName(rest.withColumn("origin", F.lit("rule")))


def candidate_pool(rows: DataFrame, query: list[float], linked: DataFrame, pool: int = 200, vec_col: str = "embedding", id_col: str = "id") -> DataFrame:
    """A bounded set of candidates: the ``pool`` nearest by vector, and what the graph links to the query though it is
    not among them."""
    near = vector_top_k(rows, query, pool, vec_col, id_col).select(id_col, F.lit("vector").alias("origin"))
    return near.unionByName(without(linked.select(id_col).distinct(), near, id_col).withColumn("origin", F.lit("graph")))


def near_pairs(rows: DataFrame, by: str, id_col: str, vec_col: str, lo: float, hi: float, unlike: Column | None = None) -> DataFrame:
    """Pairs of one group whose cosine lies within [lo, hi]; each pair once, smaller id first. Rows that are
    equal in ``unlike``, a string, make none.

    A group is dealt into parts of about BLOCK vectors, and every two of its parts meet in one task
    of bounded size, as matrices: a large group spreads over tasks, and only what lies within the
    bounds leaves them. The work stays the square of a group.
    """
    base = rows.select(F.col(by).alias("g"), F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("v"), F.lit(None).cast("string").alias("u") if unlike is None else unlike.alias("u"))
    base = base.where("g IS NOT NULL AND id IS NOT NULL AND v IS NOT NULL")
    parts = base.groupBy("g").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("parts"))
    dealt = base.join(parts, "g").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")))
    dealt = dealt.withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    meet = dealt.select("g", F.least("part", "o").alias("x"), F.greatest("part", "o").alias("y"), (F.col("part") > F.col("o")).alias("side"), "id", "v", "u")
    base_id = base.schema["id"].dataType
    kind, of_id, to_id = base.schema["g"].dataType.simpleString(), base_id.simpleString(), to_arrow_type(base_id)

    tell_apart = unlike is not None

    def within(t: pa.Table) -> pa.Table:
        side, ids = t["side"].to_numpy(), t["id"].to_numpy(zero_copy_only=False)
        said = t["u"].to_numpy(zero_copy_only=False)
        width = pc.list_value_length(t["v"]).to_numpy()
        out = []
        for d in np.unique(width[width > 0]).tolist():
            at = np.flatnonzero(width == d)
            v = t["v"].take(pa.array(at)).combine_chunks().flatten().to_numpy().reshape(len(at), d)
            size = np.sqrt((v * v).sum(axis=1))
            v, at = v[size > 0] / size[size > 0, None], at[size > 0]
            left, right = (np.flatnonzero(side[at] == s) for s in (False, True)) if side.any() else (np.arange(len(at)),) * 2
            near = np.round(v[left] @ v[right].T, 9)
            i, j = np.nonzero((near >= lo) & (near <= hi))
            a, b = ids[at[left[i]]], ids[at[right[j]]]
            ok = a < b if not side.any() else a != b
            if tell_apart:
                ok &= said[at[left[i]]] != said[at[right[j]]]
            out.append((np.minimum(a, b)[ok], np.maximum(a, b)[ok], near[i, j][ok]))
        a, b, s = (np.concatenate([o[k] for o in out]) if out else np.zeros(0, (ids.dtype, ids.dtype, float)[k]) for k in range(3))
        return pa.table({"g": pa.array([t["g"][0].as_py()] * len(a), t["g"].type), "a": pa.array(a, to_id), "b": pa.array(b, to_id), "similarity": s})

    got = meet.groupBy("g", "x", "y").applyInArrow(within, f"g {kind}, a {of_id}, b {of_id}, similarity double")
    return got.withColumnRenamed("g", by)


def page(rows: DataFrame, order: list, offset: int = 0, limit: int | None = None, most: int = 500) -> tuple[DataFrame, dict]:
    """One page and its total, has_more and next_offset; limits are clamped to [0, most]."""
    start = max(0, offset)
    total = rows.count()
    size = None if limit is None else max(0, min(limit, most))
    out = rows.orderBy(*order).offset(start)
    after = None if not size or start + size >= total else start + size
    return (out if size is None else out.limit(size)), {"total": total, "offset": start, "limit": size, "has_more": after is not None, "next_offset": after}
