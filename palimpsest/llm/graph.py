"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.work import discard, durable


def _mark(df: DataFrame) -> tuple:
    r = df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(r)


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """edges(a, b) as (node, root): the smallest node of each component, for nodes with an edge.

    Each round keeps at most as many edges as it was given, aggregates by min with
    map-side combining, and writes its result to the shared folder. Loops, repeated
    and reversed edges and nulls are harmless: nulls take no part.
    """
    e = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    e = durable(e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = _mark(e)
    for _ in range(most_rounds):
        if not mark[0]:
            break
        both = e.union(e.select("b", "a")).toDF("u", "v")
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        large = durable(large.distinct(), "large-star")  # a > b holds: b <= u < v
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        old, e = e, durable(small.union(low.toDF("a", "b")).distinct(), "small-star")
        before, mark = mark, _mark(e)
        discard(old, large)
        if mark == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).union(e.select("b", "b").distinct())
