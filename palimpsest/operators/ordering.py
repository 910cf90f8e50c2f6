"""Ranks and numbers over large groups, without a task that holds a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.session import cut_lineage


def spread_rank(rows: DataFrame, order: list[Column], by: tuple[str, ...] = (), out: str = "rank") -> DataFrame:
    """``rows`` with their rank from 1 in each group of ``by``, ties in no fixed order.

    Rows are dealt by range, so a group spans tasks; each task ranks its share, and what
    lies in the ranges before is added. The offsets are as many as ranges and groups that
    share one, and are joined by range.
    """
    keys = [F.col(c) for c in by]
    dealt = rows.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id())
    dealt = cut_lineage(dealt)  # the part of a row must not change any more
    counts = dealt.groupBy(*by, "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(*by).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offset = counts.select(*by, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    local = F.row_number().over(W.partitionBy(*by, "_part").orderBy(*order))
    ranked = dealt.withColumn("_local", local).join(offset, [*by, "_part"])
    return ranked.withColumn(out, F.col("_local") + F.col("_before")).drop("_local", "_before", "_part")
