"""Tables written to the cluster's shared folder, to cut lineage and survive lost executors."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_scopes: list[list[DataFrame]] = []  # what was written within each settled() that is still at work


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; where it is unset, a local session gets its own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="palimpsest-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def durable(df: DataFrame, name: str) -> DataFrame:
    """df written once as Parquet in the shared folder and read back; removed by discard, or when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/palimpsest/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    out = spark.read.schema(df.schema).parquet(path)
    out.durable_path = path
    if _scopes:
        _scopes[-1].append(out)
    return out


def settled(make: Callable[[], DataFrame], name: str) -> DataFrame:
    """durable(make(), name), without the tables that were written on the way."""
    _scopes.append([])
    try:
        made = make()
        tables = _scopes[-1]
    finally:
        _scopes.pop()
    out = durable(made, name)
    discard(*tables)
    return out


def discard(*tables: DataFrame) -> None:
    """Removes what durable wrote; nothing that is still to be computed may read it."""
    for df in tables:
        sc = df.sparkSession.sparkContext
        where = sc._jvm.org.apache.hadoop.fs.Path(df.durable_path)
        where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)


def read_spread(spark: SparkSession, path: str) -> DataFrame:
    """The table, dealt out anew where it has fewer splits than there are cores: work on a text costs far
    more than its way to another task. A table of many splits is read as it lies."""
    df = spark.read.parquet(path)
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt by ``keys`` to as many tasks as the session shuffles to: what follows costs far more than its bytes tell."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def own_columns(df: DataFrame, *names: str) -> DataFrame:
    """Just the named columns; others, whatever their names, do not reach the operator."""
    return df.select(*[df[f"`{n}`"] for n in names])
