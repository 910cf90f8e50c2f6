"""Session factory and table readers."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"  # state with lists, maps and timers
TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def build_session(app: str = "palimpsest", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the plans here rely on: UTC, AQE, Arrow, and state in RocksDB."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.streaming.stateStore.providerClass": ROCKS,
        "spark.ui.enabled": "false",
    }
    for k, v in {**base, **conf}.items():
        b = b.config(k, v)
    return b.getOrCreate()


def local_session(cpus: int | None = None, **conf: str) -> SparkSession:
    """Single-node session for tests and the bench."""
    cpus = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    base = {
        "spark.sql.shuffle.partitions": str(cpus),
        "spark.driver.memory": os.environ.get("BENCH_DRIVER_MEMORY", "8g"),
        "spark.ui.showConsoleProgress": "false",
    }
    return build_session(master=f"local[{cpus}]", **{**base, **conf})


def scratch(spark: SparkSession) -> str:
    """The shared folder that spark.checkpoint.dir names; a local session without one gets its own."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(folder or "file://" + tempfile.mkdtemp(prefix="palimpsest-"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut_lineage(df: DataFrame) -> DataFrame:
    """df checkpointed in the shared folder."""
    scratch(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """df written as Parquet in the shared folder and read back; removed by drop_written, or when the driver ends. Rounds
    that build on each other need this: a checkpoint hands on the estimated size of its plan, which joins multiply, so that
    after some rounds the driver holds numbers of millions of digits. A file's size is what it is."""
    spark = df.sparkSession
    path = f"{scratch(spark)}/written-{uuid.uuid4().hex}"
    df.write.parquet(path)
    fs, where = _file_system(spark, path)
    fs.deleteOnExit(where)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_path = path
    return out


def drop_written(*tables: DataFrame) -> None:
    """Removes what written wrote; nothing that is still to be computed may read it."""
    for df in tables:
        fs, where = _file_system(df.sparkSession, df.written_path)
        fs.delete(where, True)


def _file_system(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
