"""Versioned Parquet store: each save is a new folder, and the newest of numbered commits names the current one.

A commit is a file that is created only if there is none of its number: of two writers that
read one version exactly one makes the next, and readers see a version whole or not at all.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.operators.health import save_guard
from palimpsest.operators.ordering import spread_rank

SCHEMA_VERSION = 1
TABLES = ("episodes", "facts", "entities", "relations", "working", "conflicts")


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _create_new(spark: SparkSession, path: str, text: str) -> bool:
    """The file, whole, unless there is one already; whether it was made. A local file is written beside and linked,
    others are created by their store, both in one step."""
    jvm, fs, p = _fs(spark, path)
    local = fs.getScheme() == "file"
    to = jvm.org.apache.hadoop.fs.Path(p.getParent(), f".{uuid.uuid4().hex}") if local else p
    try:
        out = fs.create(to, False)
        out.write(bytearray(text.encode()))
        out.close()
        if local:
            jvm.java.nio.file.Files.createLink(*[jvm.java.io.File(x.toUri().getPath()).toPath() for x in (p, to)])
    except Py4JJavaError as e:
        if "AlreadyExists" in e.java_exception.getClass().getName():
            return False
        raise
    finally:
        if local:
            fs.delete(to, False)
    return True


def _commits(spark: SparkSession, root: str) -> list[int]:
    _, fs, p = _fs(spark, f"{root}/commits")
    names = [f.getPath().getName() for f in fs.listStatus(p)] if fs.exists(p) else []
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[0] != ".")


def read_manifest(spark: SparkSession, root: str) -> dict | None:
    """The newest commit, with its number."""
    found = _commits(spark, root)
    if not found:
        return None
    text = spark.read.text(f"{root}/commits/{found[-1]:012d}.json", wholetext=True).first()[0]
    return {**json.loads(text), "commit": found[-1]}


def current_version(spark: SparkSession, root: str) -> str | None:
    """What tells a reader whether the store has changed since it was opened."""
    return (read_manifest(spark, root) or {}).get("version")


def save(
    spark: SparkSession, root: str, tables: dict[str, DataFrame], embedder: str = "hashing", dim: int = 256, state: dict | None = None, expected: str | None = None
) -> dict:
    """Tables first, their commit last; a torn save leaves the old version current. With ``expected``, the save is
    refused if another writer has saved since that version was read, however close in time; without, the last wins."""
    version = uuid.uuid4().hex[:12]
    counts = {}
    for name, df in tables.items():
        part = ["user_id"] if "user_id" in df.columns else []
        df.write.partitionBy(*part).parquet(f"{root}/{version}/{name}")
        counts[name] = spark.read.schema(df.schema).parquet(f"{root}/{version}/{name}").count()
    manifest = {"schema_version": SCHEMA_VERSION, "embedder_id": embedder, "embedding_dim": dim, "version": version, "counts": counts, "state": state or {}}
    manifest["schemas"] = {name: df.schema.json() for name, df in tables.items()}
    while True:
        now = read_manifest(spark, root) or {"commit": 0, "version": None}
        if expected is not None and now["version"] != expected:
            raise ValueError("another writer has saved since this version was read")
        if _create_new(spark, f"{root}/commits/{now['commit'] + 1:012d}.json", json.dumps(manifest)):
            return manifest


def committed_lines(spark: SparkSession, path: str, n: int) -> DataFrame:
    """(no, line): the first ``n`` lines of a log whose tail may be torn. A log that is shorter, or malformed within
    them, is refused; what stands behind them does not count."""
    rows = spark.read.text(path).select(F.monotonically_increasing_id().alias("_at"), F.col("value").alias("line"))
    first = spread_rank(rows, [F.asc("_at")], out="no").where(F.col("no") <= n).select("no", "line")
    found = first.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.from_json("line", "map<string,string>").isNull()).alias("bad")).first()
    if found["n"] < n:
        raise ValueError(f"the log has {found['n']} lines, not the {n} that its manifest names")
    if found["bad"]:
        raise ValueError(f"{found['bad']} of the committed lines are malformed")
    return first


def convert(spark: SparkSession, logs: dict[str, tuple[str, int]], root: str, schemas: dict[str, str], dry_run: bool = False) -> dict[str, int]:
    """Line logs {name: (path, committed lines)} as a store of this form; a dry run only counts."""
    read = {name: committed_lines(spark, path, n).select(F.from_json("line", schemas[name]).alias("r")).select("r.*") for name, (path, n) in logs.items()}
    if not dry_run:
        return save(spark, root, read)["counts"]
    return {name: df.count() for name, df in read.items()}


class Documents:
    """A table by id: put, get, scan and delete. Conditions are Column expressions, so they reach the scan."""

    def __init__(self, table: DataFrame, id_col: str = "id"):
        self.table, self.id_col = table, id_col

    def put(self, rows: DataFrame) -> Documents:
        rest = self.table.join(rows.select(self.id_col), self.id_col, "left_anti").select(*self.table.columns)
        return Documents(rest.unionByName(rows.select(*self.table.columns)), self.id_col)

    def get(self, key) -> DataFrame:
        return self.table.where(F.col(self.id_col) == key)

    def scan(self, where=None) -> DataFrame:
        return self.table if where is None else self.table.where(where)

    def delete(self, keys: DataFrame) -> Documents:
        return Documents(self.table.join(keys.select(self.id_col), self.id_col, "left_anti").select(*self.table.columns), self.id_col)


def load(spark: SparkSession, root: str, embedder: str = "hashing", dim: int = 256) -> dict[str, DataFrame]:
    """The current version; refused if it is newer, of another embedding space, or short of rows."""
    m = read_manifest(spark, root)
    if m is None:
        return {}
    save_guard(m, SCHEMA_VERSION, embedder, dim)
    out = {}
    for name, n in m["counts"].items():
        kind = T.StructType.fromJson(json.loads(m["schemas"][name]))
        out[name] = spark.read.schema(kind).parquet(f"{root}/{m['version']}/{name}")  # an empty table has no file
        if out[name].count() != n:
            raise ValueError(f"{name} has not the {n} rows that the manifest names")
    return out


def restore(snapshot: DataFrame, known: DataFrame) -> DataFrame:
    """Facts of a snapshot that are new, under new ids, with supersedes rewired to them; what they
    replaced outside the snapshot becomes null."""
    at = F.round("valid_at", 1)
    new = snapshot.withColumn("_at", at).join(known.select("subject", "predicate", "object", at.alias("_at")), ["subject", "predicate", "object", "_at"], "left_anti").drop("_at")
    new = new.withColumn("new_id", F.concat(F.lit("fact_"), F.left(F.sha2(F.concat_ws("\x1f", "fact_id", "user_id", "subject", "predicate", "object", "valid_at"), 256), F.lit(12))))
    ids = new.select(F.col("fact_id").alias("supersedes"), F.col("new_id").alias("_sup"))
    return new.join(ids, "supersedes", "left").withColumns({"supersedes": F.col("_sup"), "fact_id": F.col("new_id")}).drop("_sup", "new_id").select(*snapshot.columns)


def export(facts: DataFrame, full: bool = False) -> DataFrame:
    """One JSON object a fact, newest first; without sensitive facts unless all are asked for."""
    rows = facts if full else facts.where(~F.coalesce("sensitive", F.lit(False)))
    return rows.orderBy(F.desc("valid_at")).select(F.to_json(F.struct("*")).alias("value"))
