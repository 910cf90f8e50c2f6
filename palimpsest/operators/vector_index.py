"""An inverted file over vectors: approximate candidates without a scan of every row.

Centroids are fitted on a bounded sample. Every row is filed under its nearest one, in
Parquet partitioned by list, so that a search reads just the lists nearest to its questions. A
list is searched in chunks of bounded size: its rows and its questions meet as two matrices,
and only the best of each chunk go on.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SAMPLE = 65_536  # rows that centroids are fitted on, at most
LISTS = 1024  # centroids, at most: the table of them stays small
CHUNK = 8192  # rows of a list that one task compares at once
FILED = 16_384  # rows with their vectors that leave a task at once
ROUNDS = 12


def _unit(x: np.ndarray) -> np.ndarray:
    size = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return np.divide(x, size, out=np.zeros_like(x), where=size > 0)


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def usable(rows: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, v): rows whose vector is there, of finite components and not zero; no other can be near to anything."""
    v = F.col(vec_col).cast("array<double>")
    ok = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return rows.where(F.col(id_col).isNotNull() & ok).select(F.col(id_col).alias("id"), v.alias("v"))


def fit_centroids(vectors: DataFrame, lists: int | None = None, sample: int = SAMPLE, seed: int = 7) -> np.ndarray:
    """Unit centroids by spherical k-means over at most ``sample`` of vectors(id, v): those of the least hashes of
    their ids. Without ``lists`` their number is the root of that of the sample."""
    some = vectors.orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(sample).select("v").toArrow()
    if not some.num_rows:
        return np.zeros((0, 0))
    x = _unit(_matrix(some["v"], len(some["v"][0])))
    k = min(lists or max(1, int(np.sqrt(len(x)))), LISTS, len(x))
    c = x[np.random.default_rng(seed).permutation(len(x))[:k]]
    for _ in range(ROUNDS):
        near = (x @ c.T).argmax(axis=1)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        empty = np.bincount(near, minlength=k) == 0
        total[empty] = x[(x @ c.T).max(axis=1).argsort()[: empty.sum()]]  # what fits worst begins a list of its own
        c = _unit(total)
    return c


def _nearest(rows: DataFrame, centroids: np.ndarray, n: int) -> DataFrame:
    """rows(id, v) with ``list`` and its ``place`` from 0, once for each of the ``n`` nearest centroids."""
    shared, most = rows.sparkSession.sparkContext.broadcast(centroids), FILED  # LISTS vectors at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        step = max(1, most // max(1, min(n, len(c))))  # a row goes out once for each of its lists
        for whole in batches:
            for lo in range(0, whole.num_rows if len(c) else 0, step):
                b = whole.slice(lo, step)
                score = _unit(_matrix(b.column(1), c.shape[1])) @ c.T
                best = np.argsort(-score, axis=1, kind="stable")[:, : min(n, len(c))]
                at = pa.array(np.repeat(np.arange(b.num_rows), best.shape[1]))
                place = pa.array(np.tile(np.arange(best.shape[1], dtype=np.int32), b.num_rows))
                yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(best.ravel().astype(np.int32)), place], ["id", "v", "list", "place"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, v array<double>, list int, place int")


def _meet(k: int):
    """The ``k`` best rows of a chunk for each of its questions, by cosine; some questions at a time."""

    def best(rows: pa.Table, qs: pa.Table) -> pa.Table:
        out = [pa.table({"qid": qs["qid"].slice(0, 0), "id": rows["id"].slice(0, 0), "score": pa.array([], pa.float64())})]
        if rows.num_rows and qs.num_rows:
            rows = rows.sort_by("id")  # so that ties keep the smaller ids
            dim = len(rows["v"][0])
            x = _unit(_matrix(rows["v"], dim))
            for at in range(0, qs.num_rows, 1024):
                some = qs.slice(at, 1024)
                score = np.round(_unit(_matrix(some["v"], dim)) @ x.T, 9)
                top = np.argsort(-score, axis=1, kind="stable")[:, :k]
                q = pa.array(np.repeat(np.arange(len(top)), top.shape[1]))
                out.append(pa.table({"qid": some["qid"].take(q), "id": rows["id"].take(pa.array(top.ravel())), "score": np.take_along_axis(score, top, axis=1).ravel()}))
        return pa.concat_tables(out)

    return best


def _first(met: DataFrame, k: int, but_itself: bool) -> DataFrame:
    met = met.where("qid <> id") if but_itself else met
    w = W.partitionBy("qid").orderBy(F.desc("score"), "id")
    return met.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


class VectorIndex:
    """What build wrote: every usable row of one width, filed by list, and the centroids beside it."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root
        meta = json.loads(spark.read.text(f"{root}/centroids", wholetext=True).first()[0])
        self.centroids = np.asarray(meta["centroids"], dtype=np.float64).reshape(-1, max(1, meta["dim"]))
        self.columns = meta["columns"]

    @classmethod
    def build(cls, rows: DataFrame, root: str, id_col: str = "id", vec_col: str = "embedding", keep: tuple[str, ...] = (), lists: int | None = None, sample: int = SAMPLE) -> VectorIndex:
        """Files ``rows`` under ``root``. ``keep`` are columns that searches filter by. Rows without a usable vector are
        left out; vectors of several widths are refused."""
        spark = rows.sparkSession
        v = usable(rows, id_col, vec_col)
        width = v.agg(F.min(F.size("v")).alias("lo"), F.max(F.size("v")).alias("hi")).first()
        if width["lo"] != width["hi"]:
            raise ValueError(f"vectors of {width['lo']} to {width['hi']} components cannot share an index")
        centroids = fit_centroids(v, lists, sample)
        filed = _nearest(v, centroids, 1).drop("place")
        if keep:
            filed = filed.join(rows.select(F.col(id_col).alias("id"), *keep), "id")
        filed.repartition("list", F.pmod(F.xxhash64("id"), F.lit(8))).write.mode("overwrite").partitionBy("list").parquet(f"{root}/rows")
        meta = {"centroids": centroids.ravel().tolist(), "dim": int(width["hi"] or 0), "columns": [[f.name, f.dataType.simpleString()] for f in filed.schema]}
        spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode("overwrite").text(f"{root}/centroids")
        return cls(spark, root)

    def rows(self) -> DataFrame:
        """Every filed row; a condition on ``list`` prunes the folders that are read."""
        fields = ", ".join(f"`{n}` {t}" for n, t in self.columns)
        return self.spark.read.schema(fields).parquet(f"{self.root}/rows")

    def search(self, queries: DataFrame, k: int, probes: int, id_col: str = "id", vec_col: str = "embedding", where: Column | None = None, but_itself: bool = False) -> DataFrame:
        """(qid, id, score, rank): for each row of ``queries`` the ``k`` best of the ``probes`` lists nearest to it, by cosine
        to nine digits, ties to the smaller id. ``where`` filters the filed rows before they are compared."""
        asked = _nearest(usable(queries, id_col, vec_col), self.centroids, probes).withColumnRenamed("id", "qid")
        filed = self.rows() if where is None else self.rows().where(where)
        wanted = asked.groupBy("list").agg(F.count(F.lit(1)).alias("asked"))
        chunks = filed.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / CHUNK).alias("chunks")).join(wanted, "list").select("list", "chunks")
        left = filed.select("id", "v", "list").join(chunks, "list").select("list", F.pmod(F.xxhash64("id"), F.col("chunks")).alias("chunk"), "id", "v")
        right = asked.join(chunks, "list").select("list", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk"), "qid", "v")
        kind, asks = filed.schema["id"].dataType.simpleString(), asked.schema["qid"].dataType.simpleString()
        met = left.groupBy("list", "chunk").cogroup(right.groupBy("list", "chunk")).applyInArrow(_meet(k + but_itself), f"qid {asks}, id {kind}, score double")
        return _first(met, k, but_itself)

    def probes_for(self, queries: DataFrame, k: int, target: float = 0.9, id_col: str = "id", vec_col: str = "embedding", asked: int = 256) -> tuple[int, float]:
        """(probes, recall): the fewest lists that hold ``target`` of the true ``k`` nearest of a sample of ``queries``, and
        the share they hold. At most ``asked`` questions meet every row; each true neighbour then tells how far down
        its question's order of lists it is filed."""
        some = queries.where(F.col(id_col).isNotNull()).orderBy(F.xxhash64(id_col), id_col).limit(asked)
        filed = self.rows()
        truth = exact_search(filed, some, k, id_col, vec_col, filed_as=("id", "v"))
        order = _nearest(usable(some, id_col, vec_col), self.centroids, len(self.centroids)).select(F.col("id").alias("qid"), "list", "place")
        at = truth.join(filed.select("id", "list"), "id").join(order, ["qid", "list"]).groupBy("place").agg(F.count(F.lit(1)).alias("n"))
        found = np.zeros(len(self.centroids))
        for r in at.collect():  # as many rows as there are lists
            found[r["place"]] = r["n"]
        share = found.cumsum() / max(1, found.sum())
        probes = int(np.argmax(share >= target)) + 1 if found.any() else len(share)
        return probes, float(share[probes - 1]) if found.any() else 1.0

    def candidates(self, queries: DataFrame, linked: DataFrame, pool: int = 200, probes: int = 16, id_col: str = "id", vec_col: str = "embedding", where: Column | None = None) -> DataFrame:
        """(qid, id, origin): the ``pool`` nearest of each question, and what linked(qid, id) adds to them."""
        near = self.search(queries, pool, probes, id_col, vec_col, where).select("qid", "id", F.lit("vector").alias("origin"))
        more = linked.select("qid", "id").distinct().join(near, ["qid", "id"], "left_anti").withColumn("origin", F.lit("graph"))
        return near.unionByName(more)


def exact_search(rows: DataFrame, queries: DataFrame, k: int, id_col: str = "id", vec_col: str = "embedding", but_itself: bool = False, filed_as: tuple[str, str] | None = None) -> DataFrame:
    """What search would give if it looked into every list: one list of chunks. ``filed_as`` names the columns of ``rows``
    where they are not those of ``queries``."""
    v = usable(rows, *(filed_as or (id_col, vec_col)))
    n = max(1, -(-v.count() // CHUNK))
    left = v.withColumn("chunk", F.pmod(F.xxhash64("id"), F.lit(n)))
    right = usable(queries, id_col, vec_col).withColumnRenamed("id", "qid").withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))
    kind = v.schema["id"].dataType.simpleString()

    met = left.groupBy("chunk").cogroup(right.groupBy("chunk")).applyInArrow(_meet(k + but_itself), f"qid {kind}, id {kind}, score double")
    return _first(met, k, but_itself)


def recall(found: DataFrame, truth: DataFrame) -> DataFrame:
    """(questions, recall): the mean share of truth(qid, id) that found(qid, id) has."""
    hit = found.select("qid", "id").withColumn("hit", F.lit(1))
    each = truth.select("qid", "id").join(hit, ["qid", "id"], "left").groupBy("qid").agg(F.avg(F.coalesce("hit", F.lit(0))).alias("r"))
    return each.agg(F.count(F.lit(1)).alias("questions"), F.avg("r").alias("recall"))
