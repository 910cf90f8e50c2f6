"""A trie of conversation prefixes, rolled up in bands of depth. Only DataFrame functions.

A node is a distinct sequence of first turns; its key is two 64-bit exclusive ors of
hashes of (place, role, text), so that it grows along a conversation without holding it.
Each node knows its ancestors within its band of depths. Within a band, subtree totals
come from one explosion to those ancestors; the roots of the bands make a trie of their
own, some ``height`` times flatter, which is rolled up in the same way, and its totals go
to the ancestors in the band above. So neither the rows made of a node nor the rounds
grow with depth: height rows, and as many levels as the depth has digits to that base.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.llm.work import durable, own_columns

HEIGHT = 16  # depths in a band
FAMILY, HEADS = 5, 9  # conversations that share a head; lengths of heads
ENDS = 4096  # ids in one piece of a node's list of ends
NODE = ["depth", "a", "b"]


def spliced_turns(turns: DataFrame, family: int = FAMILY, heads: int = HEADS) -> DataFrame:
    """(g, conv_id, depth, ha, hb, bytes, before): each rebuilt conversation's turns, and a row of depth 0.

    Conversation c is the first h turns of c - c % family and its own after its first h, where
    h = crc32(c) % heads. Turns lie in the order of (turn, role, text), null turns first; null
    roles and texts are empty. Rows without a conv_id take no part.
    All that is rebuilt from one another has one g, so one shuffle is enough.
    """
    t = own_columns(turns, "conv_id", "turn", "role", "text").where("conv_id IS NOT NULL")
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    t = t.select(F.col("conv_id").cast("long").alias("c"), "turn", empty("role").alias("role"), empty("text").alias("text"))
    t = t.withColumn("g", F.col("c") - F.col("c") % family).repartition("g")
    one, all_of = W.partitionBy("g", "c"), W.partitionBy("g")
    t = t.withColumn("idx", F.row_number().over(one.orderBy(F.col("turn").asc_nulls_first(), "role", "text")).cast("long") - 1)
    t = t.withColumns(
        {
            "members": F.collect_set("c").over(all_of),
            "n_base": F.count(F.when(F.col("c") == F.col("g"), 1)).over(all_of),
            "bytes": F.octet_length("text").cast("long"),
        }
    )
    cut = lambda c: F.crc32(c.cast("string").cast("binary")) % heads
    at = lambda c, depth: F.struct(c.alias("conv_id"), depth.cast("long").alias("depth"))
    c, idx = F.col("c"), F.col("idx")
    none = F.array().cast("array<struct<conv_id:long,depth:long>>")
    root = F.when(idx == 0, F.array(at(c, F.lit(0)))).otherwise(none)
    lent = F.when((c == F.col("g")) & (idx < heads - 1), F.transform(F.filter("members", lambda m: cut(m) > idx), lambda m: at(m, idx + 1))).otherwise(none)
    own = F.when(idx >= cut(c), F.array(at(c, F.least(cut(c), F.col("n_base")) + idx - cut(c) + 1))).otherwise(none)
    t = t.withColumn("to", F.explode(F.concat(root, lent, own)))
    where, real = F.col("to.depth"), F.col("to.depth") > 0
    return t.select(
        "g",
        "to.conv_id",
        where.alias("depth"),
        F.when(real, F.xxhash64(where, "role", "text")).otherwise(F.lit(0).cast("long")).alias("ha"),
        F.when(real, F.xxhash64(F.lit(1), where, "role", "text")).otherwise(F.lit(0).cast("long")).alias("hb"),
        F.when(real, F.col("bytes")).otherwise(F.lit(0).cast("long")).alias("bytes"),
    )


def _band(keys: str, depth, height: int):
    """The last of ``keys`` (a list that ends in a row's own key): those of its band, or for the root of a
    band those of the whole band above and its own."""
    within = depth % height
    n = F.when((within == 0) & (depth > 0), F.lit(height + 1)).otherwise(within + 1).cast("int")
    return F.slice(keys, -n, n)


def prefix_rows(spliced: DataFrame, height: int = HEIGHT) -> DataFrame:
    """(conv_id, depth, a, b, pa, pb, bytes, path, last): for each conversation its nodes from the root on.

    path has the keys of the band's ancestors, the node last; for the root of a band, those of the band above it.
    """
    one = W.partitionBy("g", "conv_id").orderBy("depth")
    key = spliced.withColumns({"a": F.bit_xor("ha").over(one), "b": F.bit_xor("hb").over(one)})
    near = F.collect_list(F.struct("a", "b")).over(one.rowsBetween(-height, 0))
    key = key.withColumns({"near": near, "last": F.lead("depth").over(one).isNull()})
    return key.select(
        "conv_id", *NODE, F.col("a").bitwiseXOR(F.col("ha")).alias("pa"), F.col("b").bitwiseXOR(F.col("hb")).alias("pb"), "bytes", _band("near", F.col("depth"), height).alias("path"), "last"
    )


def _up(rows: DataFrame, step: int, least: int) -> DataFrame:
    """rows(depth, a, b, path, leaves, saved) at each node of their paths that lies ``least`` or more steps of
    ``step`` depths up."""
    up = rows.select("depth", "leaves", "saved", F.posexplode(F.reverse("path")).alias("i", "k"))
    up = up.where(F.col("i") >= least)
    return up.select((F.col("depth") - F.col("i") * step).alias("depth"), "k.a", "k.b", "leaves", "saved")


def subtree_totals(nodes: DataFrame, rows: DataFrame, deepest: int, height: int = HEIGHT, step: int = 1) -> DataFrame:
    """(depth, a, b, leaves, saved): sums over the subtrees of nodes(depth, a, b, path, leaves, saved), all at depths
    that ``step`` divides. ``rows`` are the prefix rows of those depths, from which the paths of the next level come."""
    total = ["leaves", "saved"]
    wide = step * height
    inside = nodes.withColumn("path", F.when(F.col("depth") % wide == 0, F.slice("path", -1, 1)).otherwise(F.col("path")))
    within = _up(inside, step, 0).groupBy(*NODE).agg(*[F.sum(c).alias(c) for c in total])
    if deepest < wide:
        return within
    within = durable(within, "band-totals")
    tops = durable(rows.where(F.col("depth") % wide == 0).select("conv_id", *NODE), "band-rows")
    chain = F.collect_list(F.struct("a", "b")).over(W.partitionBy("conv_id").orderBy("depth").rowsBetween(-height, 0))
    paths = tops.withColumn("near", chain).withColumn("path", _band("near", (F.col("depth") / wide).cast("long"), height))
    paths = paths.groupBy(*NODE).agg(F.first("path").alias("path"))
    roots = durable(paths.join(within, NODE), "band-roots")
    done = subtree_totals(roots, tops, deepest, height, wide)
    below = done.where("depth > 0").join(nodes.select(*NODE, "path"), NODE)
    carried = _up(below, step, 1)
    return within.unionByName(carried).groupBy(*NODE).agg(*[F.sum(c).alias(c) for c in total])


def end_hashes(rows: DataFrame) -> DataFrame:
    """(depth, a, b, ends): the SHA-256 of the ids of the conversations that end at a node, ascending, comma-joined.

    Lists are cut by id into pieces of at most ENDS ids; a list of several pieces streams through the hash.
    """
    ids = rows.where("last").select(*NODE, "conv_id", F.floor(F.col("conv_id") / ENDS).alias("piece"))
    pieces = ids.groupBy(*NODE, "piece").agg(F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids"))
    pieces = durable(pieces, "ends")
    lists = pieces.groupBy(*NODE).agg(F.count(F.lit(1)).alias("n"), F.first("ids").alias("ids"))
    short = lists.where("n = 1").select(*NODE, F.sha2(F.col("ids").cast("binary"), 256).alias("ends"))
    long = pieces.join(lists.where("n > 1").select(*NODE), NODE, "left_semi")
    long = long.repartition(*NODE).sortWithinPartitions(*NODE, "piece").select(*NODE, F.col("ids").cast("binary").alias("ids"))

    def run(batches):
        key, digest = None, None
        row = lambda: pa.RecordBatch.from_pylist([{**dict(zip(NODE, key, strict=True)), "ends": digest.hexdigest()}])
        for batch in batches:
            for *k, ids in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if k == key:
                    digest.update(b"," + ids)
                    continue
                if key:
                    yield row()
                key, digest = k, hashlib.sha256(ids)
        if key:
            yield row()

    return short.union(long.mapInArrow(run, "depth long, a long, b long, ends string"))


def prefix_trie(turns: DataFrame, height: int = HEIGHT) -> DataFrame:
    """The nodes of the trie of rebuilt conversations, one row each.

    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256. An empty table has no nodes. See spliced_turns for nulls and ties; repeated rows are
    turns like any other, and further columns play no part.
    """
    rows = durable(prefix_rows(spliced_turns(turns), height), "prefix-rows")
    same = [F.first(c).alias(c) for c in ("pa", "pb", "bytes", "path")]
    nodes = durable(rows.groupBy(*NODE).agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("low"), *same), "nodes")
    deepest = nodes.agg(F.max("depth")).first()[0]
    below = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("pa").alias("a"), F.col("pb").alias("b")).agg(F.count(F.lit(1)).alias("kids"))
    nodes = durable(nodes.join(below, NODE, "left").withColumn("kids", F.coalesce("kids", F.lit(0).cast("long"))), "nodes-with-children")
    worth = nodes.select(*NODE, "path", (F.col("kids") == 0).cast("long").alias("leaves"), ((F.col("n") - 1) * F.col("bytes")).alias("saved"))
    totals = durable(subtree_totals(worth, rows, deepest or 0, height), "totals")
    ends = durable(end_hashes(rows), "end-hashes")
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("low").alias("parent"))
    full = nodes.join(totals, NODE).join(ends, NODE, "left")
    full = durable(full.select(*NODE, "pa", "pb", "low", "n", "kids", "leaves", "saved", "ends"), "totalled")
    full = full.join(parents, ["depth", "pa", "pb"], "left")  # both sides lie as they are: the children of a hot parent are split
    return full.select(
        F.col("low").alias("conv_id"),
        "depth",
        F.col("parent").alias("parent_conv_id"),
        F.col("n").alias("n_convs"),
        F.col("kids").alias("n_children"),
        F.col("leaves").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"),
        F.coalesce("ends", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )


def op12_conversation_trie(spark, sf_dir: str) -> DataFrame:
    """The prefix trie of all conversations, rebuilt as the contract says; null roles and texts are empty."""
    return prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


OP12_SQL = """
WITH RECURSIVE bit(n, v, k) AS (  -- the 256 entries of the CRC table, a bit at a time
  SELECT i, i::BIGINT, 0 FROM range(256) r(i)
  UNION ALL SELECT n, CASE WHEN v % 2 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM bit WHERE k < 8),
tab AS (SELECT list(v ORDER BY n) AS t FROM bit WHERE k = 8),
t AS (
  SELECT conv_id AS c, list({'r': coalesce(role, ''), 't': coalesce(text, '')} ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS own
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY 1),
crc(c, s, v, i) AS (
  SELECT c, c::VARCHAR, 4294967295, 0 FROM t
  UNION ALL SELECT c, s, xor(v >> 8, (SELECT t FROM tab)[1 + (xor(v, ascii(s[i + 1])) & 255)]), i + 1 FROM crc WHERE i < length(s)),
h AS (SELECT c, xor(v, 4294967295) % 9 AS h FROM crc WHERE i = length(s)),
m AS (
  SELECT t.c, coalesce(base.own[1:h.h], []) || t.own[h.h + 1:] AS seq
  FROM t JOIN h USING (c) LEFT JOIN t base ON base.c = t.c - t.c % 5),
p AS (SELECT c, d, seq[1:d] AS pre, d = len(seq) AS ends FROM (SELECT c, seq, unnest(range(len(seq) + 1)) AS d FROM m)),
n AS (
  SELECT d, pre, min(c) AS low, count(*) AS n, (count(*) - 1) * coalesce(strlen(pre[d].t), 0) AS saved,
         sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE ends), '')) AS ends
  FROM p GROUP BY d, pre),
k AS (SELECT pre[1:d - 1] AS pre, count(*) AS kids FROM n WHERE d > 0 GROUP BY 1),
w AS (SELECT n.*, coalesce(kids, 0) AS kids FROM n LEFT JOIN k USING (pre)),
u AS (SELECT pre[1:x] AS pre, (kids = 0)::INT AS leaf, saved FROM (SELECT pre, kids, saved, unnest(range(d + 1)) AS x FROM w)),
s AS (SELECT pre, sum(leaf) AS leaves, sum(saved) AS saved FROM u GROUP BY pre)
SELECT w.low AS conv_id, w.d AS depth, up.low AS parent_conv_id, w.n AS n_convs, w.kids AS n_children,
       s.leaves::BIGINT AS n_leaves, s.saved::BIGINT AS saved_tokens, w.ends AS ends_sha256
FROM w JOIN s USING (pre) LEFT JOIN n up ON w.d > 0 AND up.pre = w.pre[1:w.d - 1]
"""
