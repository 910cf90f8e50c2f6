"""Exact Jaccard join of documents by word n-grams: size-aware, with a heavy and a light side.

Sets of few n-grams are light: for each pair of sizes that can be similar, a set lists its
subsets of just the size that their overlap must have, and equal subsets are links. The
others are heavy: they scan inverted lists. An inverted list holds the sets with an n-gram
among their first ones in the order of hashes, somewhat more of them than a shared one
needs, so that similar sets share several. Sets that share too few leave, and of the rest
each leaves out as many of its most frequent ones as it can spare. The border between the
two sides is where the subsets to be listed and the lists to be scanned are fewest.

Each set first meets one other, the centre of most of its lists. What these links have not
joined stays as far as enough of its n-grams stand in sets of another class too, and is then
settled in families, blocks of bounded size in which every set scans the lists of all. Every
link is settled on the whole sets, and none is left out: what the filters drop cannot reach
the similarity.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.graph import connected_components
from palimpsest.llm.simhash import shingle_hashes, whole_blocks
from palimpsest.llm.work import dealt, durable, own_columns, read_spread, settled

PERCENT, WORDS = 80, 5
MOST = 16  # n-grams of the largest set that may be light
SPARE = 20  # one more n-gram is listed for so many
SIDE = 384  # sets of a part of a family, or partners of a set, in one block
SCAN = 1 << 21  # n-grams of a part of a family, and entries of inverted lists scanned at once
SEEN = 1 << 20  # sets that a task remembers as seen


def partners(n: int, percent: int = PERCENT) -> range:
    """The sizes of the sets that one of ``n`` can be similar to."""
    return range(-(-n * percent // 100), n * 100 // percent + 1)


def overlap(m: int, n: int, percent: int = PERCENT) -> int:
    """The least intersection of similar sets of m and n: percent * (m + n) / (100 + percent), rounded up."""
    return -(-percent * (m + n) // (100 + percent))


def subsets(n: int, most: int, percent: int = PERCENT) -> int:
    """How many subsets a light set of ``n`` lists if the largest light one has ``most``."""
    return sum(comb(n, overlap(n, m, percent)) for m in partners(n, percent) if m <= most)


def listed(n, percent: int = PERCENT):
    """How many n-grams of a set of ``n`` are in the inverted lists, for numbers and for columns alike: those that
    similar sets may not share, one, and a spare one in SPARE."""
    return _floor(n * (100 - percent), 100) + 1 + _floor(n, SPARE)


def common(n, percent: int = PERCENT):
    """How many listed n-grams similar sets share at least if one is of ``n``: the smaller may have n * percent / 100."""
    return 1 + _floor(_floor(n * percent + 99, 100), SPARE)


def _floor(a, b: int):
    return a // b if isinstance(a, int) else F.floor(a / F.lit(b))


def document_sets(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, k0, k1, size, tokens): a set's two keys, its size and its listed n-grams, or all of them up to MOST.

    Only the first of the equal sets that a task sees has tokens. Null texts are empty.
    """
    src = own_columns(docs, id_col, text_col).select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches):
        seen = set()
        for b in batches:
            keys, size, tokens = [], [], []
            for known, t in zip(b.column(0).is_valid().to_pylist(), b.column(1), strict=True):
                h = np.unique(shingle_hashes(t.as_buffer().to_pybytes(), words))
                key = xxhash.xxh3_128_digest(h.tobytes())
                keys.append(key)
                size.append(len(h))
                new = known and len(h) > 0 and key not in seen
                if new and len(seen) < SEEN:
                    seen.add(key)
                tokens.append(h[: len(h) if len(h) <= MOST else listed(len(h), percent)].view(np.int64) if new else None)
            k = np.frombuffer(b"".join(keys), np.int64).reshape(-1, 2)
            cols = [b.column(0), pa.array(k[:, 0]), pa.array(k[:, 1]), pa.array(size, pa.int64()), pa.array(tokens, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "k0", "k1", "size", "tokens"])

    return src.mapInArrow(run, "doc_id long, k0 long, k1 long, size long, tokens array<long>")


def light_border(listing: DataFrame, sizes: DataFrame, counts: DataFrame, percent: int = PERCENT) -> int:
    """The size of the largest light sets: where subsets listed and lists scanned are fewest, by their numbers at each
    size up to MOST."""
    many = {r["size"]: r["n"] for r in sizes.where(F.col("size") <= MOST).groupBy("size").agg(F.count(F.lit(1)).alias("n")).collect()}
    small = listing.where(F.col("size") <= MOST).join(counts, "token", "left").groupBy("size").agg(F.sum(F.coalesce("n", F.lit(1))).alias("n"))
    scan = {r["size"]: r["n"] for r in small.collect()}

    def cost(border: int) -> int:
        listed_subsets = sum(many.get(n, 0) * subsets(n, border, percent) for n in range(1, border + 1))
        return listed_subsets + sum(scan.get(n, 0) for n in range(partners(border + 1, percent)[0], MOST + 1))

    return min(range(MOST + 1), key=cost)


def light_links(sets: DataFrame, border: int, percent: int = PERCENT) -> DataFrame:
    """(a, b): links that join the light sets(id, size, tokens) as all pairs of them would. A subset belongs to a pair
    of sizes; all that hold it are linked with those of the smaller size, so a star around one of these is enough."""

    def run(batches):
        for b in batches:
            out = []
            for who, n, tokens in zip(*[b.column(i).to_pylist() for i in range(3)], strict=True):
                for m in partners(n, percent):
                    if m > border:
                        continue
                    sizes = np.asarray([min(m, n), max(m, n)], np.int64).tobytes()
                    for s in combinations(tokens, overlap(m, n, percent)):
                        q = np.frombuffer(xxhash.xxh3_128_digest(sizes + np.asarray(s, np.int64).tobytes()), np.int64)
                        out.append((q[0], q[1], n <= m, who))
                        if len(out) == 1 << 16:
                            yield batch(out)
                            out = []
            if out:
                yield batch(out)

    def batch(out):
        return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], ["q0", "q1", "smaller", "id"])

    rows = sets.where(F.col("size").between(1, border)).select("id", "size", "tokens").mapInArrow(run, "q0 long, q1 long, smaller boolean, id long")
    rows = durable(rows, "subsets")
    star = rows.groupBy("q0", "q1").agg(F.min(F.when(F.col("smaller"), F.col("id"))).alias("b"), F.min("id").alias("low"), F.max("id").alias("high"))
    star = durable(star.where("b IS NOT NULL AND low < high").select("q0", "q1", "b"), "stars")
    return rows.join(star, ["q0", "q1"]).where("id <> b").select(F.col("id").alias("a"), "b").distinct()


def sharing_sets(listing: DataFrame, counts: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(id, size, ts): the sets of listing(id, size, token) that have enough of the n-grams of counts(token, n), and
    those (n, token), the rarest first."""
    ts = F.sort_array(F.collect_set(F.struct("n", "token"))).alias("ts")
    return listing.join(counts, "token").groupBy("id", "size").agg(ts).where(F.size("ts") >= common(F.col("size"), percent))


def spared_lists(sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(token, id, size, share): the inverted lists of several sets each. Each set spares its most frequent n-grams: of
    those that two similar sets share the rarest is spared by neither, as all the others come after it in one order for
    all sets, and they are too many. share: in thousandths of the listed."""
    kept = F.slice("ts", F.lit(1), (F.size("ts") - common(F.col("size"), percent) + 1).cast("int"))
    share = F.floor(1000 * F.size("ts") / listed(F.col("size"), percent))
    rows = durable(sets.select("id", "size", share.alias("share"), F.explode(kept.token).alias("token")), "spared-lists")
    several = rows.groupBy("token").agg(F.min("id").alias("a"), F.max("id").alias("z")).where("a < z").select("token")
    return rows.join(durable(several, "several"), "token")


def across_labels(listing: DataFrame, percent: int = PERCENT) -> DataFrame:
    """sharing_sets of listing(id, size, token, root), of n-grams that sets of several roots have: no other can be
    shared with a set that is not yet joined."""
    seen = listing.groupBy("token").agg(F.min("root").alias("a"), F.max("root").alias("z"), F.count(F.lit(1)).alias("n"))
    counts = durable(seen.where("a < z").select("token", "n"), "tokens-across")
    return durable(sharing_sets(listing, counts, percent), "sets-across")


def shared_across(sets: DataFrame, label: DataFrame) -> DataFrame:
    """(id, left): how many n-grams of the whole sets(id, hashes) stand in sets of another label(id, root) too."""

    def each(batches):
        for b in batches:
            for who, root, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                h = np.frombuffer(v.as_buffer(), np.int64)
                for i in range(0, len(h), 1 << 16):
                    part = h[i : i + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), who)), pa.array(np.full(len(part), root)), pa.array(part)], ["id", "root", "token"])

    rows = sets.join(label, "id", "left").select("id", F.coalesce("root", "id").alias("root"), "hashes").mapInArrow(each, "id long, root long, token long")
    across = rows.groupBy("token").agg(F.min("root").alias("a"), F.max("root").alias("z")).where("a < z").select("token")
    return rows.join(durable(across, "whole-across"), "token").groupBy("id").agg(F.count(F.lit(1)).alias("left"))


def sets_of(docs: DataFrame, wanted: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """(id, hashes): the whole sets of the documents wanted(id), sorted."""
    src = own_columns(docs, id_col, text_col).select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches):
        for b in batches:
            made = [np.unique(shingle_hashes(t.as_buffer().to_pybytes(), words)).tobytes() for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(made, pa.binary())], ["id", "hashes"])

    return src.join(wanted, "id").select("id", "text").mapInArrow(run, "id long, hashes binary")


def settled_pairs(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Those of pairs(a, b) whose sets(id, hashes) are similar. A set a goes once to each SIDE of its partners."""
    many = durable(pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / SIDE).alias("parts")), "partners")
    own = many.join(sets.toDF("a", "hashes"), "a").select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.col("a").alias("b"), "hashes", F.lit(0).alias("it"))
    other = pairs.join(many, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("parts")).alias("part")).join(sets.toDF("b", "hashes"), "b")
    rows = own.unionByName(other.select("a", "part", "b", "hashes", F.lit(1).alias("it")))

    def run(batches):
        for t in whole_blocks(batches, 2):
            mine = [np.frombuffer(v.as_buffer(), np.uint64) for v, it in zip(t["hashes"], t["it"].to_pylist(), strict=True) if it == 0]
            ok = []
            for v, it in zip(t["hashes"], t["it"].to_pylist(), strict=True):
                q = np.frombuffer(v.as_buffer(), np.uint64)
                ok.append(it == 1 and any(_similar(p, q, percent) for p in mine))
            t = t.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))
            if t.num_rows:
                yield from t.combine_chunks().to_batches()

    rows = dealt(rows, "a", "part").sortWithinPartitions("a", "part", "it").select("a", "part", "b", "hashes", "it")
    return rows.mapInArrow(run, "a long, b long").distinct()


def _similar(p: np.ndarray, q: np.ndarray, percent: int) -> bool:
    if not len(p) or not len(q):
        return False
    at = np.searchsorted(p, q)
    at[at == len(p)] = 0
    both = int((p[at] == q).sum())
    return 100 * both >= percent * (len(p) + len(q) - both)


def centre_pairs(lists: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(a, b): each set with the one that is the centre of most of its lists, where that can be similar to it. The
    centre of a list is the set that shares the largest part of its n-grams."""
    centre = durable(lists.groupBy("token").agg(F.max(F.struct("share", F.col("id").alias("b"), F.col("size").alias("m"))).alias("c")), "centres")
    met = lists.join(centre.select("token", "c.b", "c.m"), "token").where(F.col("id") != F.col("b")).where(_sizes_fit("size", "m", percent))
    met = met.groupBy("id", "b").agg(F.count(F.lit(1)).alias("n"))
    return met.groupBy("id").agg(F.max(F.struct("n", "b")).alias("m")).select(F.col("m.b").alias("a"), F.col("id").alias("b"))


def _sizes_fit(m: str, n: str, percent: int):
    return 100 * F.least(m, n) >= percent * F.greatest(m, n)


def overlaps(own: np.ndarray, posts: np.ndarray, begin: np.ndarray, many: np.ndarray, n: int) -> np.ndarray:
    """How many of the n-grams ``own`` each of ``n`` sets has, by a scan of their inverted lists: posts[begin:begin + many]."""
    out = np.zeros(n, np.int64)
    for part in np.split(own, np.flatnonzero(np.diff(np.cumsum(many[own]) // SCAN)) + 1):
        at = np.cumsum(many[part]) - many[part]
        out += np.bincount(posts[np.arange(int(many[part].sum())) + np.repeat(begin[part] - at, many[part])], minlength=n)
    return out


def block_links(sets: list[np.ndarray], label: np.ndarray, side: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """(i, j): links that join the labels as all similar pairs would; between the sides if there are two."""
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    token = np.unique(np.concatenate(sets), return_inverse=True)[1]
    posts = np.repeat(np.arange(len(sets)), size)[np.argsort(token, kind="stable")]
    many = np.bincount(token)
    begin, start = np.cumsum(many) - many, np.cumsum(size) - size
    label, out, across = label.copy(), [], bool(side.any())
    for i in range(len(sets)):
        if across and side[i]:
            continue
        both = overlaps(token[start[i] : start[i] + size[i]], posts, begin, many, len(sets))
        ok = (100 * both >= percent * (size[i] + size - both)) & (label != label[i])
        for j in np.flatnonzero(ok & side if across else ok).tolist():
            if label[j] != label[i]:
                label[label == label[j]] = label[i]
                out.append((i, j))
    return out


def family_links(lists: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(a, b): links between the sets(id, hashes) of lists(token, id, size, root) that differ in root. Sets that lists join
    are a family; one of p parts makes p * (p + 1) / 2 blocks, each part alone and beside every other, and in a block
    every set scans the inverted lists of all."""
    lists = durable(lists.select("token", "id", "size", "root"), "family-lists")
    first = durable(lists.groupBy("token").agg(F.min("id").alias("b")), "first-of-lists")
    star = lists.select("token", F.col("id").alias("a")).join(first, "token").where("a <> b").select("a", "b")
    family = durable(connected_components(star).toDF("id", "family"), "families")
    rows = durable(lists.select("id", "size", "root").distinct().join(family, "id"), "family-sets")
    parts = F.greatest(F.ceil(F.count(F.lit(1)) / SIDE), F.ceil(F.sum("size") / SCAN)).alias("parts")
    mixed = rows.groupBy("family").agg(parts, F.min("root").alias("a"), F.max("root").alias("z")).where("a < z").select("family", "parts")
    rows = rows.join(durable(mixed, "mixed-families"), "family").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")))
    rows = rows.join(sets, "id").withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    blocks = rows.select("family", F.least("part", "o").alias("x"), F.greatest("part", "o").alias("y"), (F.col("part") > F.col("o")).alias("side"), "id", "root", "hashes")

    def run(batches):
        for t in whole_blocks(batches, 3):
            made = [np.frombuffer(v.as_buffer(), np.uint64) for v in t["hashes"]]
            got = np.asarray(block_links(made, t["root"].to_numpy(), t["side"].to_numpy(), percent), np.int64).reshape(-1, 2)
            if len(got):
                who = t["id"].to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array(who[got[:, 0]]), pa.array(who[got[:, 1]])], ["a", "b"])

    blocks = dealt(blocks, "family", "x", "y").sortWithinPartitions("family", "x", "y")
    return blocks.mapInArrow(run, "a long, b long")


def heavy_links(docs: DataFrame, listing: DataFrame, counts: DataFrame, words: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """(a, b): links that join the sets of the inverted lists as all similar pairs of them would."""
    some = durable(sharing_sets(listing, counts, percent), "sharing-sets")
    lists = durable(spared_lists(some, percent), "lists")
    sets = durable(sets_of(docs, lists.select("id").distinct(), words, id_col, text_col), "whole-sets")
    first = durable(settled_pairs(durable(centre_pairs(lists, percent), "centre-pairs"), sets, percent), "first-links")
    label = durable(connected_components(first).toDF("id", "root"), "first-classes")
    for _ in range(2):  # what leaves takes n-grams with it that others then share with none
        listing = some.select("id", "size", F.explode("ts.token").alias("token")).join(label, "id", "left").withColumn("root", F.coalesce("root", "id"))
        some = across_labels(durable(listing, "labelled-listing"), percent)
    left = shared_across(sets.join(some.select("id"), "id"), label)
    able = some.join(durable(left, "left"), "id").where(100 * F.col("left") >= percent * F.col("size"))
    able = durable(able.join(label, "id", "left").withColumn("root", F.coalesce("root", "id")), "able")
    rest = spared_lists(able.select("id", "size", "ts"), percent).join(able.select("id", "root"), "id")
    return first.union(family_links(rest, sets, percent))


def jaccard_classes(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id): one row per row of ``docs``; component_id is the smallest id that links reach.

    A set is the distinct n-grams of ``words`` words, or the whole sequence of fewer; documents link whose
    intersection is ``percent`` of their union or more. Null and empty texts have empty sets and link with
    nothing. Rows of one id are one node. A row without an id keeps its row, has no component and links nothing.
    Further columns play no part; an empty table gives no rows.
    """
    made = durable(document_sets(docs, words, percent, id_col, text_col), "document-sets")
    some = made.where("doc_id IS NOT NULL AND size > 0")
    names = some.groupBy("k0", "k1").agg(F.min("doc_id").alias("low"), F.min(F.when(F.col("tokens").isNotNull(), F.col("doc_id"))).alias("id"), F.min("size").alias("size"))
    names = durable(names, "set-names")
    heads = some.where("tokens IS NOT NULL").select(F.col("doc_id").alias("id"), "k0", "k1", "size", "tokens")
    again = heads.select("k0", "k1", "id").join(names.select("k0", "k1", F.col("id").alias("one")), ["k0", "k1"]).where("id <> one").select("k0", "k1", "id")
    heads = heads.join(durable(again, "met-elsewhere"), ["k0", "k1", "id"], "left_anti")
    listing = heads.select("id", "size", F.explode(F.slice("tokens", F.lit(1), listed(F.col("size"), percent).cast("int"))).alias("token"))
    counts = durable(listing.groupBy("token").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "token-counts")
    border = light_border(listing, names, counts, percent)
    light = durable(light_links(heads, border, percent), "light-links")
    large = listing.where(F.col("size") >= partners(border + 1, percent)[0])
    heavy = settled(lambda: heavy_links(docs, large, counts, words, percent, id_col, text_col), "heavy-links")
    root = durable(connected_components(light.union(heavy)), "jaccard-classes")
    named = names.join(root.toDF("id", "root"), "id", "left").select("k0", "k1", "low", F.coalesce("root", "id").alias("root"))
    named = durable(named, "named-sets")
    low = named.groupBy("root").agg(F.min("low").alias("component_id"))
    named = durable(named.join(low, "root").select("k0", "k1", "component_id"), "components")
    rows = made.select("doc_id", "k0", "k1", "size").join(named, ["k0", "k1"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return rows.select("doc_id", F.col("size").alias("n_shingles"), component.alias("component_id"))


def op13_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    """Classes of all documents at five words and a similarity of 0.8; null texts have no shingles."""
    return jaccard_classes(read_spread(spark, f"{sf_dir}/documents.parquet"))


OP13_SQL = """
WITH w AS (
  SELECT doc_id, row_number() OVER () AS r, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[ \\x09-\\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
g AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS s
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM g GROUP BY 1),
x AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g a JOIN g b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS MATERIALIZED (SELECT a, b FROM x JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 80 * (p.n + q.n - c)),
r(a, b) AS (SELECT doc_id, doc_id FROM w UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, m.low AS component_id
FROM w LEFT JOIN n ON n.doc_id = w.doc_id JOIN (SELECT a, min(b) AS low FROM r GROUP BY 1) m ON m.a = w.doc_id
""".replace("WITH w", "WITH RECURSIVE w", 1)
