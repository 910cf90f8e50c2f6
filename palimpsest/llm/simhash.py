"""SimHash fingerprints and their bit-sliced comparison.

simhash_classes links 64-bit fingerprints within a small radius, for which keys of
equal bits miss no pair. A Jaccard similarity of 0.8 on shingles is a radius of a
fifth of the bits, for which such keys say nothing; near_duplicate_classes therefore
takes its blocks from shared pairs of least hashes, abandons what is far apart by the
same bit-sliced counters over 128 bits, and settles the rest on the shingle sets.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.graph import connected_components
from palimpsest.llm.work import dealt, durable, own_columns, read_spread, settled

BITS = 64
HOT = 4096  # fingerprints under one key beyond which the key takes in more bits
ROWS = 65536  # rows compared at once
SLACK = 1e-6  # of a count, for products of a similarity


def shingle_hashes(data: bytes, words: int, seed: int = 42) -> np.ndarray:
    """XXH64 of each run of ``words`` words; of the whole sequence if it is shorter."""
    parts = data.lower().split()  # bytes: A-Z only, and ASCII white space only
    if not parts:
        return np.zeros(0, np.uint64)
    text = b" ".join(parts)
    n = len(parts) - words + 1
    if n <= 1:
        return np.asarray([xxhash.xxh64_intdigest(text, seed)], dtype=np.uint64)
    size = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
    end = np.cumsum(size + 1) - 1
    start = (end - size)[:n].tolist()
    h = xxhash.xxh64_intdigest
    return np.fromiter([h(text[s:e], seed) for s, e in zip(start, end[words - 1 :].tolist(), strict=True)], np.uint64, n)


def simhash(hashes: np.ndarray) -> int:
    """A bit is 1 if it is set in over half the hashes; 0 for none."""
    n = len(hashes)
    if not n:
        return 0
    total = np.zeros(BITS, dtype=np.int64)
    for i in range(0, n, ROWS):
        part = np.ascontiguousarray(hashes[i : i + ROWS]).view(np.uint8).reshape(-1, 8)
        total += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(total * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, words: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): one row per row of ``docs``; null texts count as empty."""
    src = own_columns(docs, id_col, text_col).select(
        F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    )

    def run(batches):
        for b in batches:
            fps = [simhash(shingle_hashes(t.as_buffer().to_pybytes(), words, seed)) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.asarray(fps, np.uint64).view(np.int64))], ["doc_id", "fp"])

    kind = src.schema["doc_id"].dataType.simpleString()
    return src.mapInArrow(run, f"doc_id {kind}, fp long")


def _split(positions: list[int], parts: int) -> list[list[int]]:
    return [list(map(int, x)) for x in np.array_split(np.asarray(positions), parts)]


def _masks(radius: int, levels: int, within: list[int] | None = None) -> list[int]:
    """Bit masks of which any two fingerprints within ``radius`` agree on at least one.

    The positions are cut into radius + 1 parts, of which one must be equal; the rest
    are cut again, ``levels`` times.
    """
    within = list(range(BITS)) if within is None else within
    out = []
    for part in _split(within, radius + 1):
        own = sum(1 << p for p in part)
        rest = [p for p in within if p not in part]
        out += [own | m for m in _masks(radius, levels - 1, rest)] if levels > 1 else [own]
    return out


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def candidate_keys(fps: DataFrame, radius: int, hot: int = HOT) -> DataFrame:
    """(part, key, fp) such that any two fps within ``radius`` share a (part, key).

    Two levels of the pigeonhole at first; keys of over ``hot`` fingerprints are
    replaced by four-level keys within them, which loses no pair.
    """
    masks = _masks(radius, 2)
    keys = F.explode(F.array(*[F.struct(F.lit(i).alias("part"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for i, m in enumerate(masks)]))
    rows = fps.select("fp", keys.alias("k")).select("k.part", "k.key", "fp")
    sizes = rows.groupBy("part", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    rows = rows.join(sizes, ["part", "key"])
    cold = rows.where(F.col("n") <= hot).select("part", "key", "fp")
    deeper = []
    for i, m in enumerate(masks):
        free = [p for p in range(BITS) if not m >> p & 1]
        deeper.append([m | x for x in _masks(radius, 2, free)])
    pick = F.array(*[F.array(*[F.lit(_signed(x)) for x in ms]) for ms in deeper])[F.col("part")]
    more = rows.where(F.col("n") > hot).select("part", "fp", F.posexplode(pick).alias("j", "m"))
    step = (radius + 1) ** 2
    warm = more.select(
        (F.lit(len(masks)) + F.col("part") * step + F.col("j")).alias("part"), F.col("fp").bitwiseAND(F.col("m")).alias("key"), "fp"
    )
    return cold.unionByName(warm)


def sliced_hits(fp: np.ndarray, key: np.ndarray, shift: int, radius: int) -> np.ndarray:
    """Positions i where fp[i] and fp[i + shift] have one key and differ in at most ``radius`` bits.

    The bits stand in planes, one row per bit. Carry-save counters that begin at
    2**k - 1 - radius add a plane of differences at a time for all positions at once;
    a carry out of the top marks a distance over the radius, and the block is
    abandoned once every position is so marked.
    """
    n = len(fp) - shift
    width = 8 * (fp.shape[1] if fp.ndim > 1 else 1)  # bytes
    if n <= 0:
        return np.zeros(0, np.int64)
    same = key[:n] == key[shift:]
    if not same.any():
        return np.zeros(0, np.int64)
    bits = np.unpackbits(np.ascontiguousarray(fp).view(np.uint8).reshape(-1, width), axis=1, bitorder="little").T
    a, b = np.packbits(bits[:, :n], axis=1), np.packbits(bits[:, shift:], axis=1)
    over = ~np.packbits(same)
    k = max(1, radius.bit_length())
    begin = (1 << k) - 1 - radius
    counter = [np.full_like(over, 0xFF if begin >> i & 1 else 0) for i in range(k)]
    for plane in range(8 * width):
        carry = a[plane] ^ b[plane]
        for i in range(k):
            counter[i], carry = counter[i] ^ carry, counter[i] & carry
        over |= carry
        if plane % 4 == 3 and (over == 0xFF).all():
            return np.zeros(0, np.int64)
    return np.flatnonzero(np.unpackbits(~over, count=n))


def bucket_stars(fp: np.ndarray, key: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (member, smallest member) of the components inside each key of a sorted block.

    A key whose members have all met is compared no further.
    """
    n = len(fp)
    parent = np.arange(n)

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    _, group, size = np.unique(key, return_inverse=True, return_counts=True)
    apart = size.copy()
    shift = 1
    while True:
        live = np.flatnonzero((size[group] > shift) & (apart[group] > 1))
        if not len(live):
            break
        for i in sliced_hits(fp[live], group[live], shift, radius).tolist():
            a, b = find(live[i]), find(live[i + shift])
            if a != b:
                parent[max(a, b)] = min(a, b)
                apart[group[a]] -= 1
        shift += 1
    root = np.fromiter((find(i) for i in range(n)), np.int64, n) if n else parent
    low = np.full(n, np.iinfo(np.int64).max)
    signed = fp.view(np.int64)
    np.minimum.at(low, root, signed)
    member = low[root] != signed
    return signed[member], low[root][member]


def link_edges(keys: DataFrame, radius: int) -> DataFrame:
    """(part, key, fp) as (a, b): for each key, stars that join whatever lies within ``radius``."""
    rows = keys.repartition("part", "key").sortWithinPartitions("part", "key", "fp")

    def run(batches):
        left = None
        for b in batches:
            part = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in b.columns])
            part = part if left is None else np.concatenate([left, part], axis=1)
            if not part.shape[1]:
                continue
            last = (part[0] == part[0, -1]) & (part[1] == part[1, -1])
            cut = part.shape[1] - int(last.sum())
            left = part[:, cut:]
            yield from stars(part[:, :cut])
        if left is not None:
            yield from stars(left)

    def stars(rows):
        at, n = 0, rows.shape[1]
        if not n:
            return
        new = np.flatnonzero(np.r_[True, (np.diff(rows[0]) != 0) | (np.diff(rows[1]) != 0)])
        group = np.repeat(np.arange(len(new)), np.diff(np.r_[new, n]))
        while at < n:
            to = n if n - at <= ROWS else max(int(new[np.searchsorted(new, at + ROWS, "right") - 1]), at)
            if to <= at:  # one key longer than a block
                to = int(np.r_[new, n][np.searchsorted(np.r_[new, n], at, "right")])
            a, b = bucket_stars(np.ascontiguousarray(rows[2, at:to]).view(np.uint64), group[at:to], radius)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])
            at = to

    return rows.mapInArrow(run, "a long, b long")


def fingerprint_classes(fps: DataFrame, radius: int = 3) -> DataFrame:
    """Distinct ``fp`` with ``root``, the class of those reachable in steps of at most ``radius`` bits."""
    one = durable(fps.select("fp").distinct(), "distinct-fps")
    edges = link_edges(candidate_keys(one, radius), radius)
    root = connected_components(edges)
    return one.join(root.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"))


def simhash_classes(docs: DataFrame, words: int = 3, radius: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id): component_id is the smallest id of the class.

    Null and empty texts have fingerprint 0 and link like any other. Rows with a null
    id keep a row and never name a class; a class of such rows only has a null id.
    """
    rows = durable(fingerprints(docs, words, seed, id_col, text_col), "fingerprints")
    by_fp = rows.groupBy("fp").agg(F.min("doc_id").alias("low"))
    classes = durable(fingerprint_classes(by_fp, radius).join(by_fp, "fp"), "classes")
    ids = classes.groupBy("root").agg(F.min("low").alias("component_id"))
    named = classes.join(ids, "root").select("fp", "component_id")
    return rows.join(named, "fp").select("doc_id", "fp", "component_id")


BANDS, PER_BAND = 12, 2  # at similarity 0.8 two texts share no band once in 200,000 times
RADII = (8, 16, 24, 48)  # of 128 bits, the nearest links first; 0.8 is beyond 48 twice in 10**7 times (4 against 5 shingles) or less
WIDE = 64  # texts of a block from which on it is compared by itself
STEP = 256  # texts compared at once with all of such a block
PART = 1024  # texts in one task's share of a block, where it gets a tree
SIDE = 384  # texts of it that are settled against as many others
SHINGLES = 1 << 22  # about as many shingles have those
_ODD = np.random.Generator(np.random.PCG64(11)).integers(0, 1 << 63, BANDS * PER_BAND, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """One key per band, of the least hashes under PER_BAND multipliers."""
    if not len(hashes):
        return np.zeros(0, np.uint64)
    low = np.full(len(_ODD), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(hashes), ROWS):
        np.minimum(low, np.multiply.outer(_ODD, hashes[i : i + ROWS]).min(axis=1), out=low)
    pair = low.reshape(BANDS, PER_BAND)
    key = np.arange(BANDS, dtype=np.uint64)
    for j in range(PER_BAND):
        key = _mix(key ^ pair[:, j])
    return key


def keyed_texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """docs with _id and _null for the id and _row for the text: equal rows have equal ones."""
    return docs.withColumns(
        {
            "_null": F.col(f"`{id_col}`").isNull(),
            "_id": F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(0).cast("long")),
            "_row": F.xxhash64(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))),
        }
    )


def sketches(keyed: DataFrame, words: int, text_col: str) -> DataFrame:
    """(_null, _id, _row, sh, f0, f1, keys, size): sh names a text's set of ``size`` shingles."""
    src = keyed.select("_null", "_id", "_row", F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))

    def work(batches):
        for b in batches:
            sh, f0, f1, keys, size = [], [], [], [], []
            for t in b.column(3):
                h = np.unique(shingle_hashes(t.as_buffer().to_pybytes(), words))
                m = _mix(h)
                sh.append(_signed(int(m.sum(dtype=np.uint64) ^ np.uint64(len(h)))))
                f0.append(_signed(simhash(h)))
                f1.append(_signed(simhash(m)))
                keys.append(band_keys(h).view(np.int64))
                size.append(len(h))
            cols = [*b.columns[:3], pa.array(sh, pa.int64()), pa.array(f0, pa.int64()), pa.array(f1, pa.int64())]
            cols += [pa.array(keys, pa.list_(pa.int64())), pa.array(size, pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, ["_null", "_id", "_row", "sh", "f0", "f1", "keys", "size"])

    return src.mapInArrow(work, "_null boolean, _id long, _row long, sh long, f0 long, f1 long, keys array<long>, size long")


def bit_planes(fp: np.ndarray) -> np.ndarray:
    """A row for each bit, with that bit of 64 fingerprints in each word."""
    bits = np.unpackbits(np.ascontiguousarray(fp).view(np.uint8).reshape(len(fp), -1), axis=1, bitorder="little").T
    packed = np.zeros((len(bits), -(-len(fp) // 64) * 8), np.uint8)
    packed[:, : -(-len(fp) // 8)] = np.packbits(bits, axis=1)
    return packed.view(np.uint64)


def near_matrix(some: np.ndarray, planes: np.ndarray, n: int, radius: int) -> np.ndarray:
    """near[i, j]: some[i] and the j-th of ``planes`` differ in at most ``radius`` bits.

    The carry-save counters of sliced_hits, for every row of ``some`` against 64 others a
    word; abandoned once all of them are over the radius.
    """
    bits = np.unpackbits(np.ascontiguousarray(some).view(np.uint8).reshape(len(some), -1), axis=1, bitorder="little").T
    flip = np.uint64(0) - bits.astype(np.uint64)
    k = max(1, radius.bit_length())
    begin = (1 << k) - 1 - radius
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    over = np.zeros((len(some), planes.shape[1]), np.uint64)
    counter = [np.full_like(over, full if begin >> i & 1 else 0) for i in range(k)]
    for i, plane in enumerate(planes):
        carry = plane[None, :] ^ flip[i][:, None]
        for c in counter:
            both = c & carry
            c ^= carry
            carry = both
        over |= carry
        if i % 16 == 15 and (over == full).all():
            break
    return np.unpackbits((~over).view(np.uint8), axis=1, count=n).astype(bool)


def dense_tree(fp: np.ndarray, radii: tuple[int, ...]) -> list[tuple[int, int]]:
    """block_tree of one group, by near_matrix."""
    label, planes, out = np.arange(len(fp)), bit_planes(fp), []
    for radius in radii:
        for lo in range(0, len(fp), STEP):
            near = near_matrix(fp[lo : lo + STEP], planes, len(fp), radius)
            for i, row in enumerate(near, lo):
                js = np.flatnonzero(row & (label != label[i]))
                while len(js):
                    out.append((i, int(js[0])))
                    label[label == label[js[0]]] = label[i]
                    js = js[label[js] != label[i]]
        if (label == label[0]).all():
            break
    return out


def block_tree(fp: np.ndarray, group: np.ndarray, radii: tuple[int, ...]) -> list[tuple[int, int]]:
    """(i, j): in each group, links that join whatever the radii join, the nearest first."""
    parent = list(range(len(fp)))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    _, group, size = np.unique(group, return_inverse=True, return_counts=True)
    apart, out = size.copy(), []
    for g in np.flatnonzero(size >= WIDE).tolist():
        own = np.flatnonzero(group == g)
        out += [(int(own[i]), int(own[j])) for i, j in dense_tree(fp[own], radii)]
        apart[g] = 1
    for radius in radii:
        shift = 1
        while len(live := np.flatnonzero((size[group] > shift) & (apart[group] > 1))):
            for i in sliced_hits(fp[live], group[live], shift, radius).tolist():
                a, b = int(live[i]), int(live[i + shift])
                x, y = find(a), find(b)
                if x != y:
                    parent[max(x, y)] = min(x, y)
                    apart[group[a]] -= 1
                    out.append((a, b))
            shift += 1
    return out


def near_links(sets: DataFrame) -> DataFrame:
    """(sh, f0, f1, keys) as (a, b): trees of near fingerprints in the blocks of each key.

    A block of over PART texts is dealt into parts with a tree each. There each text also
    has a link to itself: what it is near to may lie in another part.
    """
    rows = sets.select(F.explode("keys").alias("key"), "sh", "f0", "f1")
    many = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    many = many.select("key", F.ceil(F.col("n") / PART).alias("parts"))
    rows = rows.join(many, "key").withColumn("part", F.pmod(F.xxhash64("sh"), F.col("parts")))
    rows = dealt(rows, "key", "part").sortWithinPartitions("key", "part", "sh")

    def work(batches):
        left = None
        for b in batches:
            rows = np.stack([b.column(i).to_numpy(zero_copy_only=False) for i in range(6)])
            rows = rows if left is None else np.concatenate([left, rows], axis=1)
            if not rows.shape[1]:
                continue
            cut = int(begins(rows)[-1])
            left = rows[:, cut:]
            yield from tree(rows[:, :cut])
        if left is not None:
            yield from tree(left)

    def begins(rows):
        return np.flatnonzero(np.r_[True, (rows[:2, 1:] != rows[:2, :-1]).any(axis=0)])

    def tree(rows):
        n = rows.shape[1]
        if n:
            group = np.repeat(np.arange(len(at := begins(rows))), np.diff(np.r_[at, n]))
            got = np.asarray(block_tree(np.ascontiguousarray(rows[4:].T).view(np.uint64), group, RADII), dtype=np.int64).reshape(-1, 2)
            sh, alone = rows[3], rows[3][rows[2] > 1]
            a, b = np.r_[sh[got[:, 0]], alone], np.r_[sh[got[:, 1]], alone]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    return rows.select("key", "part", "parts", "sh", "f0", "f1").mapInArrow(work, "a long, b long")


def similar(links: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Those of links(a, b) whose sets(sh, hashes) have the Jaccard similarity."""
    both = links.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b").select("a", "b", "x", "y")

    def work(batches):
        for t in batches:
            ok = []
            for x, y in zip(t.column(2), t.column(3), strict=True):
                p, q = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                common = len(np.intersect1d(p, q, assume_unique=True))
                ok.append(common >= similarity * (len(p) + len(q) - common) - SLACK)
            yield pa.RecordBatch.from_arrays([t.column(0), t.column(1)], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return both.mapInArrow(work, "a long, b long")


def shingle_sets(keyed: DataFrame, wanted: DataFrame, words: int, text_col: str) -> DataFrame:
    """(sh, hashes): sorted shingle hashes of the texts that wanted(sh, _null, _id, _row) names."""
    texts = keyed.select("_null", "_id", "_row", F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    src = texts.join(wanted, ["_null", "_id", "_row"]).select("sh", "text")

    def work(batches):
        for b in batches:
            made = [np.unique(shingle_hashes(t.as_buffer().to_pybytes(), words)).tobytes() for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(made, pa.binary())], ["sh", "hashes"])

    return src.mapInArrow(work, "sh long, hashes binary").dropDuplicates(["sh"])


BLOCK = "key long, x long, y long, side boolean, sh long, band int, f0 long, f1 long, label long, keys array<long>"


def whole_blocks(batches, width: int):
    """Tables of one block each, from sorted batches whose first ``width`` columns name it."""
    held, last = [], None
    for b in batches:
        if not b.num_rows:
            continue
        key = np.stack([b.column(i).to_numpy(zero_copy_only=False) for i in range(width)])
        at = np.r_[0, np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1, b.num_rows].tolist()
        for i, j in zip(at[:-1], at[1:], strict=True):
            if held and (key[:, i] != last).any():
                yield pa.Table.from_batches(held)
                held = []
            held.append(b.slice(i, j - i))
            last = key[:, i]
    if held:
        yield pa.Table.from_batches(held)


class Block:
    """Texts of one key, or of two of its parts, in columns of BLOCK."""

    def __init__(self, t: pa.Table):
        self.side, self.sh, self.band = t["side"].to_numpy(), t["sh"].to_numpy(), t["band"][0].as_py()
        self.fp = np.stack([t["f0"].to_numpy(), t["f1"].to_numpy()], axis=1).view(np.uint64)
        self.label = np.unique(t["label"].to_numpy(), return_inverse=True)[1]
        self.keys = t["keys"].combine_chunks().flatten().to_numpy().reshape(len(self.sh), -1)

    def open_pairs(self, radius: int):
        """(i, js): pairs within ``radius`` bits whose ends differ in label, each once. If there are two
        sides the pairs go across; those that share an earlier band are left to its block. Changes
        to ``label`` between two steps count."""
        n, label, across = len(self.sh), self.label, bool(self.side.any())
        big = label == np.bincount(label).argmax()
        planes, rows = bit_planes(self.fp), np.flatnonzero(~big)
        for lo in range(0, len(rows), STEP):
            some = rows[lo : lo + STEP]
            for i, near in zip(some.tolist(), near_matrix(self.fp[some], planes, n, radius), strict=True):
                other = near & (label != label[i])
                other[:i] &= big[:i]  # the others before have met i
                if across:
                    other &= self.side != self.side[i]
                js = np.flatnonzero(other)
                js = js[~(self.keys[js, : self.band] == self.keys[i, : self.band]).any(axis=1)]
                if len(js):
                    yield i, js

    def settle(self, sets: list[np.ndarray], radius: int, similarity: float) -> list[tuple[int, int]]:
        """(i, j): links at ``similarity`` that join the labels as all open pairs would: each is settled on
        its sets, unless links found before have joined its ends."""
        label, out = self.label, []
        size = np.fromiter(map(len, sets), np.int64, len(sets))
        start = np.cumsum(size) - size
        ids = np.unique(np.concatenate(sets), return_inverse=True)[1].astype(np.int32)
        mark = np.zeros(int(ids.max()) + 1, bool)
        for i, js in self.open_pairs(radius):
            js = js[np.minimum(size[i], size[js]) >= similarity * np.maximum(size[i], size[js]) - SLACK]
            own = ids[start[i] : start[i] + size[i]]
            mark[own] = True
            for part in np.split(js, np.flatnonzero(np.diff(np.cumsum(size[js]) // (16 * ROWS))) + 1):
                part = part[label[part] != label[i]]
                if not len(part):
                    continue
                at = np.cumsum(size[part]) - size[part]
                flat = np.arange(int(size[part].sum())) + np.repeat(start[part] - at, size[part])
                common = np.add.reduceat(mark[ids[flat]], at, dtype=np.int64)
                for j in part[common >= similarity * (size[i] + size[part] - common) - SLACK].tolist():
                    if label[j] != label[i]:
                        label[label == label[j]] = label[i]
                        out.append((i, j))
            mark[own] = False
        return out


def open_rows(sets: DataFrame, classes: DataFrame) -> DataFrame:
    """Rows of BLOCK that have open pairs, by the keys whose texts are of several ``classes``.

    A key of p parts makes p * (p + 1) / 2 blocks: each part alone and beside every other.
    """
    rows = sets.select("sh", "f0", "f1", "keys", "size").join(classes.toDF("sh", "root"), "sh", "left")
    rows = rows.select(F.posexplode("keys").alias("band", "key"), "sh", "f0", "f1", "keys", "size", F.coalesce("root", "sh").alias("label"))
    seen = rows.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count(F.lit(1)).alias("n"), F.sum("size").alias("s"))
    parts = F.greatest(F.ceil(F.col("n") / SIDE), F.ceil(F.col("s") / SHINGLES))
    mixed = seen.where("low < high").select("key", parts.alias("parts"))
    rows = rows.join(mixed, "key").withColumn("part", F.pmod(F.xxhash64("sh"), F.col("parts")))
    rows = rows.withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    blocks = rows.select(
        "key", F.least("part", "o").alias("x"), F.greatest("part", "o").alias("y"), (F.col("part") > F.col("o")).alias("side"), "sh", "band", "f0", "f1", "label", "keys"
    )

    def near(batches):
        for t in whole_blocks(batches, 3):
            keep = np.zeros(t.num_rows, bool)
            for i, js in Block(t).open_pairs(RADII[-1]):
                keep[i] = True
                keep[js] = True
            if keep.any():
                yield from t.filter(pa.array(keep)).to_batches()

    return dealt(blocks, "key", "x", "y").sortWithinPartitions("key", "x", "y", "side", "sh").mapInArrow(near, BLOCK)


def may_link(own: DataFrame, similarity: float) -> DataFrame:
    """The ``sh`` of own(sh, hashes) of which enough shingles stand in other sets too: a set of n with more
    than (1 - similarity) * n of its own is similar to none."""

    def each(batches):
        for b in batches:
            for sh, v in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                h = np.frombuffer(v.as_buffer(), np.int64)
                for i in range(0, len(h), ROWS):
                    part = h[i : i + ROWS]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), sh)), pa.array(part)], ["sh", "h"])

    alone = own.select("sh", "hashes").mapInArrow(each, "sh long, h long").groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min("sh").alias("sh"))
    alone = alone.where("n = 1").groupBy("sh").agg(F.count(F.lit(1)).alias("alone"))
    sizes = own.select("sh", (F.octet_length("hashes") / 8).alias("size")).join(alone, "sh", "left")
    return sizes.where(F.coalesce("alone", F.lit(0)) <= (1 - similarity) * F.col("size") + SLACK).select("sh")


def settled_links(sets: DataFrame, texts: DataFrame, classes: DataFrame, similarity: float) -> DataFrame:
    """(a, b): what else joins near_links' blocks where they hold members of several ``classes``.

    The trees skip a pair whose ends are joined by links that the sets may refuse; here no
    pair is skipped but for links that the sets have confirmed. Texts with too many
    shingles of their own leave first, in grouped counts, so that a large group of
    differently edited copies is not compared pair by pair.
    """
    rows = durable(open_rows(sets, classes), "open-rows")
    own = durable(texts.join(rows.select("sh").distinct(), "sh").select("sh", "hashes"), "open-sets")
    full = rows.join(own.join(may_link(own, similarity), "sh"), "sh")
    names = [c.split()[0] for c in BLOCK.split(", ")]

    def settle_all(batches):
        for t in whole_blocks(batches, 3):
            block = Block(t)
            made = [np.frombuffer(v.as_buffer(), np.uint64) for v in t["hashes"]]
            got = np.asarray(block.settle(made, RADII[-1], similarity), dtype=np.int64).reshape(-1, 2)
            if len(got):
                yield pa.RecordBatch.from_arrays([pa.array(block.sh[got[:, 0]]), pa.array(block.sh[got[:, 1]])], ["a", "b"])

    full = dealt(full.select(*names, "hashes"), "key", "x", "y").sortWithinPartitions("key", "x", "y", "side", "sh")
    return full.mapInArrow(settle_all, "a long, b long")


def near_duplicate_classes(keyed: DataFrame, words: int = 5, similarity: float = 0.8, text_col: str = "text") -> DataFrame:
    """(_null, _id, _row, root) of keyed_texts: root names the class of texts that a chain of
    similarities of at least ``similarity`` joins. Texts without words are one class."""
    made = durable(sketches(keyed, words, text_col), "sketches")
    who = F.min(F.struct("_null", "_id", "_row")).alias("who")
    sets = durable(made.groupBy("sh").agg(who, F.first("f0").alias("f0"), F.first("f1").alias("f1"), F.first("keys").alias("keys"), F.first("size").alias("size")), "shingle-sets")
    links = durable(near_links(sets).distinct(), "near-links")
    ends = links.select(F.col("a").alias("sh")).union(links.select("b")).distinct()
    wanted = sets.join(ends, "sh").select("sh", "who._null", "who._id", "who._row")
    texts = durable(shingle_sets(keyed, wanted, words, text_col), "checked-sets")
    joined = durable(similar(links.where("a <> b"), texts, similarity), "joined")
    more = settled_links(sets, texts, durable(connected_components(joined), "first-classes"), similarity)
    root = durable(connected_components(joined.union(more)), "near-classes")
    return made.join(root.toDF("sh", "root"), "sh", "left").select("_null", "_id", "_row", F.coalesce("root", "sh").alias("root"))


def drop_near_duplicates(docs: DataFrame, words: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each class: that of the smallest id, nulls last. Repeated rows are one."""
    keyed = keyed_texts(docs, id_col, text_col)
    first = F.min(F.struct("_null", "_id", "_row")).alias("w")
    named = lambda: near_duplicate_classes(keyed, words, similarity, text_col).groupBy("root").agg(first).select("w._null", "w._id", "w._row")
    best = settled(named, "representatives")
    one = keyed.join(best, ["_null", "_id", "_row"], "left_semi").dropDuplicates(["_null", "_id", "_row"])
    return one.select(*[F.col(f"`{c}`") for c in docs.columns])


def op5_simhash_dedup(spark, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and their classes; null texts are empty and have fingerprint zero, which links like any other."""
    docs = read_spread(spark, f"{sf_dir}/documents.parquet")
    found = simhash_classes(docs, words=3, radius=3, seed=42)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


