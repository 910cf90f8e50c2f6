"""N-best segmentation over a piece lattice, and decoding.

Forward Viterbi scores over the lattice are exact heuristics for an A-star search
that walks backward from the end of the text, so every state it takes up lies on a
path still among the best. The lattice falls apart wherever no piece spans two
neighbouring characters, so words are scored apart, many at once: forward and
backward Viterbi scores give each its best path and the loss of its second best. A
document's N best paths differ only in the N - 1 words of least loss; those are the
ones that the search is run on.
"""

from __future__ import annotations

import heapq
import re
import zlib
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.work import own_columns, read_spread

SPACE = "▁"
PENALTY = 10.0  # an unknown character scores this much less than the worst piece


def _levels(order: np.ndarray, level: np.ndarray, node: np.ndarray):
    """Arcs of one level at a time, with where each node's arcs begin and end among them."""
    edge = np.flatnonzero(np.diff(level, prepend=level[0] - 1, append=level[-1] + 1))
    for a, b in zip(edge[:-1], edge[1:], strict=True):
        n = node[a:b]
        begin = np.flatnonzero(np.concatenate([[True], n[1:] != n[:-1]]))
        yield order[a:b], begin, np.append(begin[1:], b - a)


class PieceLattice:
    """Pieces and scores of a SentencePiece model with byte fallback. Spaces become SPACE, one is
    put in front, and nothing else is normalised."""

    shared: dict[tuple[str, int], PieceLattice] = {}

    @classmethod
    def of(cls, path: str, n_best: int) -> PieceLattice:
        """One for all tasks of a worker."""
        if (path, n_best) not in cls.shared:
            cls.shared[path, n_best] = cls(path, n_best)
        return cls.shared[path, n_best]

    def __init__(self, path: str, n_best: int = 3, limit: int = 900_000):
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.n_best, self.limit = n_best, limit
        self.words: dict[bytes, int] = {}  # the row of each word in the next three
        self.blobs: list[bytes] = []  # ids of its best path
        self.scores, self.losses = np.zeros(0), np.zeros(0)
        self.chunks: dict[str, list] = {}
        self.bytes_at, self.raw, usual = {}, [], []
        self.find, self.spot = ahocorasick.Automaton(), ahocorasick.Automaton()
        self.size, self.score = np.zeros(sp.get_piece_size(), np.int64), np.zeros(sp.get_piece_size())
        self.single, self.inner = set(), set()
        for i in range(sp.get_piece_size()):
            p = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.bytes_at[int(p[3:5], 16)] = i
                self.raw.append(bytes([int(p[3:5], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                self.raw.append(b"")
            else:
                self.raw.append(p.replace(SPACE, " ").encode())
                self.find.add_word(p, (len(p), i, sp.get_score(i)))
                self.spot.add_word(p, i)
                self.size[i], self.score[i] = len(p), sp.get_score(i)
                usual.append(sp.get_score(i))
                self.inner.update(zip(p, p[1:], strict=False))
                if len(p) == 1:
                    self.single.add(p)
        self.find.make_automaton()
        self.spot.make_automaton()
        letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
        apart = [c for c in "!\"#$%&()*+,-./:;<=>?@[]^_`{|}~\n\r\t" if not any((x, c) in self.inner for x in letters)]
        self.parted = re.compile(b"(?<=[A-Za-z])(?=[" + re.escape("".join(apart)).encode() + b"])") if apart else None
        self.unknown = min(x for x in usual if x > -1e8) - PENALTY

    def search(self, text: str) -> list[tuple[float, tuple[int, ...]]]:
        """(score, ids) of the best paths over one stretch, best first; ties in the order of the search."""
        n = len(text)
        arcs: list[list] = [[] for _ in range(n + 1)]
        for end, (size, i, score) in self.find.iter(text):
            arcs[end + 1].append((end + 1 - size, i, score))
        single = self.single
        for j, c in enumerate(text):
            if c not in single:
                arcs[j + 1].append((j, -1 - j, self.unknown))
        best = [0.0] * (n + 1)
        for j in range(1, n + 1):
            here = [(-best[a] - s, a, i, s) for a, i, s in arcs[j]]
            if len(here) > 1:
                here.sort()
            arcs[j] = here
            best[j] = -here[0][0]
        # a state: an arc of a node and the path behind it, at the score of its best completion
        out, tick = [], 0
        heap = [(-best[n], 0, n, 0, 0.0, None)]
        while heap:
            _, _, at, rank, done, path = heapq.heappop(heap)
            here = arcs[at]
            if rank + 1 < len(here):
                heapq.heappush(heap, (here[rank + 1][0] - done, tick - 1, at, rank + 1, done, path))
            _, a, i, s = here[rank]
            tick -= 2  # the newest first: among equals the search goes straight down
            if a:
                heapq.heappush(heap, (-best[a] - done - s, tick, a, 0, done + s, (i, path)))
                continue
            ids, path = [], (i, path)
            while path is not None:
                i, path = path
                ids += [i] if i >= 0 else [self.bytes_at[b] for b in text[-1 - i].encode()]
            out.append((done + s, tuple(ids)))
            if len(out) == self.n_best:
                break
        return out

    def _merge(self, lists: list[list]) -> list:
        """The best sums of one entry of each list, with their ids joined."""
        if len(lists) == 1:
            return lists[0]
        spread = sorted(range(len(lists)), key=lambda i: (lists[i][0][0] - lists[i][1][0] if len(lists[i]) > 1 else np.inf, i))
        free = [i for i in spread[: self.n_best - 1] if len(lists[i]) > 1]
        total = sum(x[0][0] for x in lists)
        combos = [(0.0, ())]
        for i in free:
            more = [(d + lists[i][0][0] - s, (*c, (i, j))) for d, c in combos for j, (s, _) in enumerate(lists[i])]
            combos = sorted(more, key=lambda x: x[0])[: self.n_best]
        out = []
        for d, c in combos:
            pick = dict(c)
            out.append((total - d, tuple(x for i, part in enumerate(lists) for x in part[pick.get(i, 0)][1])))
        return out

    def _chunk(self, text: str) -> list:
        got = self.chunks.get(text)
        if got is None:
            if len(self.chunks) > self.limit // 10:
                self.chunks.clear()
            got = self.chunks[text] = self.search(text)
        return got

    def best_of(self, text: str) -> list[tuple[float, tuple[int, ...]]]:
        """The best paths over ``text``, in which spaces are SPACE already."""
        if not text:
            return [(0.0, ())]
        cut = [i + 1 for i, pair in enumerate(zip(text, text[1:], strict=False)) if pair not in self.inner]
        return self._merge([self._chunk(text[a:b]) for a, b in zip([0, *cut], [*cut, len(text)], strict=True)])

    def _text(self, word: bytes) -> str:
        """A word has a space before it, unless it begins with a mark that it goes on from the last one."""
        t = word.decode()
        return t[1:] if t[:1] == "\0" else SPACE + t

    def learn(self, words: list[bytes]) -> None:
        """Best path, score and loss of the second best of new words, all at once."""
        if len(self.words) > self.limit:
            self.words.clear()
            self.blobs, self.scores, self.losses = [], np.zeros(0), np.zeros(0)
        plain, texts, scores, losses = [], [], [], []
        for w in words:
            t = self._text(w)
            if len(t) <= 48 and self.single.issuperset(t):
                plain.append(w)
                texts.append(t)
            else:
                paths = self.best_of(t)
                self.words[w] = len(self.blobs)
                self.blobs.append(np.asarray(paths[0][1], "<i4").tobytes())
                scores.append(paths[0][0])
                losses.append(paths[0][0] - paths[1][0] if len(paths) > 1 else np.inf)
        self.scores, self.losses = np.append(self.scores, scores), np.append(self.losses, losses)
        if not plain:
            return
        found = np.fromiter(chain.from_iterable(self.spot.iter("\0".join(texts))), np.int64).reshape(-1, 2)
        length = np.fromiter(map(len, texts), np.int64, len(texts))
        first = np.cumsum(length + 1) - length - 1  # nodes: the places before each character, and a word's end
        last = first + length
        to, piece = found[:, 0] + 1, found[:, 1]
        at, score = to - self.size[piece], self.score[piece]
        word = np.searchsorted(first, to - 1, side="right") - 1
        forward, backward = np.full(last[-1] + 1, -np.inf), np.full(last[-1] + 1, -np.inf)
        forward[first], backward[last] = 0.0, 0.0
        took = np.zeros(last[-1] + 1, np.int64)
        order = np.argsort((to - first[word]) << 40 | to << 6 | self.size[piece])  # sizes are below 64
        for arcs, begin, end in _levels(order, (to - first[word])[order], to[order]):
            worth = forward[at[arcs]] + score[arcs]
            most = np.maximum.reduceat(worth, begin)
            forward[to[arcs[begin]]] = most
            place = np.where(worth == np.repeat(most, end - begin), np.arange(len(arcs)), -1)
            took[to[arcs[begin]]] = arcs[np.maximum.reduceat(place, begin)]  # of equals the longest piece
        order = np.argsort((last[word] - at) << 40 | at)
        for arcs, begin, _ in _levels(order, (last[word] - at)[order], at[order]):
            backward[at[arcs[begin]]] = np.maximum.reduceat(backward[to[arcs]] + score[arcs], begin)
        best = forward[last]
        through = forward[at] + score + backward[to]
        steps, here, left = [], last.copy(), np.arange(len(texts))
        while len(left):
            arc = took[here]
            through[arc] = -np.inf
            steps.append((left, piece[arc]))
            here = at[arc]
            more = here > first[left]
            here, left = here[more], left[more]
        second = np.full(len(texts), -np.inf)
        np.maximum.at(second, word, through)
        who = np.concatenate([x for x, _ in steps])
        ids = np.concatenate([x for _, x in steps]).astype("<i4")
        turn = np.concatenate([np.full(len(x), -k) for k, (x, _) in enumerate(steps)])
        ids = ids[np.lexsort((turn, who))].tobytes()
        stop = 4 * np.cumsum(np.bincount(who, minlength=len(texts)))
        self.scores, self.losses = np.append(self.scores, best), np.append(self.losses, best - second)
        self.words.update(zip(plain, range(len(self.blobs), len(self.blobs) + len(plain)), strict=True))
        self.blobs += [ids[a:b] for a, b in zip(np.append(0, stop[:-1]).tolist(), stop.tolist(), strict=True)]

    def split(self, data: bytes) -> list[bytes]:
        """Words between which no piece stands; runs of spaces go with the word after them."""
        if b"\0" not in data and self.parted:
            data = self.parted.sub(b" \0", data)
        words = data.split(b" ")
        if b"" in words[:-1] or SPACE.encode() in data:
            text, words, at = (SPACE.encode() + data.replace(b" ", SPACE.encode())).decode().replace(SPACE + "\0", "\0"), [], 0
            for i in range(1, len(text)):
                if text[i] == "\0" or (text[i] == SPACE and text[i - 1] != SPACE):
                    words.append(text[at:i])
                    at = i
            words = [(w[1:] if w[0] == SPACE else w).encode() for w in [*words, text[at:]]]
        return words

    def encode(self, data: bytes, words: list[bytes] | None = None) -> list[tuple[float, bytes]]:
        """(score, ids as little-endian 32-bit) of a document's best paths, best first."""
        if not data:
            return [(0.0, b"")]
        words = self.split(data) if words is None else words
        known = self.words
        try:
            found = list(map(known.__getitem__, words))
        except KeyError:
            self.learn([w for w in set(words) if w not in known])
            if not known.keys() >= set(words):  # emptied to make room
                self.learn([w for w in set(words) if w not in known])
            found = list(map(known.__getitem__, words))
        at = np.asarray(found)
        total, loss = float(self.scores[at].sum()), self.losses[at]
        k = min(self.n_best - 1, len(found))
        near = np.argpartition(loss, k - 1)[:k] if 0 < k < len(found) else np.arange(k)
        near = sorted(i for i in near.tolist() if np.isfinite(loss[i]))
        combos: list[tuple[float, tuple]] = [(0.0, ())]
        for i in near:
            paths = [(s, np.asarray(ids, "<i4").tobytes()) for s, ids in self.best_of(self._text(words[i]))]
            more = [(d + paths[0][0] - s, (*c, b)) for d, c in combos for s, b in paths]
            combos = sorted(more, key=lambda x: x[0])[: self.n_best]
        blob = self.blobs.__getitem__
        between = [b"".join(map(blob, found[a:b])) for a, b in zip([0, *[i + 1 for i in near]], [*near, len(found)], strict=True)]
        return [(total - d, b"".join([x for pair in zip(between, (*c, b""), strict=True) for x in pair])) for d, c in combos]

    def decode(self, ids: bytes) -> bytes:
        """The UTF-8 text, without the space put in front."""
        text = b"".join(map(self.raw.__getitem__, np.frombuffer(ids, "<i4").tolist()))
        return text[1:] if text[:1] == b" " else text


PATH = pa.struct([("score", pa.float64()), ("n_ids", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.list_(pa.int32()))])
SHORT = pa.struct(list(PATH)[:3])


def encode_nbest(
    docs: DataFrame, model_path: str, n_best: int = 3, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True, check: bool = False
) -> DataFrame:
    """(doc_id, paths[, decoded]): the ``n_best`` paths of each text, or all if there are fewer.

    A null or empty text has one path of no ids. ``decoded`` is the text that the best
    path decodes to: the input, but that SPACE itself turns into a space.
    """
    src = own_columns(docs, id_col, text_col).select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def work(batches):
        lattice = PieceLattice.of(model_path, n_best)
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                paths, back = [], []
                data = [t.as_buffer().to_pybytes() for t in part.column(1)]
                words = [lattice.split(x) for x in data]
                lattice.learn([w for w in set().union(*words) if w not in lattice.words])
                for x, w in zip(data, words, strict=True):
                    found = lattice.encode(x, w)
                    rows = [{"score": s, "n_ids": len(i) // 4, "ids_crc32": zlib.crc32(i)} for s, i in found]
                    if with_ids:
                        for r, (_, i) in zip(rows, found, strict=True):
                            r["ids"] = np.frombuffer(i, "<i4")
                    paths.append(rows)
                    if check:
                        back.append(lattice.decode(found[0][1]))
                cols = [part.column(0), pa.array(paths, pa.list_(PATH if with_ids else SHORT))]
                if check:
                    cols.append(pa.array(back, pa.binary()).cast(pa.string()))
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "paths", "decoded"][: len(cols)])

    ids = ",ids:array<int>" if with_ids else ""
    more = ", decoded string" if check else ""
    kind = src.schema["doc_id"].dataType.simpleString()
    return src.mapInArrow(work, f"doc_id {kind}, paths array<struct<score:double,n_ids:bigint,ids_crc32:bigint{ids}>>{more}")


def decode_ids(table: DataFrame, model_path: str, ids_col: str = "ids", out_col: str = "text") -> DataFrame:
    """``table`` with the text of its ids; null ids give a null text, and bytes that are no UTF-8 the replacement character."""

    @F.pandas_udf("string")
    def text(ids):
        lattice = PieceLattice.of(model_path, 1)
        return ids.map(lambda x: None if x is None else lattice.decode(np.asarray(x, "<i4").tobytes()).decode(errors="replace"))

    return table.withColumn(out_col, text(F.col(f"`{ids_col}`")))


def op7_sentencepiece_nbest(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = read_spread(spark, f"{sf_dir}/documents.parquet")
    found = encode_nbest(docs, public_tokenizers.path("piece_bpe_32k.model"), 3, with_ids=False, check=True)
    best = F.col("paths")[0]
    others = F.transform(F.slice("paths", 2, 100), lambda p: F.concat_ws(":", p["n_ids"], p["score"].cast("decimal(38,3)"), p["ids_crc32"]))
    return found.select(
        "doc_id",
        best["n_ids"].alias("n_ids"),
        best["score"].alias("score"),
        best["ids_crc32"].alias("ids_crc32"),
        F.array_join(others, ",").alias("others"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
