import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest

from palimpsest.llm import pieces as P

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def every_path(lat, text):
    """All segmentations of a short text: (score, ids)."""
    piece = {}
    for p, (_, i, s) in lat.find.items():
        piece[p] = (i, s)

    def walk(at):
        if at == len(text):
            yield 0.0, ()
            return
        if text[at] not in lat.single:
            for s, ids in walk(at + 1):
                yield s + lat.unknown, (*[lat.bytes_at[b] for b in text[at].encode()], *ids)
        for e in range(at + 1, len(text) + 1):
            if text[at:e] in piece:
                i, sc = piece[text[at:e]]
                for s, ids in walk(e):
                    yield s + sc, (i, *ids)

    return sorted(walk(0), key=lambda x: -x[0])


@pytest.mark.parametrize("n", [1, 3, 7])
def test_search_equals_all_paths(n):
    lat = P.PieceLattice(MODEL, n)
    for t in ("the", "hello", "aaaa", " a b", "x\ny", "été", "  two", "q€z", "not now", "\U0001f600a", "a  b"):
        full = P.SPACE + t.replace(" ", P.SPACE)
        want = every_path(lat, full)
        for got in (lat.search(full), lat.best_of(full), [(s, tuple(np.frombuffer(b, "<i4").tolist())) for s, b in lat.encode(t.encode())]):
            assert [s for s, _ in got] == [s for s, _ in want[:n]], t
            assert len(set(got)) == len(got) and set(got) <= set(want)


def test_long_runs():
    lat = P.PieceLattice(MODEL, 4)
    for t in ("a" * 30_000, "ab" * 9000 + " " * 3000 + "x", "\n" * 5000, "e" * 100 + "中" * 4000):
        got = lat.encode(t.encode())
        assert len({i for _, i in got}) == len(got) and lat.decode(got[0][1]).decode() == t
        assert [s for s, _ in got] == sorted((s for s, _ in got), reverse=True)


def viterbi(lat, text):
    piece = {p: s for p, (_, _, s) in lat.find.items()}
    best = [0.0] + [-np.inf] * len(text)
    for j in range(1, len(text) + 1):
        for a in range(max(0, j - 16), j):
            s = piece.get(text[a:j])
            if s is None and a == j - 1 and text[a] not in lat.single:
                s = lat.unknown
            if s is not None:
                best[j] = max(best[j], best[a] + s)
    return best[-1]


def test_query(spark, tmp_path):
    texts = [None, "", " ", "Hello  world\n", "été ☃ x", "a " * 4000, "▁b ▁", "tab\tand\r\nmore ", "a " * 4000]
    rows = [(i, t, 1) for i, t in enumerate(texts)] + [(None, "x", 2)]
    spark.createDataFrame(rows, "doc_id long, text string, score int").write.parquet(f"{tmp_path}/documents.parquet")
    lat = P.PieceLattice(MODEL, 3)
    out = P.op7_sentencepiece_nbest(spark, str(tmp_path)).collect()
    assert len(out) == len(rows)
    by = {d: t for d, t, _ in rows}
    for r in out:
        t = by[r["doc_id"]] or ""
        assert r["decoded_sha256"] == hashlib.sha256(t.replace(P.SPACE, " ").encode()).hexdigest()
        assert r["score"] == (viterbi(lat, P.SPACE + t.replace(" ", P.SPACE)) if t else 0)
        assert r["ids_crc32"] == zlib.crc32(lat.encode(t.encode())[0][1])
        assert len([x for x in r["others"].split(",") if x]) <= 2


def test_round_trip_on_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    found = P.encode_nbest(docs, MODEL, 2).selectExpr("doc_id", "paths[0].ids AS ids", "size(paths) AS n")
    back = P.decode_ids(found, MODEL).join(docs.selectExpr("doc_id", "text AS want"), "doc_id")
    assert back.where("text <> want OR n < 2").count() == 0 and back.count() == docs.count()


def test_empty(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert P.op7_sentencepiece_nbest(spark, str(tmp_path)).collect() == []
