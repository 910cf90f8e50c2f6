import zlib

import numpy as np
import pytest

from palimpsest.llm import packing as P


def slow_plan(lengths, cap):
    """Best fit item by item."""
    bins = []
    for n in sorted(lengths, reverse=True):
        need = P.demand(n)
        lim = cap.limits()
        fits = [b for b in bins if all(b[i] >= need[d] for i, (d, _, _) in enumerate(lim))]
        if not fits:
            bins.append([c for _, _, c in lim])
            b = bins[-1]
        elif cap.score == "residual_norm":
            b = min(fits, key=lambda b: (sum(((b[i] - need[d]) * w / c) ** 2 for i, (d, w, c) in enumerate(lim)), b))
        else:
            b = min(fits, key=lambda b: (-sum(b[i] * need[d] * (w / c) ** 2 for i, (d, w, c) in enumerate(lim)), b))
        for i, (d, _, _) in enumerate(lim):
            b[i] -= need[d]
    return len(bins)


@pytest.mark.parametrize("score", ["residual_norm", "dot_product"])
@pytest.mark.parametrize("limits", [(None, None), (3, None), (4, 900), (40, 1600)])
def test_plan_equals_item_by_item(score, limits):
    rng = np.random.default_rng(5)
    for _ in range(6):
        lengths = rng.integers(1, 31, 200)
        cap = P.Capacity(40, *limits, score=score)
        hist = {int(k): int(v) for k, v in zip(*np.unique(lengths, return_counts=True), strict=True)}
        plan = P.best_fit_plan(hist, cap)
        assert plan.sequences == slow_plan(lengths.tolist(), cap)


def check_packed(rows, cap):
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for v in by.values():
        at = 0
        for o, n in sorted(v):
            assert o == at
            at += n
        assert at <= cap.tokens
        if cap.documents:
            assert len(v) <= cap.documents
        if cap.attention and len(v) > 1:
            assert sum(n * n for _, n in v) <= cap.attention
    return len(by)


def test_pack_respects_every_limit(spark):
    rng = np.random.default_rng(1)
    rows = [(int(i // 3), int(n)) for i, n in enumerate(rng.integers(0, 31, 500))] + [(1, 30)] * 50 + [(None, 7), (5, None)]
    df = spark.createDataFrame(rows, "doc_id long, length long")
    for cap in (P.Capacity(40), P.Capacity(40, 3, 900)):
        out = P.best_fit_pack(df, cap).collect()
        assert len(out) == sum(1 for r in rows if r[1])
        check_packed(out, cap)


def test_query_equals_plain_tokenizer(spark, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = ["", None, "It's  a \x1c Test l'été ÉTÉ ΣΣ \x01 a\x01b <|endoftext|>x 12\t3\n\nfoo!!bar", "word " * 5000, "a", "a", "你好 é"]
    rows = [(i, t, 1.0) for i, t in enumerate(texts)] + [(None, "null id", 2.0)]
    spark.createDataFrame(rows, "doc_id long, text string, piece double").write.parquet(f"{tmp_path}/documents.parquet")
    out = P.op1_best_fit_pack(spark, str(tmp_path)).collect()
    check_packed(out, P.Capacity(2048))
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out)
    want = []
    for d, t, _ in rows:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 0]
        for i in range(0, len(ids), 2048):
            part = np.asarray(ids[i : i + 2048], "<u4")
            want.append((d is None, d or 0, i // 2048, i, len(part), zlib.crc32(part.tobytes())))
    assert got == sorted(want)


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert P.op1_best_fit_pack(spark, str(tmp_path)).collect() == []
