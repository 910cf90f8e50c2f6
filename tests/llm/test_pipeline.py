import re

import numpy as np
import xxhash

import corpus_pipeline as C
from palimpsest.llm import lines, quality, secrets, simhash
from tests.llm.test_lines import slow as slow_lines
from tests.llm.test_packing import check_packed
from palimpsest.llm.packing import Capacity


def shingles(t):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return frozenset(" ".join(words[i : i + 5]) for i in range(len(words) - 4)) or frozenset([" ".join(words)] if words else [])


def slow_near(rows, similarity=0.8):
    """Rows (id, text) that stay."""
    docs = sorted({(d is None, d or 0, t or "") for d, t in rows})
    sets = [shingles(t) for _, _, t in docs]
    up = list(range(len(docs)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if (not a and not b) or (a and b and len(a & b) >= similarity * len(a | b)):
                x, y = find(i), find(j)
                up[max(x, y)] = min(x, y)
    return sorted(((None if docs[i][0] else docs[i][1], docs[i][2]) for i in range(len(docs)) if find(i) == i), key=str)


def edited(rng, words, k):
    words = list(words)
    for i in rng.choice(len(words), k, replace=False):
        words[i] = f"edit{rng.integers(1e9)}"
    return words


def corpus(rng):
    vocab = [f"w{i}" for i in range(3000)]
    base = [list(rng.choice(vocab, int(n))) for n in rng.integers(60, 400, 60)]
    shared = list(rng.choice(vocab, 40))
    texts = [" ".join(b) for b in base]
    for i in range(25):
        texts += [" ".join(edited(rng, base[i], int(rng.integers(0, max(1, len(base[i]) // 60) + 1)))) for _ in range(4)]
        texts.append(" ".join(base[i]).upper())
    texts += [" ".join(edited(rng, b, len(b) // 4)) for b in base[:10]]
    texts += [" ".join(list(rng.choice(vocab, 50)) + shared) for _ in range(30)]
    return texts + ["", None, " ", "one", "One", "two words"]


def test_near_duplicates_equal_brute_force(spark):
    rng = np.random.default_rng(0)
    texts = corpus(rng)
    rows = [(int(d), t) for d, t in zip(rng.permutation(len(texts)), texts, strict=True)] + [(3, texts[0]), (3, texts[0]), (None, texts[1]), (None, "alone here")]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, sh int, `_x.y` string")
    out = simhash.drop_near_duplicates(df)
    assert out.columns == df.columns
    got = sorted(((r["doc_id"], r["text"] or "") for r in out.collect()), key=str)
    assert got == slow_near(rows)


def test_near_duplicates_of_many_variants(spark):
    """Variants of one unseen base around the threshold: the nearest by bits are often below it."""
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in rng.integers(0, 3000, 300)]
    rows = [(i, " ".join(edited(rng, base, int(rng.integers(4, 13))))) for i in range(300)]
    out = simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str) == slow_near(rows)


def test_near_duplicates_in_parts(spark, monkeypatch):
    """Blocks of over PART texts, or SHINGLES, are compared part by part: same classes."""
    rng = np.random.default_rng(8)
    base = [f"w{i}" for i in rng.integers(0, 3000, 150)]
    rows = [(i, " ".join(edited(rng, base, int(rng.integers(1, 20))))) for i in range(350)]
    df, want = spark.createDataFrame(rows, "doc_id long, text string"), slow_near(rows)
    for part, shingles in ((60, 1 << 22), (2048, 9000)):
        monkeypatch.setattr(simhash, "PART", part)
        monkeypatch.setattr(simhash, "SIDE", part)
        monkeypatch.setattr(simhash, "SHINGLES", shingles)
        assert sorted(((r["doc_id"], r["text"]) for r in simhash.drop_near_duplicates(df).collect()), key=str) == want


def test_near_matrix():
    rng = np.random.default_rng(2)
    fp = rng.integers(0, 1 << 63, (150, 2), dtype=np.uint64)
    fp[75:] = fp[:75] ^ (np.uint64(1) << rng.integers(0, 8, (75, 2)).astype(np.uint64))
    far = np.bitwise_count(fp[:, None] ^ fp[None]).sum(axis=2)
    for radius in (0, 1, 2, 3, 24, 48, 63):
        assert (simhash.near_matrix(fp, simhash.bit_planes(fp), len(fp), radius) == (far <= radius)).all()


def test_near_bits_alone_join_and_part_nothing(spark):
    """Many variants under the threshold, some near in bits; and pairs of 4 and 5 shingles, some far in bits."""
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in rng.integers(0, 3000, 300)]
    texts = [" ".join(edited(rng, base, 4)) for _ in range(400)]
    for i in range(300):
        words = [f"p{i}.{j}" for j in range(9)]
        texts += [" ".join(words), " ".join(words[:8])]
    rows = list(enumerate(texts))
    out = simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str) == slow_near(rows)


def test_near_duplicates_of_nothing(spark):
    assert simhash.drop_near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_stages_equal_brute_force(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    kept = C.quality_stage(spark, docs, d)
    assert kept.columns == docs.columns
    score = {r["doc_id"]: r["keep"] for r in quality.op3_quality_classifier(spark, d).collect()}
    assert sorted(r["doc_id"] for r in kept.select("doc_id").collect()) == sorted(i for i, k in score.items() if k)
    lined = C.line_stage(spark, docs, d).cache()
    rows = [(r["doc_id"], r["text"], r["source"]) for r in docs.collect()]
    want = {int(i): t for i, t, _, _ in slow_lines(rows, lines.MIN_SITES)}
    assert {r["doc_id"]: r["text"] for r in lined.collect()} == want and lined.where("n_chars <> length(text)").count() == 0
    one = C.near_dup_stage(spark, lined, d)
    assert sorted(((r["doc_id"], r["text"]) for r in one.collect()), key=str) == slow_near(list(want.items()))
    safe = C.secret_stage(spark, docs, d)
    assert {r["doc_id"]: r["text"] for r in safe.collect()} == {i: secrets.mask(t) for i, t, _ in rows}
    for t in (secrets.mask(t) for _, t, _ in rows):
        assert not secrets.find_secrets(t)


def test_whole_run(spark):
    d = "/root/testdata/sf0.001"
    out = C.run(spark, d).collect()
    check_packed(out, Capacity(2048))
    clean = {r["doc_id"] for r in quality.op3_quality_classifier(spark, d).where("keep").collect()}
    assert {r["doc_id"] for r in out} <= clean and len({r["doc_id"] for r in out}) > 0.7 * len(clean)


def test_odd_rows(spark, tmp_path):
    rows = [(None, None, None, None, None), (1, "", "en", "a", 0), (1, "x " * 40_000, None, "a", 5), (2, "token=abcdefghijklmnop\n", "en", None, 1), (2, "token=abcdefghijklmnop\n", "en", None, 1)]
    kind = "doc_id long, text string, lang string, source string, n_chars long, keep int, spans string, n_removed long"
    for some in (rows, []):
        df = spark.createDataFrame([(*r, 1, "s", 2) for r in some], kind)
        labels = spark.createDataFrame([(1, 1, 0), (None, 0, 1)], "doc_id long, quality int, toxic int")
        labels.write.mode("overwrite").parquet(f"{tmp_path}/labels.parquet")
        for _, stage in C.STAGES[:-1]:
            out = stage(spark, df, str(tmp_path))
            assert out.columns == df.columns
            out.collect()
        assert len(C.pack_stage(spark, df, str(tmp_path)).select("doc_id", "sequence_id").distinct().collect()) >= (3 if some else 0)


def test_xxh64_is_the_shingle_hash():
    assert simhash.shingle_hashes(b"A b", 5).tolist() == [xxhash.xxh64_intdigest(b"a b", 42)]
