import hashlib
import zlib

import numpy as np
import pyarrow as pa

from palimpsest.llm import media as M


def test_resample_equals_full_convolution():
    rng = np.random.default_rng(0)
    for n in (1, 2, 64, 65, 1000):
        x = rng.normal(size=n).astype(np.float32)
        wide = np.zeros(n * M.UP, np.float32)
        wide[:: M.UP] = x
        want = np.convolve(wide, M.KERNEL)[len(M.KERNEL) // 2 :][: n * M.UP : M.DOWN]
        got = M.resample(x)
        assert len(got) == -(-n * M.UP // M.DOWN)
        assert np.allclose(got[: len(want)], want, atol=1e-5)


def test_log_mel_equals_frame_by_frame():
    y = np.random.default_rng(1).normal(size=3000).astype(np.float32)
    got = M.log_mel(y)
    for i in range(len(got)):
        f = np.zeros(M.FRAME, np.float32)
        part = y[i * M.HOP : i * M.HOP + M.FRAME]
        f[: len(part)] = part
        p = np.abs(np.fft.rfft(f * M.WINDOW)) ** 2
        assert np.abs(got[i] - M.STEPS * np.log2(1e-4 + p @ M.MEL)).max() <= 0.51
    assert (len(got) - 1) * M.HOP + M.FRAME >= len(y)


def test_hysteresis():
    level = [0, 0, 30, 12, 12, 0, 12, 40, 40, 0]
    mean = sum(level) // len(level)
    on, want = False, []
    for v in level:
        on = True if v >= mean + M.RAISE else False if v < mean - M.LOWER else on
        want.append(on)
    spans = M.active_spans(np.repeat(np.asarray(level, np.int16)[:, None], M.MELS, axis=1))
    assert [any(a <= i < z for a, z in spans) for i in range(len(level))] == want


def test_query_round_trip(spark, tmp_path):
    texts = [None, "", "a", "é" * 40, "x" * 64, "The quick brown fox. " * 3000, "a", "zz\0\n" * 700]
    rows = [(i, t, b"x") for i, t in enumerate(texts)] + [(None, "a", b"y")]
    spark.createDataFrame(rows, "doc_id long, text string, media binary").write.parquet(f"{tmp_path}/documents.parquet")
    out = M.op9_audio_features(spark, str(tmp_path)).collect()
    assert len(out) == len(rows)
    by = {d: t for d, t, _ in rows}
    for r in out:
        raw = (by[r["doc_id"]] or "").encode()
        pay = raw + bytes(-len(raw) % 64 or (64 if not raw else 0))
        assert (r["n_bytes"], r["payload_bytes"]) == (len(raw), len(pay))
        assert r["payload_sha256"] == hashlib.sha256(pay).hexdigest() and r["tail_crc32"] == zlib.crc32(pay[-64:])
        assert r["media_bytes"] == len(pay) + 44 and r["media_sha256"] == hashlib.sha256(M.wav(pay)).hexdigest()
    a = [tuple(r)[1:] for r in out if by[r["doc_id"]] == "a"]
    assert len(a) == 3 and len(set(a)) == 1


def test_stored_tensors(spark):
    df = M.audio_features(M.store_audio(spark.createDataFrame([(1, "abc " * 2000)], "doc_id long, text string")))
    row = df.collect()[0]
    assert pa.ipc.open_stream(row["tensors"]).schema.field("mel").type == pa.fixed_shape_tensor(pa.int8(), M.SHAPE)
    start, end, cells = M.read_tensors(row["tensors"])
    assert cells.shape == (-(-row["frames"] // M.SHAPE[0]), *M.SHAPE) and start[1:].tolist() == end[:-1].tolist()
    whole = M.audio_table(spark.createDataFrame([(1, "abc " * 2000)], "doc_id long, text string"))
    assert whole.collect() == [row]


def slow_feature(text):
    """The feature string from the text, step by step in double precision; None where a level is too near a rounding edge to tell."""
    pay = M.padded(text.encode())
    x = (np.frombuffer(pay, np.uint8).astype(float) - 128) / 128
    n = 2 * M.TAPS * M.UP + 1
    t = np.arange(n) - n // 2
    h = np.sinc(t / M.DOWN) * np.hamming(n)
    wide = np.zeros(len(x) * M.UP)
    wide[:: M.UP] = x
    y = np.convolve(wide, h / h.sum() * M.UP)[n // 2 :][: len(wide) : M.DOWN]
    frames = max(1, -(-(len(y) - M.FRAME) // M.HOP) + 1)
    level = []
    for i in range(frames):
        f = np.zeros(M.FRAME)
        part = y[i * M.HOP : i * M.HOP + M.FRAME]
        f[: len(part)] = part
        power = np.abs(np.fft.rfft(f * np.hanning(M.FRAME + 1)[:-1])) ** 2
        level.append(M.STEPS * np.log2(1e-4 + power @ M.MEL.astype(float)))
    level = np.asarray(level)
    if (np.abs(level - np.floor(level) - 0.5) < 2e-4).any():
        return None
    mel = np.rint(level).astype(int)
    loud = mel.sum(axis=1) // M.MELS
    mean, on, spans = loud.sum() // frames, False, []
    for i, v in enumerate([*loud.tolist(), -(10**9)]):
        now = True if v >= mean + M.RAISE else False if v < mean - M.LOWER else on
        if now and not on:
            spans.append([i])
        if on and not now:
            spans[-1].append(i)
        on = now
    sec = lambda f: f * M.HOP * M.DOWN / (M.RATE * M.UP)
    parts = -(-frames // M.SHAPE[0])
    cells = np.full((parts * M.SHAPE[0], M.MELS), -128)
    cells[:frames] = mel.clip(-127, 127)
    edge = [(sec(i * M.SHAPE[0]), sec(min(frames, (i + 1) * M.SHAPE[0]))) for i in range(parts)]
    told = hashlib.sha256(cells.astype(np.int8).tobytes() + np.asarray(edge).T.astype("<f8").tobytes()).hexdigest()[:32]
    return f"{frames};{parts};{told};" + ",".join(f"{sec(a):.4f}-{sec(z):.4f}" for a, z in spans)


def test_feature_equals_slow_version(spark, tmp_path):
    rng = np.random.default_rng(9)
    words = ["the", "of", "zz", "\x01\x02", "é", "HARD", "\n"]
    texts = ["", "a", *("".join(rng.choice(words, int(rng.integers(1, 400)))) for _ in range(60))]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["feature"] for r in M.op9_audio_features(spark, str(tmp_path)).collect()}
    want = {i: slow_feature(t) for i, t in enumerate(texts)}
    sure = [i for i, w in want.items() if w is not None]
    assert len(sure) > 30 and {i: got[i] for i in sure} == {i: want[i] for i in sure}


def test_empty(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert M.op9_audio_features(spark, str(tmp_path)).collect() == []
