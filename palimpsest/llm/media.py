"""Audio columns: payloads held as 8-bit PCM, and features computed from the stored bytes.

Features: a polyphase resampler (2/3 of the rate), overlapped log-mel frames, and
segments of activity found with two thresholds. Frames are cut into tensors of one
fixed shape, each with the span of time that it covers; a clip's tensors are stored as
one Arrow stream of a fixed-shape tensor column beside its time spans. Every step works
on one clip alone and in blocks of one shape, so equal clips have equal features.
"""

from __future__ import annotations

import hashlib
import struct

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.work import own_columns, read_spread

RATE, UP, DOWN, TAPS = 12000, 2, 3, 8  # samples a second; resampling ratio; taps each side and phase
FRAME, HOP, MELS = 256, 128, 16
SHAPE = (16, MELS)  # frames by mel bands in a tensor
BLOCK = 256  # frames transformed at once
RAISE, LOWER = 6, 2  # steps above the mean level at which activity begins, and below which it ends
STEPS = 4.0  # levels are whole steps of a quarter of an octave of power


def wav(payload: bytes, rate: int = RATE) -> bytes:
    """A RIFF file of one channel of 8-bit samples."""
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload), b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(payload))
    return head + payload


def read_wav(data: bytes) -> tuple[int, bytes]:
    """(rate, samples) as the file's own chunks give them."""
    if data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        raise ValueError("not a RIFF wave file")
    at, rate = 12, None
    while at + 8 <= len(data):
        name, size = struct.unpack_from("<4sI", data, at)
        if name == b"fmt ":
            kind, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", data, at + 8)
            if (kind, channels, bits) != (1, 1, 8):
                raise ValueError("only 8-bit mono PCM is stored here")
        elif name == b"data":
            return rate, data[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no data chunk")


def padded(raw: bytes, unit: int = 64) -> bytes:
    """Zero bytes up to a positive multiple of ``unit``."""
    return raw + bytes(max(unit, -(-len(raw) // unit) * unit) - len(raw))


def _kernel() -> np.ndarray:
    """Windowed-sinc low pass at the narrower band, by phase."""
    n = 2 * TAPS * UP + 1
    t = np.arange(n) - n // 2
    h = np.sinc(t / DOWN) * np.hamming(n)
    return (h / h.sum() * UP).astype(np.float32)


def _mel() -> np.ndarray:
    rate = RATE * UP / DOWN
    to_mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(to_mel(60.0), to_mel(rate / 2), MELS + 2) / 2595) - 1)
    f = np.fft.rfftfreq(FRAME, 1 / rate)
    up = (f[:, None] - edges[:-2]) / (edges[1:-1] - edges[:-2])
    down = (edges[2:] - f[:, None]) / (edges[2:] - edges[1:-1])
    return np.maximum(0, np.minimum(up, down)).astype(np.float32)


KERNEL, MEL, WINDOW = _kernel(), _mel(), np.hanning(FRAME + 1)[:-1].astype(np.float32)


def resample(x: np.ndarray) -> np.ndarray:
    """Output m is the sum over k of KERNEL[k] * x at (m * DOWN + mid - k) / UP, where that is whole:
    one short filter for each phase of m, no sample being computed that is not kept."""
    n, mid = -(-len(x) * UP // DOWN), len(KERNEL) // 2
    edge = TAPS + DOWN
    y = np.zeros(n, np.float32)
    wide = np.concatenate([np.zeros(edge, np.float32), x, np.zeros(2 * edge, np.float32)])
    for m in range(min(UP, n)):
        count = -(-(n - m) // UP)
        for k in range((m * DOWN + mid) % UP, len(KERNEL), UP):
            at = (m * DOWN + mid - k) // UP + edge
            y[m::UP] += KERNEL[k] * wide[at : at + DOWN * count : DOWN][:count]
    return y


def log_mel(y: np.ndarray) -> np.ndarray:
    """Whole steps of log power, frames by bands, int16; a clip has one frame at least."""
    n = max(1, -(-(len(y) - FRAME) // HOP) + 1)
    wide = np.zeros((-(-n // BLOCK) * BLOCK - 1) * HOP + FRAME, np.float32)
    wide[: len(y)] = y
    frames = np.lib.stride_tricks.sliding_window_view(wide, FRAME)[::HOP]
    out = np.empty((len(frames), MELS), np.int16)
    for i in range(0, len(frames), BLOCK):
        power = np.abs(np.fft.rfft(frames[i : i + BLOCK] * WINDOW, axis=1)).astype(np.float32) ** 2
        out[i : i + BLOCK] = np.rint(STEPS * np.log2(1e-4 + power @ MEL))
    return out[:n]


def active_spans(mel: np.ndarray) -> list[tuple[int, int]]:
    """[first, end) of frames that have risen RAISE steps over the mean level and not yet fallen LOWER below it."""
    level = mel.astype(np.int64).sum(axis=1) // MELS
    mean = int(level.sum() // len(level))
    said = np.where(level >= mean + RAISE, 1, np.where(level < mean - LOWER, -1, 0))
    last = np.maximum.accumulate(np.where(said != 0, np.arange(len(said)), -1))
    on = np.where(last >= 0, said[last], -1) == 1
    edge = np.flatnonzero(np.diff(np.concatenate([[False], on, [False]]).astype(np.int8)))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def tensors(mel: np.ndarray) -> np.ndarray:
    """(n, *SHAPE) int8; the last one is filled up with the lowest value."""
    n = -(-len(mel) // SHAPE[0])
    out = np.full((n * SHAPE[0], MELS), -128, np.int8)
    out[: len(mel)] = np.clip(mel, -127, 127)
    return out.reshape(n, *SHAPE)


def seconds(frame):
    """Where a frame begins."""
    return frame * HOP * DOWN / (RATE * UP)


SPAN = pa.struct([("start_s", pa.float64()), ("end_s", pa.float64())])


ROWS, SIZE = 64, 1 << 22  # clips, and about bytes, handed on at once
MADE = "payload binary, frames long, active array<struct<start_s:double,end_s:double>>, tensors binary"
KIND = pa.fixed_shape_tensor(pa.int8(), SHAPE)
TENSORS = pa.schema([("start_s", pa.float64()), ("end_s", pa.float64()), ("mel", KIND)])


def store_tensors(start: np.ndarray, end: np.ndarray, cells: np.ndarray) -> bytes:
    """An Arrow stream with a row for each tensor of ``cells``, (n, *SHAPE) int8, and the span that it covers."""
    flat = pa.FixedSizeListArray.from_arrays(pa.array(cells.reshape(-1)), SHAPE[0] * SHAPE[1])
    rows = pa.RecordBatch.from_arrays([pa.array(start), pa.array(end), pa.ExtensionArray.from_storage(KIND, flat)], schema=TENSORS)
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, TENSORS) as w:
        w.write_batch(rows)
    return out.getvalue().to_pybytes()


def read_tensors(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What store_tensors was given, as the stream says: (start_s, end_s, (n, *shape))."""
    rows = pa.ipc.open_stream(data).read_all().combine_chunks()
    start, end = (rows[c].to_numpy() for c in ("start_s", "end_s"))
    return start, end, rows["mel"].chunk(0).to_numpy_ndarray() if len(rows) else np.zeros((0, *rows.schema.field("mel").type.shape), np.int8)


def _slices(sizes: list[int]):
    """[first, end) of neighbours that together stay within ROWS and, if more than one, SIZE."""
    i = 0
    while i < len(sizes):
        j, total = i + 1, sizes[i]
        while j < len(sizes) and j - i < ROWS and total + sizes[j] <= SIZE:
            total += sizes[j]
            j += 1
        yield i, j
        i = j


def _stored(batch: pa.RecordBatch):
    for i, j in _slices([len(t.as_buffer()) for t in batch.column(1)]):
        raw = [t.as_buffer().to_pybytes() for t in batch.column(1).slice(i, j - i)]
        cols = [batch.column(0).slice(i, j - i), pa.array([len(r) for r in raw], pa.int64()), pa.array([wav(padded(r)) for r in raw], pa.binary())]
        yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_bytes", "media"])


def _featured(batch: pa.RecordBatch):
    at = batch.schema.names.index("media")
    for i, j in _slices([len(m.as_buffer()) for m in batch.column(at)]):
        part = batch.slice(i, j - i)
        payload, frames, active, made = [], [], [], []
        for m in part.column(at):
            _, samples = read_wav(m.as_buffer().to_pybytes())
            mel = log_mel(resample((np.frombuffer(samples, np.uint8).astype(np.float32) - 128) / 128))
            payload.append(samples)
            frames.append(len(mel))
            active.append([{"start_s": seconds(a), "end_s": seconds(z)} for a, z in active_spans(mel)])
            first = np.arange(0, len(mel), SHAPE[0])
            made.append(store_tensors(seconds(first), seconds(np.minimum(first + SHAPE[0], len(mel))), tensors(mel)))
        new = [pa.array(payload, pa.binary()), pa.array(frames, pa.int64()), pa.array(active, pa.list_(SPAN)), pa.array(made, pa.binary())]
        yield pa.RecordBatch.from_arrays([*part.columns, *new], [*part.schema.names, "payload", "frames", "active", "tensors"])


def _source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return own_columns(docs, id_col, text_col).select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def _media_schema(src: DataFrame) -> str:
    return f"doc_id {src.schema['doc_id'].dataType.simpleString()}, n_bytes long, media binary"


def store_audio(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): each text's UTF-8, padded, as a wave file; a null text is empty."""
    src = _source(docs, id_col, text_col)
    return src.mapInArrow(lambda batches: (s for b in batches for s in _stored(b)), _media_schema(src))


def audio_features(media: DataFrame) -> DataFrame:
    """``media`` with payload (read back), frames, active spans, and tensors: the stored stream of log-mel
    tensors with their spans of time, for read_tensors."""
    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in media.schema)
    return media.mapInArrow(lambda batches: (s for b in batches for s in _featured(b)), f"{own}, {MADE}")


def audio_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """audio_features(store_audio(docs)) in one pass of one worker."""
    src = _source(docs, id_col, text_col)
    return src.mapInArrow(lambda batches: (f for b in batches for s in _stored(b) for f in _featured(s)), f"{_media_schema(src)}, {MADE}")


def _digest(data: bytes) -> tuple[int, str]:
    """(number of tensors, hash of their cells and spans), read from the stored stream."""
    start, end, cells = read_tensors(data)
    told = hashlib.sha256(cells.tobytes())
    told.update(np.stack([start, end]).astype("<f8").tobytes())
    return len(cells), told.hexdigest()[:32]


def tensor_digests(tensors) -> F.Column:
    """struct(n, sha) of a column of stored tensors."""

    @F.pandas_udf("n long, sha string")
    def told(data: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_digest(x) for x in data], columns=["n", "sha"])

    return told(tensors)


def op9_audio_features(spark, sf_dir: str) -> DataFrame:
    """feature: frames;tensors;digest of the stored tensors, read back;active spans in seconds."""
    made = audio_table(read_spread(spark, f"{sf_dir}/documents.parquet")).withColumn("_t", tensor_digests("tensors"))
    spans = F.array_join(F.transform("active", lambda s: F.concat_ws("-", s["start_s"].cast("decimal(18,4)"), s["end_s"].cast("decimal(18,4)"))), ",")
    told = F.concat_ws(";", F.col("frames"), F.col("_t.n"), F.col("_t.sha"), spans)
    return made.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, octet_length(payload) - 63, 64)")).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        told.alias("feature"),
    )

