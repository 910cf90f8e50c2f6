"""Vector arithmetic on array columns, and the hashing embedder."""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from palimpsest.functions.text import py_stems


def dot(a: Column, b: Column) -> Column:
    n = F.least(F.size(a), F.size(b))
    pairs = F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """0 for null, empty or zero vectors; the longer one is cut to the shorter in the product only."""
    size = norm(a) * norm(b)
    ok = (F.size(a) > 0) & (F.size(b) > 0) & (size > 0)
    return F.when(ok, dot(a, b) / size).otherwise(F.lit(0.0))


def hash_embedding(text: str, dim: int = 256) -> list[float]:
    """Signed feature hashing of stems, and of neighbouring pairs at half weight, to unit length."""
    vec = [0.0] * dim
    s = py_stems(text)
    for feature, w in [(t, 1.0) for t in s] + [(f"{a}\x1f{b}", 0.5) for a, b in zip(s, s[1:], strict=False)]:
        h = int.from_bytes(hashlib.blake2b(feature.encode(), digest_size=8).digest(), "big")
        vec[h % dim] += w if h >> 12 & 1 else -w
    size = math.sqrt(sum(x * x for x in vec)) or 1.0
    return [x / size for x in vec]


def embedder(dim: int = 256):
    """The hashing embedder as a vectorised function; BLAKE2b is no Spark function."""

    @F.pandas_udf("array<double>")
    def embed(texts):
        return texts.map(lambda t: hash_embedding(t or "", dim))

    return embed
