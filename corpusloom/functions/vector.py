"""Vector expressions on arrays of doubles, evaluated on the JVM."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Sum of products; the longer vector is cut."""
    n = F.least(F.size(a), F.size(b))
    same = F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(same, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 if either vector has no length."""
    n = norm(a) * norm(b)
    return F.when(n == 0, F.lit(0.0)).otherwise(dot(a, b) / F.nullif(n, F.lit(0.0)))


def unit(a: Column) -> Column:
    """The vector at length 1; a zero vector stays."""
    return F.element_at(F.transform(F.array(norm(a)), lambda n: F.transform(a, lambda x: x.cast("double") / F.when(n == 0, F.lit(1.0)).otherwise(n))), 1)


#: Multiplier, increment and modulus of the generator behind mock embeddings.
LCG = (1664525, 1013904223, 1 << 32)


def lcg_steps(dim: int) -> list[tuple[int, int]]:
    """(a, c) of each step in closed form: the number after i steps is a * seed + c."""
    out, a, c = [], 1, 0
    for _ in range(dim):
        a, c = a * LCG[0] % LCG[2], (c * LCG[0] + LCG[1]) % LCG[2]
        out.append((a, c))
    return out


def mock_embedding(text: Column, dim: int = 64) -> Column:
    """A deterministic unit vector of a text: numbers of a linear congruential generator seeded by its hash.

    Each step is a closed form of the seed; the factor is split in halves, so that products stay below 2^63."""
    seed = F.conv(F.substring(F.md5(text.cast("binary")), 25, 8), 16, 10).cast("long")
    steps = F.array(*[F.struct(F.lit(a >> 16).cast("long").alias("h"), F.lit(a & 0xFFFF).cast("long").alias("l"), F.lit(c).cast("long").alias("c")) for a, c in lcg_steps(dim)])
    low = lambda x, bits: x.bitwiseAND(F.lit((1 << bits) - 1))
    number = lambda t, s: low(low(t["h"] * s, 16) * 65536 + t["l"] * s + t["c"], 32).cast("double") / F.lit(float(LCG[2] - 1)) * 2 - 1
    raw = F.transform(F.array(seed), lambda s: F.transform(steps, lambda t: number(t, s)))
    return F.element_at(F.transform(raw, unit), 1)


def mock_embed_text(text: str, dim: int = 64) -> list[float]:
    """mock_embedding of one text on the driver, for a query vector."""
    import hashlib

    s, out = int(hashlib.md5(text.encode()).hexdigest()[24:], 16), []
    for _ in range(dim):
        s = (s * LCG[0] + LCG[1]) % LCG[2]
        out.append(s / (LCG[2] - 1) * 2 - 1)
    n = math.sqrt(sum(x * x for x in out)) or 1.0
    return [x / n for x in out]
