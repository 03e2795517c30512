"""Vector and hash arithmetic on array columns, in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column, least: float = 1e-8) -> Column:
    """``a`` over its length, which counts as ``least`` at least."""
    n = F.greatest(norm(a), F.lit(least))
    return F.transform(a, lambda x: x.cast("double") / n)


def mean_vector(c: str, dim: int) -> Column:
    """The element-wise mean of a group: one combinable aggregate for each element."""
    return F.array(*[F.avg(F.element_at(c, i + 1).cast("double")) for i in range(dim)])


def hamming(a: Column, b: Column, words: int = 4) -> Column:
    """Bits in which two hashes of ``words`` words differ."""
    return sum((F.bit_count(F.element_at(a, i + 1).bitwiseXOR(F.element_at(b, i + 1))).cast("int") for i in range(1, words)), F.bit_count(F.element_at(a, 1).bitwiseXOR(F.element_at(b, 1))).cast("int"))


def _bits(h: Column, lo: int, hi: int, words: int) -> list[Column]:
    """Bits lo to hi - 1 of a hash, as one masked word for each word they touch."""
    out = []
    for w in range(words):
        a, b = max(lo, 64 * w), min(hi, 64 * w + 64)
        if a < b:
            mask = ((1 << (b - a)) - 1) << (a - 64 * w)
            out.append(F.element_at(h, w + 1).bitwiseAND(F.lit(mask - (1 << 64) if mask >= 1 << 63 else mask).cast("long")))
    return out


def hash_bands(h: Column, n: int, words: int = 4) -> Column:
    """``n`` keys of a hash, one for each of as many bands: hashes that differ in fewer than ``n`` bits share one."""
    cuts = [round(64 * words * i / n) for i in range(n + 1)]
    return F.array(*[F.xxhash64(F.lit(i), *_bits(h, cuts[i], cuts[i + 1], words)) for i in range(n)])


def second_bands(h: Column, band: Column, n: int, words: int = 4) -> Column:
    """``n`` keys within the band of number ``band``: each takes one cell of every other band.

    They part the remaining bits, so hashes that share the band and differ in fewer than ``n`` bits share one of them too.
    """
    cuts = [round(64 * words * i / (n * n)) for i in range(n * n + 1)]
    cell = lambda i, j: _bits(h, cuts[i * n + j], cuts[i * n + j + 1], words)
    by_band = [F.array(*[F.xxhash64(F.lit(j), *[x for k in range(n) if k != i for x in cell(k, j)]) for j in range(n)]) for i in range(n)]
    return F.element_at(F.array(*by_band), band + 1)


def pair_softmax(positive: Column, negative: Column) -> Column:
    """The share of the positive one of two scores."""
    return 1 / (1 + F.exp(negative - positive))


def clamp01(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
