"""Vector expressions on array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def cosine(a: Column, b: Column) -> Column:
    """0 for empty vectors, different lengths or a zero norm."""
    usable = (F.size(a) > 0) & (F.size(a) == F.size(b)) & (norm(a) > 0) & (norm(b) > 0)
    return F.when(usable, dot(a, b) / (norm(a) * norm(b))).otherwise(F.lit(0.0))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(
        _sum(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2.0))))
    )


METRICS = {"cosine": cosine, "euclidean": euclidean, "dot_product": dot}


def unit(a: Column) -> Column:
    """Unit length; a zero vector stays as it is."""
    length = norm(a)
    return F.transform(a, lambda x: F.when(length > 0, x.cast("double") / length).otherwise(x.cast("double")))


def parse_vector(text: Column) -> Column:
    """``"[1, 2]"`` to an array of doubles; NULL for anything else."""
    parsed = F.from_json(text, "array<double>")
    return F.when(F.exists(parsed, lambda x: x.isNull()), F.lit(None)).otherwise(parsed)


HASH_BITS, LIMB_BITS = 128, 32


def hash_embedding(text: Column, size: int = 384) -> Column:
    """Stand-in embedding: ``(md5(text) >> i) % 1000 / 1000`` for each position i, 0 beyond the digest.

    The digest is read as four 32-bit limbs. A position inside a limb needs the limb, shifted, plus
    everything above it modulo 1000 times a power of two, so every value fits a long.
    """
    digest = F.md5(text)
    limbs = [
        F.conv(F.substring(digest, HASH_BITS // 4 - 8 * k - 7, 8), 16, 10).cast("bigint") for k in range(4)
    ]  # lowest first
    step = pow(2, LIMB_BITS, 1000)
    uppers = [F.lit(0).cast("bigint")]
    for limb in reversed(limbs[1:]):
        uppers.insert(0, (limb % 1000 + uppers[0] * step) % 1000)
    parts = F.array(*[F.struct(a.alias("limb"), b.alias("upper")) for a, b in zip(limbs, uppers)])
    shifts = F.array(*[
        F.struct(F.lit(j).alias("by"), F.lit(pow(2, LIMB_BITS - j, 1000)).alias("weight")) for j in range(LIMB_BITS)
    ])

    def at(part: Column, shift: Column) -> Column:
        own = F.call_function("shiftright", part["limb"], shift["by"])
        return (own + part["upper"] * shift["weight"]) % 1000 / F.lit(1000.0)

    hashed = F.flatten(F.transform(parts, lambda part: F.transform(shifts, lambda shift: at(part, shift))))
    if size <= HASH_BITS:
        return F.slice(hashed, 1, size)
    return F.concat(hashed, F.array_repeat(F.lit(0.0), size - HASH_BITS))
