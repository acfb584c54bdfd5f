"""Vector expressions in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def finite(v: Column) -> Column:
    big = F.lit(float("inf"))
    return F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) != big))


def cosine_unit(a: Column, b: Column) -> Column:
    """Cosine of unit vectors, clamped; null for empty, unequal or non-finite ones."""
    d = dot(a, b)
    return F.when((F.size(a) > 0) & (F.size(a) == F.size(b)) & finite(a) & finite(b), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), d)))


def l2_normalize(v: Column) -> Column:
    norm = F.sqrt(dot(v, v))
    return F.when((F.size(v) > 0) & finite(v) & (norm > 0), F.transform(v, lambda x: x.cast("double") / norm))


def byte_distance(a: Column, b: Column) -> Column:
    """1 - cosine of byte vectors scaled to 0..1; null if a norm vanishes or sizes differ."""
    na, nb = F.sqrt(dot(a, a)) / 255, F.sqrt(dot(b, b)) / 255
    return F.when((F.size(a) > 0) & (F.size(a) == F.size(b)) & (na > 1e-9) & (nb > 1e-9), 1 - dot(a, b) / (255.0 * 255.0) / (na * nb))


def position_agreement(a: Column, b: Column) -> Column:
    """Share of equal positions: the default scorer of feature prints."""
    same = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    return F.when(F.size(a) == F.size(b), same / F.size(a))


def resample_mono(samples: Column, ratio: Column) -> Column:
    """Linear interpolation at ``j * ratio``, ``floor(n / ratio)`` samples."""
    n = F.floor(F.size(samples) / ratio).cast("int")
    last = F.size(samples) - 1

    def at(j):
        x = j * ratio
        i = F.least(F.floor(x).cast("int"), last)
        low, high = F.get(samples, i), F.get(samples, F.least(i + 1, last))
        return low + (high - low) * (x - i)

    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), at)).otherwise(F.array().cast("array<double>"))


def frame_times(duration: Column) -> Column:
    """At most three sparse timestamps of a video."""
    near_end = F.greatest(F.lit(0.0), duration - 0.5)
    return F.array_compact(F.array(F.lit(0.0), F.when(duration > 0.5, duration * 0.5), F.when((duration > 1.0) & (near_end > duration * 0.5 + 0.1), near_end)))
