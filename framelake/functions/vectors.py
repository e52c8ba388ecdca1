"""Column builders for vectors, distributions and bit patterns; sums are taken in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def unit(a: Column) -> Column:
    """``a`` scaled to length 1; null for the zero vector."""
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x.cast("double") / n))


def softmax(scores: Column, scale: float = 1.0) -> Column:
    """Probabilities of an array of scores times ``scale``; the greatest is taken off first, so nothing overflows."""
    top = F.array_max(scores)
    e = F.transform(scores, lambda x: F.exp((x - top) * scale))
    total = F.aggregate(e, F.lit(0.0), lambda s, x: s + x)
    return F.transform(e, lambda x: x / total)


def top_labels(names: Column, probs: Column, n: int, least: float) -> Column:
    """The ``n`` likeliest names above ``least`` as array<struct<p, name>>, likeliest first, ties by name."""
    pairs = F.zip_with(names, probs, lambda k, p: F.struct((-p).alias("np"), k.alias("name")))
    best = F.slice(F.array_sort(pairs), 1, n)
    return F.transform(F.filter(best, lambda s: -s.np > least), lambda s: F.struct((-s.np).alias("p"), s["name"].alias("name")))


def bit_distance(a: Column, b: Column) -> Column:
    """Differing bits of two bigints."""
    return F.bit_count(a.bitwiseXOR(b))


def greatest_label(values: list[tuple[Column, str]]) -> Column:
    """struct(value, label) of the greatest value, nulls last, ties by the later label in the alphabet."""
    return F.greatest(*[F.struct(v.alias("value"), F.lit(k).alias("label")) for v, k in values])


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def merge_settings(base: Column, change: Column, bounds: dict[str, tuple[float, float]], delta: bool) -> Column:
    """Map of the keys in ``bounds``: ``base`` changed by (``delta``) or to ``change``, clamped; keys without a change are left out."""
    known = F.map_filter(change, lambda k, v: k.isin(*bounds) & v.isNotNull())
    low, high = (F.create_map(*[F.lit(y) for k, b in bounds.items() for y in (k, float(b[i]))]) for i in (0, 1))
    start = F.coalesce(base, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<double>")))
    value = (lambda k, v: v + F.coalesce(F.try_element_at(start, k), F.lit(0.0))) if delta else (lambda k, v: v)
    return F.transform_values(known, lambda k, v: F.greatest(F.try_element_at(low, k), F.least(F.try_element_at(high, k), value(k, v))))


def valid_crop(left: Column, top: Column, right: Column, bottom: Column, least: float = 0.05) -> Column:
    """All four within [0, 1] and at least ``least`` apart; false for nulls."""
    inside = left.between(0, 1) & right.between(0, 1) & top.between(0, 1) & bottom.between(0, 1)
    return F.coalesce(inside & (right - left >= least) & (bottom - top >= least), F.lit(False))
