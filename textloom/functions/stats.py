"""Statistics with their evidence guards: null where a value is undefined."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def std(x: Column, least: int = 2) -> Column:
    """Population standard deviation of at least ``least`` values."""
    return F.when(F.count(x) >= least, F.stddev_pop(x))


def cv(x: Column, least: int = 2) -> Column:
    """Standard deviation over mean, where the mean is positive."""
    return F.when((F.count(x) >= least) & (F.avg(x) > 0), F.stddev_pop(x) / F.avg(x))


def burst(x: Column, least: int = 2) -> Column:
    """(sd - mean) / (sd + mean): -1 for constant values, 0 for a Poisson process."""
    total = F.stddev_pop(x) + F.avg(x)
    return F.when((F.count(x) >= least) & (total > 0), (F.stddev_pop(x) - F.avg(x)) / total)


def entropy(counts: Column, k: int) -> Column:
    """Shannon entropy of an array of counts over ln k; null without counts."""
    total = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)
    h = F.aggregate(counts, F.lit(0.0), lambda a, x: a - F.when(x > 0, x / total * F.log(x / total)).otherwise(0.0))
    return F.when(total > 0, h / F.log(F.lit(float(k))))


def last_chunk(n: Column, size: int) -> Column:
    """Number of the last chunk of fixed size; a rest under half a chunk belongs to the one before."""
    return F.greatest(F.lit(0), F.floor(n / size) - F.when(n % size * 2 >= size, 0).otherwise(1)).cast("int")


def chunk_of(pos: Column, n: Column, size: int) -> Column:
    return F.least(F.floor(pos / size), last_chunk(n, size)).cast("int")


def js_divergence(a: Column, b: Column, smooth: float = 0.5) -> Column:
    """Jensen-Shannon divergence, base 2, of two arrays of counts after adding ``smooth`` to each."""
    ta = F.aggregate(a, F.lit(0.0), lambda s, x: s + x + smooth)
    tb = F.aggregate(b, F.lit(0.0), lambda s, x: s + x + smooth)

    def part(p: Column, m: Column) -> Column:
        return p * F.log2(p / m)

    return F.aggregate(F.zip_with(a, b, lambda x, y: (part((x + smooth) / ta, ((x + smooth) / ta + (y + smooth) / tb) / 2) + part((y + smooth) / tb, ((x + smooth) / ta + (y + smooth) / tb) / 2)) / 2), F.lit(0.0), lambda s, x: s + x)


def r6(x: Column) -> Column:
    return F.round(x, 6)
