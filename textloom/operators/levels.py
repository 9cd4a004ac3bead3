"""Levels and categories of analysis results, and stored tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def category(share: Column, confidence: Column, insufficient: Column) -> Column:
    """Unknown for too little text or confidence under 0.35; else by machine share at 0.15, 0.5 and 0.85."""
    return F.when(insufficient | (confidence < 0.35) | share.isNull(), "Unknown").when(share < 0.15, "Human").when(share < 0.5, "Human-assisted").when(share < 0.85, "AI-assisted").otherwise("AI")


def evidence_level(words: Column, low: int = 75, moderate: int = 150, reliable: int = 300) -> Column:
    return F.when(words < low, "insufficient").when(words < moderate, "low").when(words < reliable, "moderate").when(words.isNotNull(), "reliable")


def heat_level(p: Column) -> Column:
    return F.when(p < 0.2, "very low").when(p < 0.4, "low").when(p < 0.6, "medium").when(p < 0.8, "high").when(p.isNotNull(), "very high")


def length_reliability(words: Column) -> Column:
    """Straight lines through (0, 0), (50, .3), (100, .5), (250, .8), (500, .95), (1000, 1)."""
    points = [(0, 0.0), (50, 0.3), (100, 0.5), (250, 0.8), (500, 0.95), (1000, 1.0)]
    out = F.lit(1.0)
    for (a, u), (b, v) in reversed(list(zip(points[:-1], points[1:]))):
        out = F.when(words < b, u + (words - a) * ((v - u) / (b - a))).otherwise(out)
    return F.when(words.isNotNull(), out)


def agreement(probabilities: Column, weights: Column) -> Column:
    """1 less the weighted standard deviation over 0.35, at least 0; weights of 0.001 at least."""
    w = F.transform(weights, lambda x: F.greatest(x, F.lit(0.001)))
    total = F.aggregate(w, F.lit(0.0), lambda a, x: a + x)
    mean = F.aggregate(F.zip_with(probabilities, w, lambda p, x: p * x), F.lit(0.0), lambda a, x: a + x) / total
    var = F.aggregate(F.zip_with(probabilities, w, lambda p, x: x * (p - mean) * (p - mean)), F.lit(0.0), lambda a, x: a + x) / total
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.sqrt(F.greatest(var, F.lit(0.0))) / 0.35))


def overall_confidence(length: Column, agree: Column, coverage: Column, stability: Column) -> Column:
    return length * (0.6 + 0.4 * agree) * (0.5 + 0.5 * coverage * coverage * coverage) * (0.7 + 0.3 * stability)


def sentence_confidence(words: Column, agree: Column) -> Column:
    x = length_reliability(words) * (0.5 + 0.5 * agree)
    return F.when(x < 0.35, "Low").when(x < 0.65, "Medium").when(x.isNotNull(), "High")


def latest(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """The last row of each key by ``order`` (nulls first): an upsert of all rows in their order.

    An aggregate with partial results, not a window: a key of a third of all
    rows is reduced before the shuffle.
    """
    names = [c for c in rows.columns if c != key]
    out = rows.groupBy(key).agg(F.max(F.struct(*order, *[F.col(c).alias(f"_{c}") for c in names if c not in order])).alias("m"))
    return out.select(key, *[F.col(f"m.{c}") if c in order else F.col(f"m._{c}").alias(c) for c in names])


def insert_if_absent(there: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The stored rows and those new ones whose key is not there; of equal new keys, one."""
    fresh = new.dropDuplicates([key]).join(there.select(key), key, "left_anti")
    return there.unionByName(fresh, allowMissingColumns=True)


def delete_keys(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return rows.join(keys.select(key), key, "left_anti")
