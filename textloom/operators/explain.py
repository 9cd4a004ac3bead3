"""What stands behind a score: where measurements lie among human texts, what each adds, and whether detectors agree."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.functions.stats import r6
from textloom.operators import metrics as M
from textloom.operators.features import family_of

#: Contributions under this are no factors.
LEAST_FACTOR = 0.05


def long_features(features: DataFrame, key: str, names: list[str]) -> DataFrame:
    """(key, feature, value): one row a measurement, undefined ones too."""
    return features.select(key, F.inline(F.array(*[F.struct(F.lit(n).alias("feature"), F.col(n).cast("double").alias("value")) for n in names])))


def reference(long: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """(feature, human, ai, human_median, ai_median, human_mean): 21 quantiles of both labels and their middles; a row a feature."""
    stats = M.population_stats(long.join(labels.where("y is not null"), key).select("feature", "y", "value"))
    side = lambda y, c: F.first(F.when(F.col("y") == y, F.col(c)), ignorenulls=True)
    return stats.groupBy("feature").agg(side(0, "quantiles").alias("human"), side(1, "quantiles").alias("ai"), side(0, "mean").alias("human_mean")).withColumns({"human_median": F.col("human")[10], "ai_median": F.col("ai")[10]})


def statistics_panel(features: DataFrame, labels: DataFrame, key: str, names: list[str]) -> DataFrame:
    """(key, family, feature, value, human_percentile, human_median, ai_median) of every measurement.

    labels: (key, y).  Percentile and medians are null where a label has under
    five values; a null value has no percentile.
    """
    long = long_features(features, key, names)
    ref = reference(long, labels, key)
    percentile = F.when(F.col("value").isNotNull(), M.percentile_in(F.round("value", 6), F.col("human")))
    return long.join(F.broadcast(ref), "feature", "left").select(key, family_of(F.col("feature")).alias("family"), "feature", "value", F.round(percentile, 4).alias("human_percentile"), "human_median", "ai_median")  # a row a feature


def logit_change(columns: dict[str, Column], score: Callable[[dict[str, Column]], Column], base: dict[str, float | None]) -> Column:
    """An array of (feature, contribution): the score less the score with that measurement at its base; 0 without a base."""
    whole = score(columns)
    parts = [F.struct(F.lit(n).alias("feature"), (whole - score({**columns, n: F.lit(b)}) if b is not None else F.lit(0.0)).alias("contribution")) for n, b in base.items()]
    return F.array(*parts)


def attribution(features: DataFrame, labels: DataFrame, key: str, weights: dict[str, float]) -> DataFrame:
    """(key, feature, family, value, contribution, human_percentile, direction) under a linear score.

    A contribution is the change of the score against the human median of that
    measurement; null values and measurements without human values add 0.
    direction: low or high, against the human mean.
    """
    long = long_features(features, key, list(weights))
    ref = F.broadcast(reference(long, labels, key))  # a row a feature
    w = F.element_at(F.create_map(*[x for k, v in weights.items() for x in (F.lit(k), F.lit(v))]), F.col("feature"))
    x = long.join(ref, "feature", "left")
    return x.select(
        key, "feature", family_of(F.col("feature")).alias("family"), "value",
        F.round(F.coalesce(w * (F.col("value") - F.col("human_median")), F.lit(0.0)), 8).alias("contribution"),
        F.round(F.when(F.col("value").isNotNull(), M.percentile_in(F.round("value", 6), F.col("human"))), 4).alias("human_percentile"),
        F.when(F.col("value") < F.col("human_mean"), "low").when(F.col("value").isNotNull(), "high").alias("direction"),
    )


def family_contributions(contributions: DataFrame, key: str) -> DataFrame:
    """(key, family, contribution): sums over the measurements of a family."""
    return contributions.groupBy(key, "family").agg(F.round(F.sum("contribution"), 8).alias("contribution"))


def factors(contributions: DataFrame, key: str, top: int = 4, least: float = LEAST_FACTOR) -> DataFrame:
    """(key, side, rank, feature, contribution, direction): a report of the largest contributions either way, half as many toward human."""
    rows = contributions.where((F.abs("contribution") >= least) & F.col("value").isNotNull()).withColumn("side", F.when(F.col("contribution") > 0, "toward_ai").otherwise("toward_human"))
    rank = F.row_number().over(Window.partitionBy(key, "side").orderBy(F.desc(F.abs("contribution")), "feature"))  # one document's measurements
    return rows.withColumn("rank", rank).where(F.col("rank") <= F.when(F.col("side") == "toward_ai", top).otherwise(max(1, top // 2))).select(key, "side", "rank", "feature", "contribution", "direction")


def phrase(feature: Column, direction: Column) -> Column:
    """A measurement in words: "lower" or "higher" and its name."""
    return F.concat(F.when(direction == "low", "lower ").otherwise("higher "), F.replace(F.regexp_replace(feature, "^[a-z]+_", ""), F.lit("_"), F.lit(" ")))


NO_SIGNAL = "No individual signal stands out."
CAVEAT = "These are statistical indicators, not proof."


def summaries(found: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """(key, summary) of every key: the factors toward machine writing as a list, and the caveat."""
    listed = found.where("side = 'toward_ai'").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("rank", phrase(F.col("feature"), F.col("direction")).alias("t")))).alias("x"))
    text = F.concat(F.lit("Factors: "), F.array_join(F.transform("x", lambda v: v["t"]), "; "), F.lit(". "))
    return keys.select(key).distinct().join(listed, key, "left").select(key, F.concat(F.coalesce(text, F.lit(NO_SIGNAL + " ")), F.lit(CAVEAT)).alias("summary"))


def disagreement(rows: DataFrame, key: str, detectors: list[str]) -> DataFrame:
    """(key, spread, range, most_ai, most_human, note) over the detectors that have a score; ties go to the first by name.

    note: agree under a spread of 0.1, disagree from 0.2 on, else partly.
    """
    given = F.filter(F.array(*[F.struct(F.col(d).cast("double").alias("p"), F.lit(d).alias("d")) for d in sorted(detectors)]), lambda x: x["p"].isNotNull())
    x = rows.select(key, given.alias("g")).where(F.size("g") > 0)
    n, p = F.size("g"), F.transform("g", lambda v: v["p"])
    mean = F.aggregate(p, F.lit(0.0), lambda a, v: a + v) / n
    x = x.withColumn("mean", mean).withColumn("spread", F.round(F.sqrt(F.aggregate(p, F.lit(0.0), lambda a, v: a + (v - F.col("mean")) * (v - F.col("mean"))) / n), 6))
    first = lambda best: F.element_at(F.filter("g", lambda v: v["p"] == best), 1)["d"]
    note = F.when(F.col("spread") < 0.1, "agree").when(F.col("spread") >= 0.2, "disagree").otherwise("partly")
    return x.select(key, "spread", F.round(F.array_max(p) - F.array_min(p), 6).alias("range"), first(F.array_max(p)).alias("most_ai"), first(F.array_min(p)).alias("most_human"), note.alias("note"))


def paragraph_probability(sentences: DataFrame) -> DataFrame:
    """(doc_id, para, words, probability): mean of the sentences' p, weighted by words; null in a paragraph without words."""
    n = F.sum("words")
    return sentences.groupBy("doc_id", "para").agg(n.alias("words"), r6(F.sum(F.col("p") * F.col("words")) / F.when(n > 0, n)).alias("probability"))
