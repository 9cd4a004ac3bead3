"""Metrics of scored rows (label y 0/1, score p), whole or by group.

Scores are first counted by distinct value: windows then run over distinct
scores (rounded to 6 digits, a million at most), not over rows, so that a
group of a third of all rows is aggregated map-side and never sorted as rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.operators.corpus import seeded


def score_counts(scored: DataFrame, by: list[str], weight: Column | None = None) -> DataFrame:
    """(by, p, pos, neg): weighted rows of either label at each distinct score."""
    w = weight if weight is not None else F.lit(1.0)
    return scored.where("y is not null and p is not null").groupBy(*by, F.round("p", 6).alias("p")).agg(F.sum(F.when(F.col("y") == 1, w).otherwise(0.0)).alias("pos"), F.sum(F.when(F.col("y") == 0, w).otherwise(0.0)).alias("neg"))


def _curve(counts: DataFrame, by: list[str]) -> DataFrame:
    """Counts at or above each score, and totals."""
    down = Window.partitionBy(*by).orderBy(F.desc("p")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy(*by)
    return counts.withColumns({"tp": F.sum("pos").over(down), "fp": F.sum("neg").over(down), "P": F.sum("pos").over(whole), "N": F.sum("neg").over(whole)})


def ranking_metrics(scored: DataFrame, by: list[str]) -> DataFrame:
    """(by, roc_auc, pr_auc, tpr_at_1, tpr_at_5).

    ROC AUC counts a tie as half; PR AUC is the sum of precision times the
    step of recall over distinct scores; the rate of true positives at a rate
    of false ones lies on the straight line between neighbouring points.
    Null where a group lacks a class.
    """
    c = _curve(score_counts(scored, by), by)
    point = c.withColumns({"tpr": F.col("tp") / F.when(F.col("P") > 0, F.col("P")), "fpr": F.col("fp") / F.when(F.col("N") > 0, F.col("N"))})
    auc = F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / 2)) / F.when((F.max("P") > 0) & (F.max("N") > 0), F.max("P") * F.max("N"))
    pr = F.sum(F.col("pos") / F.when(F.col("P") > 0, F.col("P")) * F.col("tp") / (F.col("tp") + F.col("fp")))

    def at(x: float) -> Column:
        under = F.max(F.when(F.col("fpr") <= x, F.struct("fpr", "tpr")))
        over = F.min(F.when(F.col("fpr") > x, F.struct("fpr", "tpr")))
        f0, t0 = F.coalesce(under["fpr"], F.lit(0.0)), F.coalesce(under["tpr"], F.lit(0.0))
        value = F.when(over.isNull(), t0).otherwise(t0 + (x - f0) / (over["fpr"] - f0) * (over["tpr"] - t0))
        return F.when((F.max("P") > 0) & (F.max("N") > 0), value)

    return point.groupBy(*by).agg(F.round(auc, 6).alias("roc_auc"), F.round(F.when((F.max("P") > 0) & (F.max("N") > 0), pr), 6).alias("pr_auc"), F.round(at(0.01), 6).alias("tpr_at_1"), F.round(at(0.05), 6).alias("tpr_at_5"))


def threshold_metrics(scored: DataFrame, by: list[str], threshold: float = 0.5) -> DataFrame:
    """(by, n, tp, tn, fp, fn, accuracy, balanced_accuracy, precision, recall, f1, fpr, fnr, brier): at a threshold; Brier with balanced weights."""
    s = scored.where("y is not null and p is not null")
    hit = F.col("p") >= threshold
    agg = s.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.count_if((F.col("y") == 1) & hit).alias("tp"),
        F.count_if((F.col("y") == 0) & ~hit).alias("tn"),
        F.count_if((F.col("y") == 0) & hit).alias("fp"),
        F.count_if((F.col("y") == 1) & ~hit).alias("fn"),
        F.avg(F.when(F.col("y") == 1, (1 - F.col("p")) * (1 - F.col("p")))).alias("b1"),
        F.avg(F.when(F.col("y") == 0, F.col("p") * F.col("p"))).alias("b0"),
    )
    div = lambda a, b: F.round(a / F.when(b > 0, b), 6)
    tp, tn, fp, fn = (F.col(x) for x in ("tp", "tn", "fp", "fn"))
    return agg.select(
        *by, "n", "tp", "tn", "fp", "fn",
        div(tp + tn, F.col("n")).alias("accuracy"),
        F.round((tp / F.when(tp + fn > 0, tp + fn) + tn / F.when(tn + fp > 0, tn + fp)) / 2, 6).alias("balanced_accuracy"),
        div(tp, tp + fp).alias("precision"), div(tp, tp + fn).alias("recall"), div(2 * tp, 2 * tp + fp + fn).alias("f1"),
        div(fp, fp + tn).alias("fpr"), div(fn, fn + tp).alias("fnr"), F.round((F.col("b1") + F.col("b0")) / 2, 6).alias("brier"),
    )


def wilson(k: Column, n: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """Bounds of the Wilson interval; null for no rows."""
    m = F.when(n > 0, n.cast("double"))
    centre = (k / m + z * z / (2 * m)) / (1 + z * z / m)
    half = z / (1 + z * z / m) * F.sqrt(k / m * (1 - k / m) / m + z * z / (4 * m * m))
    return F.greatest(F.lit(0.0), centre - half), F.least(F.lit(1.0), centre + half)


def balanced_weights(scored: DataFrame, by: list[str]) -> DataFrame:
    """Adds w = n / (2 n of the label) within each group."""
    n = scored.groupBy(*by, "y").agg(F.count("*").alias("_c"))
    both = n.withColumn("w", F.sum("_c").over(Window.partitionBy(*by)) / (2.0 * F.col("_c"))).drop("_c")
    return scored.join(F.broadcast(both) if not by else both, [*by, "y"])  # without groups: a row a label


def loss(scored: DataFrame, by: list[str]) -> DataFrame:
    """(by, brier, log_loss) with the weights w; probabilities are clipped at 1e-6 for the logarithm."""
    p = F.least(F.greatest(F.col("p"), F.lit(1e-6)), F.lit(1 - 1e-6))
    return scored.groupBy(*by).agg(F.round(F.sum(F.col("w") * (F.col("p") - F.col("y")) ** 2) / F.sum("w"), 6).alias("brier"), F.round(-F.sum(F.col("w") * (F.col("y") * F.log(p) + (1 - F.col("y")) * F.log(1 - p))) / F.sum("w"), 6).alias("log_loss"))


def reliability(scored: DataFrame, by: list[str], bins: int = 10) -> DataFrame:
    """(by, bin, n, mean_p, share_1, weight) for every bin, empty ones too (n 0, the rest null)."""
    b = F.least(F.greatest(F.floor(F.col("p") * bins), F.lit(0)), F.lit(bins - 1)).cast("int")
    got = scored.groupBy(*by, b.alias("bin")).agg(F.count("*").alias("n"), (F.sum(F.col("w") * F.col("p")) / F.sum("w")).alias("mean_p"), (F.sum(F.col("w") * F.col("y")) / F.sum("w")).alias("share_1"), F.sum("w").alias("weight"))
    spine = got.select(*by).distinct() if by else scored.sparkSession.range(1).select(F.lit(1).alias("_one"))
    spine = spine.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    return spine.join(got, [*by, "bin"], "left").select(*by, "bin", F.coalesce("n", F.lit(0)).cast("long").alias("n"), "mean_p", "share_1", "weight")


def expected_calibration_error(scored: DataFrame, by: list[str], bins: int = 10) -> DataFrame:
    r = reliability(scored, by, bins)
    return r.groupBy(*by).agg(F.round(F.sum(F.col("weight") * F.abs(F.col("mean_p") - F.col("share_1"))) / F.sum("weight"), 6).alias("ece"))


def weighted_quantiles(rows: DataFrame, by: list[str], value: str, weight: str, qs: list[float]) -> DataFrame:
    """(by, q, value): linear interpolation of values on the share of weight up to and with them, ends clamped."""
    c = rows.groupBy(*by, F.round(value, 6).alias("v")).agg(F.sum(weight).alias("w")).where("w > 0")
    up = Window.partitionBy(*by).orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    c = c.withColumn("share", F.sum("w").over(up) / F.sum("w").over(Window.partitionBy(*by)))
    out = []
    for x in qs:
        under, over = F.max(F.when(F.col("share") <= x, F.struct("share", "v"))), F.min(F.when(F.col("share") > x, F.struct("share", "v")))
        value_at = F.when(under.isNull(), over["v"]).when(over.isNull(), under["v"]).otherwise(under["v"] + (x - under["share"]) / (over["share"] - under["share"]) * (over["v"] - under["v"]))
        out.append(c.groupBy(*by).agg(F.round(value_at, 6).alias("value")).select(*by, F.lit(x).alias("q"), "value"))
    return reduce(DataFrame.unionByName, out)


def bands(scored: DataFrame, q: float = 0.05) -> DataFrame:
    """One row (t_high, t_low): the (1 - q) quantile of human scores within [.5, .9] and the q quantile of machine scores within [.1, .5]."""
    rows = scored.withColumn("_w", F.lit(1.0))
    high = weighted_quantiles(rows.where("y = 0"), [], "p", "_w", [1 - q]).select(F.greatest(F.lit(0.5), F.least(F.lit(0.9), F.col("value"))).alias("t_high"))
    low = weighted_quantiles(rows.where("y = 1"), [], "p", "_w", [q]).select(F.greatest(F.lit(0.1), F.least(F.lit(0.5), F.col("value"))).alias("t_low"))
    return high.crossJoin(low)  # one row each


def bootstrap_auc(scored: DataFrame, group: str, replicates: int = 500, seed: str = "7") -> DataFrame:
    """One row (auc, low, high, n_valid): whole groups drawn with Poisson(1) weights from a hash, 2.5 and 97.5 percentiles.

    A group's weight in a replicate is told from its hash alone, so that no
    table of draws is needed.  A hot group's rows are first counted by score.
    """
    counts = scored.where("y is not null and p is not null").groupBy(group, F.round("p", 6).alias("p")).agg(F.count_if(F.col("y") == 1).alias("n1"), F.count_if(F.col("y") == 0).alias("n0"))
    u = seeded(group, "rep", seed=seed) / F.lit(float(1 << 60))
    # the distribution function of Poisson(1) at 0, 1, 2, 3, 4, 5
    k = F.lit(6)
    for i, bound in reversed(list(enumerate((0.36787944, 0.73575888, 0.9196986, 0.98101184, 0.99634015, 0.99940582)))):
        k = F.when(u < bound, i).otherwise(k)
    drawn = counts.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(replicates)))).withColumn("k", k).where("k > 0")
    c = drawn.groupBy("rep", "p").agg(F.sum(F.col("k") * F.col("n1")).cast("double").alias("pos"), F.sum(F.col("k") * F.col("n0")).cast("double").alias("neg"))
    curve = _curve(c, ["rep"])
    auc = curve.groupBy("rep").agg((F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / 2)) / F.when((F.max("P") > 0) & (F.max("N") > 0), F.max("P") * F.max("N"))).alias("auc")).where("auc is not null")
    return auc.agg(F.round(F.avg("auc"), 6).alias("auc"), F.round(F.percentile("auc", 0.025), 6).alias("low"), F.round(F.percentile("auc", 0.975), 6).alias("high"), F.count("*").alias("n_valid"))


def threshold_from_suffix(rows: DataFrame, by: list[str], order: str, ok: str) -> DataFrame:
    """(by, least): the least ``order`` from which on all rows are ok; no row where the last isn't."""
    after = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    return rows.withColumn("_all", F.min(F.col(ok).cast("int")).over(after)).where("_all = 1").groupBy(*by).agg(F.min(order).alias("least"))


def feature_audit(long: DataFrame, least_rows: int = 50, least_auc: float = 0.9, top: int = 60) -> DataFrame:
    """(domain, feature, auc, n): features that tell the label alone within a domain.

    long: domain, feature, y, p (the value).  The larger of AUC and 1 - AUC;
    domains need ``least_rows`` rows and both labels.
    """
    n = long.where("y is not null and p is not null").groupBy("domain", "feature").agg(F.count("*").alias("n"), F.countDistinct("y").alias("k"))
    auc = ranking_metrics(long, ["domain", "feature"]).select("domain", "feature", F.greatest("roc_auc", 1 - F.col("roc_auc")).alias("auc"))
    return auc.join(n.where((F.col("n") >= least_rows) & (F.col("k") == 2)), ["domain", "feature"]).where(F.col("auc") >= least_auc).select("domain", "feature", F.round("auc", 6).alias("auc"), "n").orderBy(F.desc("auc"), "domain", "feature").limit(top)


def _fused(a: Column, b: Column, c: Column) -> Column:
    """a * b + c, rounded once (Dekker's product, Knuth's sum)."""

    def halves(x: Column) -> tuple[Column, Column]:
        high = x * 134217729.0 - (x * 134217729.0 - x)
        return high, x - high

    (a1, a2), (b1, b2), p = halves(a), halves(b), a * b
    s = p + c
    d = s - p
    return s + ((p - (s - d)) + (c - d) + ((a1 * b1 - p + a1 * b2 + a2 * b1) + a2 * b2))


def population_stats(long: DataFrame, least: int = 5) -> DataFrame:
    """(feature, y, n, mean, std, quantiles): per feature and label, 21 quantiles from 0 to 1; exact, from value counts.

    A quantile between two values is lower * (1 - part) + upper * part with one
    rounding of the sum, as the SQL has it: a half at the seventh digit would
    else fall either way.
    """
    counts = long.where("value is not null and y is not null").groupBy("feature", "y", F.round("value", 6).alias("value")).agg(F.count("*").alias("c"))
    group = Window.partitionBy("feature", "y")
    counts = counts.withColumns({"upto": F.sum("c").over(group.orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow)), "all": F.sum("c").over(group)})
    n = F.sum("c")
    mean = F.sum(F.col("value") * F.col("c")) / n
    at = lambda k: F.max(F.when((F.col("upto") - F.col("c") <= k) & (k < F.col("upto")), F.col("value")))
    spots = [(F.col("all") - 1) * F.lit(i / 20) for i in range(21)]
    ends = F.array(*[F.struct(at(F.floor(s)).alias("lo"), at(F.ceil(s)).alias("hi"), F.max(s - F.floor(s)).alias("part")) for s in spots])
    got = counts.groupBy("feature", "y").agg(n.alias("n"), F.round(mean, 6).alias("mean"), F.round(F.sqrt(F.greatest(F.lit(0.0), F.sum(F.col("value") ** 2 * F.col("c")) / n - mean * mean)), 5).alias("std"), ends.alias("ends")).where(F.col("n") >= least)
    raw = F.transform("ends", lambda x: F.when(x["part"] == 0, x["lo"]).otherwise(_fused(x["lo"], 1 - x["part"], x["hi"] * x["part"])))
    return got.select("feature", "y", "n", "mean", "std", F.transform(raw, lambda x: F.signum(x) * F.floor(F.abs(x) * 1e6 + 0.5) / 1e6).alias("quantiles"))


def percentile_in(value: Column, quantiles: Column) -> Column:
    """Where a value lies in 21 quantiles, from 0 to 100 by straight lines, ends clamped."""
    i = F.size(F.filter(quantiles, lambda x: x <= value))
    lo, hi = F.element_at(quantiles, F.greatest(i, F.lit(1))), F.element_at(quantiles, F.least(i + 1, F.lit(21)))
    inner = (i - 1 + F.when(hi > lo, (value - lo) / (hi - lo)).otherwise(0.0)) * 5.0
    return F.when(i == 0, 0.0).when(i >= 21, 100.0).otherwise(inner)
