"""Language of a document by script and stop words, as columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.functions.langlabels import DETECTED
from textloom.functions.stopwords import STOPWORDS


def detect_language(docs: DataFrame) -> DataFrame:
    """Adds guess and confidence.

    Under 20 letters ``und``; half of the letters Greek ``el``; else the
    language with the largest share of its stop words among the first 3000
    words, ``und`` under 0.08; confidence is that share over 0.35, at most 1.
    """
    latin = [k for k in DETECTED if k != "el"]
    rows = docs.withColumn("_n", F.length(F.regexp_replace("text", r"[^\p{L}]", ""))).withColumn("_g", F.length(F.regexp_replace("text", r"[^\p{IsGreek}]", "")))
    rows = rows.withColumn("_w", F.slice(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0)), 1, 3000))

    def share(k: str):
        known = F.array(*[F.lit(x) for x in STOPWORDS[k].split()])
        return F.size(F.filter("_w", lambda v: F.array_contains(known, v))) / F.greatest(F.size("_w"), F.lit(1))

    rows = rows.withColumn("_r", F.array(*[share(k) for k in latin])).withColumn("_m", F.array_max("_r"))
    und, greek, weak = F.col("_n") < 20, F.col("_g") * 2 >= F.col("_n"), F.col("_m") < 0.08
    best = F.element_at(F.array(*[F.lit(k) for k in latin]), F.array_position("_r", F.col("_m")).cast("int"))
    out = rows.withColumn("guess", F.when(und, "und").when(greek, "el").when(weak, "und").otherwise(best))
    sure = F.when(und, 0.0).when(greek, F.round(F.col("_g") / F.col("_n"), 6)).when(weak, 0.0).otherwise(F.round(F.least(F.lit(1.0), F.col("_m") / 0.35), 6))
    return out.withColumn("confidence", sure).drop("_n", "_g", "_w", "_r", "_m")
