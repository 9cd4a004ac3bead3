"""Records of evaluation splits that training records repeat (problem 6).

Records are canonicalised (lower case, all but letters and numbers taken as
one space), hashed, and evaluation hashes are joined with training hashes.
Near copies come from the same canonical tokens, hashed by windows of five and
joined by ``setjoin`` with evaluation on one side and training on the other:
pairs within a side are never formed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.classpairs import across, packed, sizes
from textloom.llm.nearcopies import CLASS
from textloom.llm.setjoin import JoinSpec, identity, similar_classes
from textloom.session import materialize

SPEC = JoinSpec(width=5, threshold=0.5)


def canonical(text: Column) -> Column:
    """Lower case; every run of other than letters and numbers is one space."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def with_role(samples: DataFrame) -> DataFrame:
    """(id, text, role, place, source_dataset); role 1 is training, 2 evaluation; other rows are left out.

    place is the eval_set where there is one, else the split.
    """
    role = F.when(F.col("eval_set").isNotNull() | F.col("split").isin("calib", "test"), 2).when(F.col("split") == "train", 1)
    rows = samples.where(F.col("id").isNotNull() & F.col("text").isNotNull()).select("id", "text", role.cast("tinyint").alias("role"), F.coalesce("eval_set", "split").alias("place"), "source_dataset")
    return rows.where("role is not null")


def cross_split_links(samples: DataFrame, spec: JoinSpec = SPEC) -> DataFrame:
    """(eval_id, train_id, exact): each evaluation record with each training record it repeats.

    exact: the canonical texts are equal, or the texts where they are under
    ``width`` tokens (such texts are too short for windows, and case and signs
    may be all that tells them apart).  Null texts have no links; repeated
    rows count once.
    """
    rows = with_role(samples)
    plain = canonical(F.col("text"))
    long = F.size(F.split(plain, " ", spec.width)) >= spec.width
    told = rows.select("id", "role", *identity("text"), F.when(long, plain).otherwise(F.concat(F.lit("\n"), "text")).alias("kept"))
    told = materialize(told.select("id", "role", "sig", "check", F.xxhash64("kept").alias("h"), F.xxhash64(F.lit("check"), "kept").alias("g")), "records")
    evals, trains = told.where("role = 2"), told.where("role = 1")
    links = materialize(similar_classes(rows.select(*identity("text"), "role", "text"), spec).drop("similarity"), "links")
    # a text may stand on both sides, so that links are asked in both directions
    both = links.unionByName(links.select(*[F.col(f"{c}_{x}").alias(f"{c}_{y}") for x, y in ("ba", "ab") for c in CLASS]))
    ends = both.select(*[F.col(f"{c}_a").alias(c) for c in CLASS]).distinct()
    near = across(both, *[packed(x.select("id", *CLASS), sizes(x, CLASS).join(ends, CLASS, "left_semi"), CLASS) for x in (evals, trains)], CLASS)
    keys = ["h", "g"]
    met = told.groupBy(*keys).agg(F.count_if(F.col("role") == 2).alias("n_2"), F.count_if(F.col("role") == 1).alias("n_1")).where("n_1 > 0 and n_2 > 0")
    met = materialize(met, "met")
    same = met.select(*[F.col(c).alias(f"{c}_{x}") for x in "ab" for c in keys])
    exact = across(same, *[packed(x.select("id", *keys), met.withColumnRenamed(n, "n"), keys) for x, n in ((evals, "n_2"), (trains, "n_1"))], keys)
    near, exact = (x.select(F.col("x").alias("eval_id"), F.col("y").alias("train_id"), F.lit(e).alias("e")) for x, e in ((near, 0), (exact, 1)))
    return near.unionByName(exact).groupBy("eval_id", "train_id").agg((F.max("e") == 1).alias("exact"))


def cross_split_pairs(samples: DataFrame, spec: JoinSpec = SPEC) -> DataFrame:
    """(id_a < id_b), one row a pair."""
    return cross_split_links(samples, spec).select(F.least("eval_id", "train_id").alias("id_a"), F.greatest("eval_id", "train_id").alias("id_b")).distinct()


def cross_split_report(samples: DataFrame, spec: JoinSpec = SPEC) -> DataFrame:
    """Per place (split or eval_set) and source_dataset of the evaluation record: records, those met in training exactly or nearly, and pairs."""
    links = cross_split_links(samples, spec).groupBy(F.col("eval_id").alias("id")).agg(F.count("*").alias("pairs"), F.max("exact").alias("any_exact"))
    rows = with_role(samples).where("role = 2").select("id", "place", "source_dataset").dropDuplicates(["id"])
    return rows.join(links, "id", "left").groupBy("place", "source_dataset").agg(F.count("*").alias("n_records"), F.count_if(F.col("any_exact")).alias("n_exact"), F.count_if(~F.col("any_exact")).alias("n_near_only"), F.coalesce(F.sum("pairs"), F.lit(0)).cast("long").alias("n_pairs"))
