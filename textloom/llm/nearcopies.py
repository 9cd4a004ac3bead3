"""Near-duplicate records: pairs, links and groups (problem 2)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.classpairs import across, inside, packed, sizes
from textloom.llm.setjoin import JoinSpec, identity, similar_classes
from textloom.operators.components import connected_components
from textloom.session import materialize, settle

#: Near-duplicates by the project's statement: five-token windows, half of them shared.
SPEC = JoinSpec(width=5, threshold=0.5)
CLASS = ["sig", "check"]


def _present(records: DataFrame, key: str, text: str) -> DataFrame:
    return records.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("id"), F.col(text).alias("text"))


def members(records: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """(id, sig, check): the class of equal texts each record belongs to, as often as it is delivered. Null texts and keys belong to none."""
    return _present(records, key, text).select("id", *identity("text"))


def class_links(records: DataFrame, key: str = "id", text: str = "text", spec: JoinSpec = SPEC) -> DataFrame:
    """(sig_a, check_a, sig_b, check_b, similarity) between different texts of the whole table.

    Nulls, empty and short texts have no windows and so no links; repeated
    rows count once; other columns are ignored, whatever their names.
    """
    docs = _present(records, key, text).select(*identity("text"), F.lit(3).cast("tinyint").alias("role"), "text")
    return similar_classes(docs, spec)


def near_duplicate_pairs(records: DataFrame, key: str = "id", text: str = "text", spec: JoinSpec = SPEC) -> DataFrame:
    """All pairs (id_a < id_b) of records whose texts are equal or similar enough."""
    links = materialize(class_links(records, key, text, spec).drop("similarity"), "links")
    settle(records.sparkSession)
    who = members(records, key, text)
    ends = links.select(F.col("sig_a").alias("sig"), F.col("check_a").alias("check")).unionAll(links.select(F.col("sig_b").alias("sig"), F.col("check_b").alias("check"))).distinct()
    # only classes with a link or with two members have pairs
    wanted = sizes(who, CLASS).join(ends.withColumn("linked", F.lit(True)), CLASS, "left").where("linked or n > 1")
    packs = packed(who, wanted, CLASS)
    settle(records.sparkSession)
    between = across(links, packs, packs, CLASS)
    pairs = between.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))
    pairs = pairs.unionAll(inside(packs, CLASS))
    # a pair comes twice only where one id has two texts; else nothing as large as the result is shuffled
    return pairs.distinct() if _of_two_classes(packs) else pairs


def _of_two_classes(packs: DataFrame) -> bool:
    """Whether any id is in packs of more than one class."""
    return not packs.select(F.explode("ids").alias("id")).groupBy("id").count().where("count > 1").isEmpty()


def near_duplicate_groups(records: DataFrame, key: str = "id", text: str = "text", spec: JoinSpec = SPEC) -> DataFrame:
    """One row a record: its group (the least id in it), its copies and its links.

    Columns: id, group_id, n_copies (records with the equal text), n_links
    (different texts that are similar enough).  A record without any has a
    group of its own; one whose text is null is in no row.
    """
    name = lambda side="": F.concat_ws(":", f"sig{side}", f"check{side}")
    links = materialize(class_links(records, key, text, spec).select(name("_a").alias("a"), name("_b").alias("b")), "links")
    who = materialize(members(records, key, text).select("id", name().alias("class")).distinct(), "members")
    found = connected_components(links)
    degree = links.select(F.col("a").alias("class")).unionAll(links.select(F.col("b").alias("class"))).groupBy("class").agg(F.count("*").alias("n_links"))
    classes = who.groupBy("class").agg(F.count("*").alias("n_copies"), F.min("id").alias("first"))
    classes = classes.join(found.withColumnRenamed("node", "class"), "class", "left").join(degree, "class", "left").select("class", "n_copies", "first", F.coalesce("component", "class").alias("component"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    names = classes.groupBy("component").agg(F.min("first").alias("group_id"))
    return who.join(classes.join(names, "component"), "class").select("id", "group_id", "n_copies", "n_links")
