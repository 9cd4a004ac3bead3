"""Pairs of the members of classes, however many members a class has.

Members of a class are put into packs of a bounded number of keys, by hash.
Two classes that are linked, and a class with itself, become pairs of packs,
and each pair of packs is unfolded where it is joined: no task sees more of a
class than two packs at a time, and what is joined is as many rows as there
are pairs of packs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.session import materialize

#: Members a pack holds, about.
PACK = 500


def sizes(members: DataFrame, by: list[str]) -> DataFrame:
    """(*by, n): members of each class, repeated rows counted as often as they are there."""
    return members.groupBy(*by).agg(F.count("*").alias("n"))


def packed(members: DataFrame, classes: DataFrame, by: list[str], size: int = PACK) -> DataFrame:
    """(*by, pack, packs, ids): the members (*by, id) of the named classes (*by, n) in packs of about ``size``; repeated members count once."""
    named = classes.select(*by, F.ceil(F.col("n") / size).cast("int").alias("packs"))
    rows = members.join(named, by).withColumn("pack", F.pmod(F.xxhash64("id"), F.col("packs")).cast("int"))
    # by pack too, so that a hot class is no single task
    packs = rows.repartition(*by, "pack").groupBy(*by, "pack").agg(F.first("packs").alias("packs"), F.collect_set("id").alias("ids"))
    return materialize(packs, "packs")


def _side(packs: DataFrame, by: list[str], side: str) -> DataFrame:
    return packs.select(*[F.col(c).alias(f"{c}_{side}") for c in by], F.col("pack").alias(f"pack_{side}"), F.col("ids").alias(f"ids_{side}"))


def _unfolded(cells: DataFrame, left: DataFrame, right: DataFrame, by: list[str]) -> DataFrame:
    """(x, y) of the members of each cell (*by_a, pack_a, *by_b, pack_b)."""
    met = cells.join(_side(left, by, "a"), [*[f"{c}_a" for c in by], "pack_a"]).join(_side(right, by, "b"), [*[f"{c}_b" for c in by], "pack_b"])
    return met.select("pack_a", "pack_b", F.explode("ids_a").alias("x"), "ids_b").select("pack_a", "pack_b", "x", F.explode("ids_b").alias("y"))


def _numbered(packs: DataFrame, by: list[str], side: str) -> DataFrame:
    """Classes and how many packs they have; by hash some pack may be empty."""
    return packs.groupBy(*by).agg(F.max("packs").alias(f"packs_{side}")).select(*[F.col(c).alias(f"{c}_{side}") for c in by], f"packs_{side}")


def across(links: DataFrame, left: DataFrame, right: DataFrame, by: list[str]) -> DataFrame:
    """(x, y): every member x of a link's class a, in ``left``, with every member y of its class b, in ``right``.

    links: (*by_a, *by_b).  left and right: packs.
    """
    cells = links.join(_numbered(left, by, "a"), [f"{c}_a" for c in by]).join(_numbered(right, by, "b"), [f"{c}_b" for c in by])
    number = lambda side: F.explode(F.sequence(F.lit(0), F.col(f"packs_{side}") - 1)).alias(f"pack_{side}")
    keys = [f"{c}_{side}" for side in "ab" for c in by]
    cells = cells.select(*keys, "packs_b", number("a")).select(*keys, "pack_a", number("b"))
    return _unfolded(cells, left, right, by).where("x <> y").select("x", "y")


def inside(packs: DataFrame, by: list[str]) -> DataFrame:
    """(x, y): all pairs x < y of members of the same class."""
    classes = _numbered(packs.where("packs > 1 or size(ids) > 1"), by, "a")
    first = classes.select(*[f"{c}_a" for c in by], "packs_a", F.explode(F.sequence(F.lit(0), F.col("packs_a") - 1)).alias("pack_a"))
    cells = first.select(*[f"{c}_a" for c in by], *[F.col(f"{c}_a").alias(f"{c}_b") for c in by], "pack_a", F.explode(F.sequence(F.col("pack_a"), F.col("packs_a") - 1)).alias("pack_b"))
    # a pack meets itself in both orders, two packs in one
    pairs = _unfolded(cells, packs, packs, by).where("x < y or (pack_a < pack_b and x <> y)")
    return pairs.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))
