"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.session import materialize


def connected_components(edges: DataFrame, most_rounds: int = 50) -> DataFrame:
    """(node, component): the least node each node is connected with.

    edges: columns a, b of one ordered type.  Alternates the two star steps of
    MapReduce connected components: every node's larger neighbours are linked
    to its least neighbour, then its smaller ones.  The edge table never grows
    in one step beyond its size, a node of any degree is aggregated by its
    least neighbour (never collected), and each round is written to the shared
    folder.  Edges with a null end, loops and repeated edges are ignored.
    """
    now = materialize(edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "cc")
    for _ in range(most_rounds):
        # large star: for each node, link its larger neighbours to the least of it and its neighbours
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: for each node, link it and its smaller neighbours to the least of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        after = materialize(small, "cc")
        same = after.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v") % 1_000_000_007), F.lit(0))).first() == now.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v") % 1_000_000_007), F.lit(0))).first()
        now = after
        if same:
            break
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(now.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
