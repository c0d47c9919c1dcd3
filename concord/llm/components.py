"""Connected components of a distributed link table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concord.llm.common import materialise


def _large_star(edges: DataFrame) -> DataFrame:
    """Each vertex sends its larger neighbours to its smallest neighbour."""
    both = edges.select(F.col("v").alias("u"), F.col("root").alias("w")).union(edges.select(F.col("root").alias("u"), F.col("v").alias("w")))
    least = both.groupBy("u").agg(F.least(F.min("w"), F.col("u")).alias("m"))
    return both.filter("w > u").join(least, "u").select(F.col("w").alias("v"), F.col("m").alias("root")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each vertex sends its smaller neighbours and itself to the smallest of them."""
    least = edges.groupBy("v").agg(F.min("root").alias("m"))
    moved = edges.join(least, "v").filter("root <> m").select(F.col("root").alias("v"), F.col("m").alias("root"))
    return moved.union(least.select("v", F.col("m").alias("root"))).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("v", "root").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """(v, root) for every vertex other than the roots, and (root, root): root is the smallest vertex reachable.

    links has two columns of comparable ids. Rounds go on until nothing changes; the links stay
    distributed and each round is written to the shared folder. Links that repeat count once, one
    of a vertex with itself or with a null not at all; without links there are no rows.
    """
    a, b = links.columns
    edges = links.select(F.greatest(a, b).alias("v"), F.least(a, b).alias("root")).filter("v <> root")
    edges = materialise(_small_star(edges.distinct()), "links")
    before = _state(edges)
    while True:
        edges = materialise(_small_star(_large_star(edges)), "links")
        if (now := _state(edges)) == before:
            break
        before = now
    return edges.union(edges.select("root", "root").distinct())
