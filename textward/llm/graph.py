"""Connected components of a link table, without ever gathering a component in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textward.session import cut_lineage


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def _large_star(edges: DataFrame) -> DataFrame:
    """Each vertex hands the least vertex it knows to its larger neighbours."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    joined = both.join(least, "u").where("v > u")
    return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each vertex hands its least neighbour to itself and its other smaller neighbours."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    joined = edges.join(least, "u").where("v != m")
    onward = joined.select(F.col("v").alias("u"), F.col("m").alias("v"))
    return onward.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """`node`, `root` for each end of a link; root is the least node of its component.

    `links` has two long columns u and v; rows with a null end or equal ends say nothing and are
    left out. Star contraction halves the depth of every tree in each pass, so the number of
    passes grows with the logarithm of the longest chain. Each pass is written to the shared
    folder: a lost executor repeats one pass at most. A hub's edges are spread by the skew join,
    and its minimum is combined before the shuffle.
    """
    edges = cut_lineage(
        links.where("u != v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct()
    )
    state = _state(edges)
    while state[0]:
        edges = cut_lineage(_small_star(_large_star(edges)))
        after = _state(edges)
        if after == state:
            break
        state = after
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
