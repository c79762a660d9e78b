"""Connected components of links too many for one machine: large and small stars in turn."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doubtline.session import materialize

MOST_ROUNDS = 60


def _both(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the least of its neighbours and itself."""
    around = _both(edges)
    least = around.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return around.join(least, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours are tied to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    tied = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return tied.unionByName(least.withColumnRenamed("m", "v")).filter("u <> v")


def connected_components(edges: DataFrame) -> DataFrame:
    """``u long, root long`` for every node of ``edges`` (``u long, v long``): the least node that it can reach.

    Links may repeat, point either way or join a node to itself; nulls aren't links. Each round is written to the shared
    folder, which cuts the lineage. A node of many links is folded by a partial aggregate, and its join is split by
    adaptive execution. Rounds grow with the logarithm of the longest chain.
    """
    edges = edges.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v")).filter("u <> v").distinct()
    edges = materialize(edges, "links")
    state = None
    for _ in range(MOST_ROUNDS):
        edges = materialize(_small_star(_large_star(edges)).distinct(), "links")
        row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(row) == state:
            return edges.select("u", F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("u"), F.col("v").alias("root")).distinct())
        state = tuple(row)
    raise RuntimeError(f"components did not settle in {MOST_ROUNDS} rounds")
