"""Connected components of a graph kept in tables: alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanloom.session import materialise


def components(links: DataFrame, most_rounds: int = 40) -> DataFrame:
    """node and root (the least node of its component) of every node in `links` (columns a, b).

    Each round is written to the shared folder, so a lost executor repeats one round at most. Nothing but two
    numbers per round reaches the driver. A star whose centre is in many links is one key of a join, which
    adaptive execution splits; the minimum per node combines on the map side.
    """
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("child"), F.least("a", "b").alias("parent")).distinct()
    edges = materialise(edges)
    mark = _mark(edges)
    for _ in range(most_rounds):
        edges = materialise(_small_star(_large_star(edges)))
        now = _mark(edges)
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.col("parent").alias("node"), F.col("parent").alias("root")).distinct()
    return edges.select(F.col("child").alias("node"), F.col("parent").alias("root")).unionByName(roots)


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("child", "parent") % 2**40)).first())


def _large_star(edges: DataFrame) -> DataFrame:
    """Larger neighbours of a node move to the least node around it."""
    both = edges.select(F.col("child").alias("node"), F.col("parent").alias("next")).unionByName(
        edges.select(F.col("parent").alias("node"), F.col("child").alias("next")))
    least = both.groupBy("node").agg(F.min("next").alias("least")).select(
        "node", F.least("node", "least").alias("least"))
    return both.where("next > node").join(least, "node").select(
        F.col("next").alias("child"), F.col("least").alias("parent")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours move to the least of them."""
    least = edges.groupBy("child").agg(F.min("parent").alias("least"))
    moved = edges.join(least, "child").select(F.col("parent").alias("child"), F.col("least").alias("parent"))
    return moved.where("child <> parent").unionByName(
        least.select("child", F.col("least").alias("parent"))).distinct()
