"""Connected components of an edge table, all in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b: long), the root being the smallest node reachable.

    Alternates the large-star and small-star steps, each of which links nodes to
    the smallest neighbour, until nothing changes; each round is written to
    shared storage, so neither lineage nor a lost executor undoes it.
    """
    now = materialise(_down(edges), "edges")
    mark = _mark(now)
    for _ in range(max_rounds):
        # large star: larger neighbours of a node are linked to its smallest neighbour or itself
        both = now.select("a", "b").union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: smaller neighbours of a node and the node are linked to the smallest of them
        low = large.where("a > b")
        least = low.groupBy("a").agg(F.min("b").alias("m"))
        small = low.join(least, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        new = materialise(_down(small.union(least.select("a", F.col("m").alias("b")))), "edges")
        old_mark, mark = mark, _mark(new)
        discard(now)
        now = new
        if mark == old_mark:
            break
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select("b", "b").distinct())


def _down(edges: DataFrame) -> DataFrame:
    return edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct()


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("a"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
