"""Connected components of a distributed edge list."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import cut_lineage


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(v, component) for every vertex of edges (a, b): component is the smallest vertex that links reach.

    Alternates large-star and small-star: each round hangs the larger neighbours of every vertex, then the smaller ones,
    under the smallest, until no edge changes. The minima combine before the shuffle, so that a hub costs no more than its
    edges. Each round is cut by a reliable checkpoint. Loops name a vertex without a link; null ends are left out.
    """
    edges = edges.select("a", "b").where("a is not null and b is not null")
    vertices = edges.select(F.col("a").alias("v")).union(edges.select("b")).distinct()
    now = cut_lineage(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    for _ in range(most_rounds):
        now = cut_lineage(_small_star(_large_star(now)))
        count, total = now.select(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if (count, total) == before:
            break
        before = (count, total)
    else:
        raise RuntimeError("components did not settle")
    return vertices.join(now.select(F.col("a").alias("v"), F.col("b").alias("parent")), "v", "left") \
        .select("v", F.coalesce("parent", "v").alias("component"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    return edges.join(least, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"),
                                         F.col("m").alias("b")).where("a <> b").distinct()
