"""Connected components by alternating large-star and small-star steps (joins and minima only).

No neighbour list is gathered: a node's least neighbour is an aggregate with map-side combine, and its edges are
rewired by a join, which Spark splits where a hub holds many edges. Every round is written to the checkpoint folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palinode.llm.scratch import stored


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v")))


def _stars(edges: DataFrame) -> bool:
    """Whether no node has two smaller neighbours, or a smaller and a larger one: then each has its component's least id."""
    ends = edges.select(F.col("u").alias("id"), F.lit(1).alias("below"), F.lit(0).alias("above")).union(
        edges.select("v", F.lit(0), F.lit(1)))
    ends = ends.groupBy("id").agg(F.sum("below").alias("below"), F.max("above").alias("above"))
    return not ends.where("below > 1 or below = 1 and above = 1").agg(F.count("*")).first()[0]


def components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(id, component): every node of the edges with the smallest id it can reach. Loops, repeated edges and
    both directions are fine; without edges the result is empty. Edges may be nodes with the component found before: what
    is new alone then takes rounds."""
    now = stored(edges.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).where("u <> v").distinct(), "edges")
    while not _stars(now):
        # repeated edges in between make no more rows than there are edges
        now = stored(_small_star(_large_star(now).where("u <> v")).where("u <> v").distinct(), "stars")
    roots = now.select(F.col("v").alias("id")).distinct().select("id", F.col("id").alias("component"))
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).union(roots)
