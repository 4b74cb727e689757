"""Connected components of a graph that is never held in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bookloom.operators.common import settle

#: Edges per written file of a round, about.
ROWS_PER_FILE = 200_000


def _least(edges: DataFrame) -> DataFrame:
    """Each node's smallest neighbour or itself; combined before the shuffle."""
    return edges.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    out = both.join(_least(both), "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.filter(F.col("u") != F.col("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter(F.col("u") != F.col("v"))
    least = _least(down)
    out = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.filter(F.col("u") != F.col("v")).distinct()


def _unfinished(edges: DataFrame) -> bool:
    """Whether some node has two neighbours below it, or one below and one above: without
    such a node every component is a star around its least node."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("below")).union(
        edges.select(F.col("v").alias("node"), F.lit(0).alias("below")))
    seen = ends.groupBy("node").agg(F.sum("below").alias("below"), F.bool_or(F.col("below") == 0).alias("above"))
    return not seen.filter((F.col("below") > 1) | ((F.col("below") == 1) & F.col("above"))).isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (u, v): the smallest node reachable.

    Alternating large and small stars, each result written and read again, until every
    component is a star.  Loops and repeated edges do no harm.
    """
    now = settle(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter(
        F.col("u") != F.col("v")).distinct(), "edges")
    # A round makes no more edges than there were nodes and edges: few rows, few files.
    files = 1 + now.count() // ROWS_PER_FILE
    while _unfinished(now):
        now = settle(_small_star(_large_star(now)).coalesce(files), "edges")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v").distinct())
