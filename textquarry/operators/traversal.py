"""Neighbours and breadth-first search over edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textquarry.operators.graph_store import Direction
from textquarry.plans.rounds import cut, drop


def steps(edges: DataFrame, direction: Direction = Direction.BOTH, relation: str | None = None) -> DataFrame:
    """(src, dst, weight) of each step that the direction allows."""
    some = edges if relation is None else edges.filter(F.col("relation") == relation)
    out = some.select(F.col("source").alias("src"), F.col("target").alias("dst"), "weight")
    back = some.select(F.col("target").alias("src"), F.col("source").alias("dst"), "weight")
    return {Direction.OUT: out, Direction.IN: back}.get(direction) if direction != Direction.BOTH else out.unionByName(back)


def neighbors(edges: DataFrame, seeds: DataFrame, direction: Direction = Direction.BOTH, relation: str | None = None) -> DataFrame:
    """(id, weight): nodes a step from the seeds, which are left out; weights add up; heaviest first."""
    seeds = seeds.select(F.col(seeds.columns[0]).alias("id")).distinct()
    near = steps(edges, direction, relation).join(seeds.withColumnRenamed("id", "src"), "src", "left_semi")
    return near.groupBy(F.col("dst").alias("id")).agg(F.sum("weight").alias("weight")).join(seeds, "id", "left_anti").orderBy(F.desc("weight"), "id")


def related(edges: DataFrame, start: str, depth: int, direction: Direction = Direction.BOTH, relation: str | None = None) -> DataFrame:
    """(id, depth): nodes within `depth` steps of `start`, which is left out. Each round joins the last round's nodes alone."""
    spark = edges.sparkSession
    move = steps(edges, direction, relation).select("src", "dst").distinct()
    seen = frontier = spark.createDataFrame([(start, 0)], "id string, depth int")
    for d in range(1, depth + 1):
        found = frontier.select(F.col("id").alias("src")).join(move, "src").select(F.col("dst").alias("id")).distinct().join(seen, "id", "left_anti")
        last, frontier = frontier, cut(found.withColumn("depth", F.lit(d)), "frontier")
        drop(last)
        if not frontier.head(1):
            break
        last, seen = seen, cut(seen.unionByName(frontier), "seen")
        drop(last)
    return seen.filter(F.col("depth") > 0)


def related_nodes(edges: DataFrame, start: str, depth: int, most: int = 500) -> DataFrame:
    """The undirected form with its cap (a feature of it): one step is always taken, even for depth 0."""
    return related(edges, start, max(depth, 1)).orderBy("depth", "id").limit(most)
