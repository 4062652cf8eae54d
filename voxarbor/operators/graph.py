"""Connected components and breadth-first levels on edge lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxarbor.functions.storage import materialise, release


def _star(edges: DataFrame, small: bool) -> DataFrame:
    if small:
        around = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    else:
        around = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = around.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    joined = around.join(low, "u")
    if small:
        out = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        out = out.unionByName(low.select("u", F.col("m").alias("v")))
    else:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.where("u <> v").distinct()


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, comp) for every row of nodes(id): comp is the smallest id reachable over
    edges(src, dst), found by alternating large-star and small-star rounds."""
    now = materialise(edges.where("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct())
    state = None
    while True:
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == state:
            break
        state = seen
        before, now = now, materialise(_star(_star(now, small=False), small=True))
        release(before)
    return nodes.join(now.select(F.col("u").alias("id"), F.col("v").alias("comp")), "id", "left").select("id", F.coalesce("comp", "id").alias("comp"))


def levels(start: DataFrame, edges: DataFrame, limit: int | None = None) -> DataFrame:
    """(id, level): hops from the nearest of start(id) over directed edges(src, dst).  Each
    round expands the frontier only and drops what has a level."""
    done = materialise(start.select("id").distinct().withColumn("level", F.lit(0)))
    frontier, level = done, 0
    while limit is None or level < limit:
        level += 1
        reached = frontier.join(edges, F.col("id") == F.col("src")).select(F.col("dst").alias("id")).distinct()
        frontier = materialise(reached.join(done.select("id"), "id", "left_anti").withColumn("level", F.lit(level)))
        if frontier.isEmpty():
            break
        done = done.unionByName(frontier)
        if level % 8 == 0:
            done = materialise(done)
    return done
