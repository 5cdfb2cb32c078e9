"""Recursive CTEs with duplicate elimination, and in the order of a queue."""

import tempfile
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which driver and executors share; a folder of our own only in local mode."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        own = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if not own and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(own or tempfile.mkdtemp(prefix="sparkwright-"))
    return sc.getCheckpointDir()


def _cut(df: DataFrame) -> DataFrame:
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def recursive_union(start: DataFrame, step: Callable[[DataFrame], DataFrame], most: int = 10_000) -> DataFrame:
    """UNION recursion: each round's new rows are the frontier's steps that were never seen. Each round writes its new rows only."""
    rounds = [_cut(start.distinct())]
    for _ in range(most):
        new = step(rounds[-1]).toDF(*rounds[0].columns)
        seen = reduce(DataFrame.unionAll, rounds)
        same = [seen[c].eqNullSafe(F.col(f"n.{c}")) for c in seen.columns]
        frontier = _cut(new.distinct().alias("n").join(seen, same, "left_anti"))
        if frontier.isEmpty():
            return seen
        rounds.append(frontier)
        if len(rounds) > 64:  # so that plans stay small
            rounds = [_cut(reduce(DataFrame.unionAll, rounds[:-1])), frontier]
    raise RuntimeError(f"no end of the recursion after {most} rounds")


def walk(edges: DataFrame, roots: DataFrame, depth_first: bool, most: int = 10_000) -> DataFrame:
    """Trees from roots (id) along edges (parent, child): id, depth, place in queue order, children by id.

    ORDER BY depth gives breadth first, ORDER BY depth DESC depth first; the order is that of the paths' sort keys.
    """
    level = roots.select("id", F.lit(0).alias("depth"), F.array(F.col("id")).alias("path"))
    levels = [level := _cut(level)]
    for _ in range(most):
        level = _cut(edges.join(level, edges["parent"] == level["id"]).select(F.col("child").alias("id"), (F.col("depth") + 1).alias("depth"), F.concat("path", F.array("child")).alias("path")))
        if level.isEmpty():
            return reduce(DataFrame.unionAll, levels).orderBy("path" if depth_first else "depth", "path")
        levels.append(level)
    raise RuntimeError(f"no end of the recursion after {most} rounds")
