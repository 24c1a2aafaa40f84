"""Parent/child hierarchies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .registry import add


def flatten(df: DataFrame, child: str, parent: str, depth: int = 20) -> DataFrame:
    """child, level_depth, levels (array from the root down to the child) of every child and every parent that is no child.

    Roots, parents that aren't children themselves or children without parent, have depth 0. The paths grow by one join a level;
    joins go on until no path grows. A child with two parents, or a chain deeper than `depth` (a cycle), raises an error.
    """
    edges = df.select(F.col(child).alias("c"), F.col(parent).alias("p")).distinct()
    if edges.filter("c IS NOT NULL").groupBy("c").count().filter("count > 1").limit(1).count():
        raise ValueError("a child has more than one parent")
    up = edges.filter("c IS NOT NULL AND p IS NOT NULL")
    nodes = edges.select("c").union(edges.select("p")).filter("c IS NOT NULL").distinct()
    front = nodes.join(up.select("c"), "c", "left_anti").select("c", F.array("c").alias("levels"))
    done = front
    for _ in range(depth):
        front = up.join(front.withColumnRenamed("c", "p"), "p").select("c", F.concat("levels", F.array("c")).alias("levels")).checkpoint() if df.sparkSession.sparkContext.getCheckpointDir() else up.join(
            front.withColumnRenamed("c", "p"), "p"
        ).select("c", F.concat("levels", F.array("c")).alias("levels"))
        if not front.limit(1).count():
            break
        done = done.union(front)
    else:
        raise ValueError(f"deeper than {depth} levels, or a cycle")
    return done.select(F.col("c").alias(child), (F.size("levels") - 1).alias("level_depth"), "levels")


add("hierarchy", "estimator", FlattenParentChild=flatten)
