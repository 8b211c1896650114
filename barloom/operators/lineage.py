"""Everything that a thing descends from, by pointer doubling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import cut


def ancestors(edges: DataFrame, child: str = "child", parent: str = "parent") -> DataFrame:
    """(child, parent, depth) for every way of ``depth`` steps along the edges; repeated edges count once, null ends are no edges.

    Each round joins what lies k steps away with all that lies up to k steps from there, so a chain of n links takes
    log2(n) rounds of one equi-join each. A cycle ends the job.
    """
    near = cut(edges.select(F.col(child).alias("child"), F.col(parent).alias("parent")).where("child is not null and parent is not null").distinct().withColumn("depth", F.lit(1).cast("long")))
    reach = 1
    while True:
        if not near.where("child = parent").isEmpty():
            raise ValueError("a cycle in the lineage")
        far = near.where(F.col("depth") == reach).select(F.col("child").alias("c"), F.col("parent").alias("mid"))
        more = near.select(F.col("child").alias("m"), "parent", "depth")
        new = cut(far.join(more, F.col("mid") == F.col("m")).select(F.col("c").alias("child"), "parent", (F.col("depth") + reach).alias("depth")).distinct())
        if new.isEmpty():
            return near
        near, reach = cut(near.unionByName(new)), 2 * reach
