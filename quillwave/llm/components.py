"""Connected components of a link table, by alternating star steps; each step is written, nothing comes to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, written


def components(links: DataFrame, most_steps: int = 60) -> DataFrame:
    """links(a, b) to (node, root): every node that has a link, and the smallest node it can reach.

    Large star: each node hangs its larger neighbours on its smallest. Small star: each node hangs its smaller neighbours on
    the smallest of them. The number of steps grows as the logarithm of the longest chain. Loops and repeats do no harm;
    no links give no rows; other columns are not read. The minima are written before they are joined: counted small they are
    broadcast, else both sides of the join are bare shuffles, so that a hub with any share of the links can be split.
    """
    edges = written(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    mark = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    for _ in range(most_steps):
        if not mark[0]:
            break
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = written(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("of"), F.least("a", "m").alias("m")))
        large = both.filter("b > a").join(broadcast_if_small(least), F.col("a") == F.col("of")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = written(large.filter("a <> b").distinct())
        lowest = written(large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("of"), "m"))
        small = large.join(broadcast_if_small(lowest), F.col("a") == F.col("of")).select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
        edges = written(small.unionByName(lowest.select(F.col("of").alias("a"), F.col("m").alias("b"))).distinct())
        before, mark = mark, edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(before) == tuple(mark):
            break
    else:
        raise RuntimeError(f"components did not settle in {most_steps} steps")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
