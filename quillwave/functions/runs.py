"""Runs of neighbouring positions, found in blocks and merged level by level: no window goes over a whole series.

In a block, runs are found by a window over its rows alone. A run that stays away from its block's edges is done. What lies
near an edge may go on in the next block: those few are the rows of the next level, whose blocks are BLOCK times as large. A
block has two open runs at most, so each level has a small share of the rows of the one before, and three levels reach
10^12 positions. Merging is associative, so any block size gives the same runs.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import written

BLOCK = 10_000


def merged_runs(rows: DataFrame, by: str, at: str, gap: int = 0, block: int = BLOCK) -> DataFrame:
    """(by, a, b): first and last position of each run; up to `gap` missing positions do not end a run.

    rows(by, at): the positions that belong to runs, in any order; one may be there more than once. An empty table has none.
    """
    if gap >= block:
        block = gap + 1
    most = rows.agg(F.max(at)).first()[0]
    runs = rows.select(by, F.col(at).alias("a"), F.col(at).alias("b"))
    done, size = [], block
    while True:
        top = most is None or most < size
        home = F.floor(F.col("a") / size)
        order = Window.partitionBy(by, "home").orderBy("a", "b")
        fresh = F.col("a") > F.max("b").over(order.rowsBetween(Window.unboundedPreceding, -1)) + 1 + gap
        runs = runs.withColumn("home", home).withColumn("run", F.sum(F.coalesce(fresh, F.lit(False)).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
        runs = runs.groupBy(by, "home", "run").agg(F.min("a").alias("a"), F.max("b").alias("b"))
        if top:
            return reduce(DataFrame.unionByName, done, runs.select(by, "a", "b"))
        runs = written(runs)
        begin = F.col("home") * size
        open_ = (F.col("a") <= begin + gap) | (F.col("b") >= begin + (size - 1 - gap))
        done.append(runs.filter(~open_).select(by, "a", "b"))
        runs = runs.filter(open_).select(by, "a", "b")
        size *= block
