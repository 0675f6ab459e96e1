"""Exact quantiles per group by refinement: no group is sorted, however many rows it has.

The first histogram has buckets by sign and size, 64 to each doubling, so that numbers of any size are told apart; it is made
with partial aggregates and has as many rows as buckets. The bucket that holds the wanted rank is known by running counts over
a group's buckets, and with it how many rows lie below and what the smallest number above is. While that bucket is large, its
rows alone are counted again, in CELLS buckets of equal width between its own smallest and largest number. A round narrows it
by that factor, so a few rounds reach equal numbers or a bucket that is small; its rows are then ranked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written

CELLS = 4_096
#: Rows of a group's bucket that are ranked without another histogram.
RANKED = 10_000


def _size_bucket(v: Column) -> Column:
    """A whole number that does not fall as v grows."""
    size = F.floor(F.log2(1.0 + F.abs(v) * 2.0**20) * 64)
    return F.when(v < 0, -size).otherwise(size)


def _wanted(histogram: DataFrame, by: str) -> DataFrame:
    """Of (by, rank, bucket, n, lo, hi, above) the bucket that holds the rank, which is then counted from that bucket's start."""
    order = Window.partitionBy(by).orderBy("bucket")  # a row per bucket
    rows = histogram.withColumn("upto", F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("above", F.coalesce(F.lead("lo").over(order), "above"))
    below = F.col("upto") - F.col("n")
    return rows.filter((below <= F.col("rank")) & (F.col("rank") < F.col("upto"))).select(by, "share", (F.col("rank") - below).alias("rank"), "n", "lo", "hi", "above")


def exact_quantile(rows: DataFrame, by: str, value: str, share: float, ranked: int = RANKED) -> DataFrame:
    """(by, value): the quantile of each group, between two rows in proportion.

    Null and NaN values are left out, and groups without others have no row. Equal values may be any share of a group.
    """
    rows = written(rows.select(by, F.col(value).cast("double").alias("v")).filter(F.col("v").isNotNull() & ~F.isnan("v")))
    counts = [F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")]
    first = rows.groupBy(by, _size_bucket(F.col("v")).alias("bucket")).agg(*counts)
    place = (F.sum("n").over(Window.partitionBy(by)) - 1) * share
    first = first.withColumn("rank", F.floor(place)).withColumn("share", place - F.floor(place)).withColumn("above", F.lit(None).cast("double"))
    state = written(_wanted(first, by))
    found = []
    while True:
        large = (F.col("n") > ranked) & (F.col("lo") < F.col("hi"))
        found.append(state.filter(~large))
        state = state.filter(large)
        if not state.limit(1).count():
            break
        inside = rows.join(state.select(F.col(by).alias("of"), "lo", "hi", "rank", "share", "above"), F.col(by).eqNullSafe(F.col("of"))).filter(F.col("v").between(F.col("lo"), F.col("hi")))
        # halves first: the width of two numbers of opposite sign may be beyond what a double holds
        cell = F.floor((F.col("v") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2) * (CELLS - 1))
        again = inside.groupBy(by, cell.alias("bucket")).agg(*counts, *(F.first(c).alias(c) for c in ("rank", "share", "above")))
        state = written(_wanted(again, by))
    ends = found[0]
    for more in found[1:]:
        ends = ends.unionByName(more)
    equal = ends.filter("lo = hi").select(by, "share", F.col("lo").alias("a"), F.when(F.col("rank") + 1 < F.col("n"), F.col("lo")).otherwise(F.col("above")).alias("b"))
    few = ends.filter("lo < hi").withColumnsRenamed({by: "of"})
    inside = rows.join(few, F.col(by).eqNullSafe(F.col("of"))).filter(F.col("v").between(F.col("lo"), F.col("hi")))
    inside = inside.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy("v")) - 1)
    near = inside.filter((F.col("place") == F.col("rank")) | (F.col("place") == F.col("rank") + 1)).groupBy(by, "share", "rank", "above").agg(F.min("v").alias("a"), F.max("v").alias("last"), F.count(F.lit(1)).alias("n"))
    near = near.select(by, "share", "a", F.when(F.col("n") > 1, F.col("last")).otherwise(F.col("above")).alias("b"))
    between = F.when((F.col("share") == 0) | (F.col("a") == F.col("b")), F.col("a")).otherwise(F.col("a") * (1 - F.col("share")) + F.col("b") * F.col("share"))
    return equal.unionByName(near).select(by, between.alias(value))
