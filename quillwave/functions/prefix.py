"""Running sums in two levels, for keys whose rows are numbered with gaps or not at all: a key of any size is many tasks.

Rows are dealt by ranges of (key, order) whose bounds Spark takes from a sample, so a large key is cut into several blocks. A
block's rows are summed where they are; what comes before a block is a sum over the key's earlier blocks, a row each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import written


def sum_before(rows: DataFrame, by: str, order: str, value: str, name: str, blocks: int | None = None) -> DataFrame:
    """rows with the column `name`: sum of `value` over the rows of the same `by` that come earlier by `order`; 0 for the first.

    Nulls of `value` add nothing; null keys are one key, null orders come first. Rows of one key with equal `order` follow each
    other in no set order. The sum of whole numbers is exact. `blocks`: how many ranges, by default as many as a shuffle has.
    """
    block, inside, past, of, at = (_free(rows, n) for n in ("block", "inside", "past", "of", "at"))
    ranges = [F.col(by), F.col(order)]
    dealt = rows.repartitionByRange(blocks, *ranges) if blocks else rows.repartitionByRange(*ranges)
    dealt = written(dealt.withColumn(block, F.spark_partition_id()))
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    sums = dealt.groupBy(F.col(by).alias(of), F.col(block).alias(at)).agg(F.sum(value).alias(past))
    sums = sums.withColumn(past, F.sum(past).over(earlier(Window.partitionBy(of).orderBy(at))))  # a row per block of a key
    own = dealt.withColumn(inside, F.sum(value).over(earlier(Window.partitionBy(by, block).orderBy(order))))
    joined = own.join(sums, F.col(by).eqNullSafe(F.col(of)) & (F.col(block) == F.col(at)))
    return joined.select(*rows.columns, (F.coalesce(past, F.lit(0)) + F.coalesce(inside, F.lit(0))).alias(name))


def _free(rows: DataFrame, name: str) -> str:
    """A column name that `rows` does not have."""
    taken = {c.lower() for c in rows.columns}
    while name in taken:
        name += "_"
    return name
