"""Mixing sources to target weights with hash-threshold histograms: DataFrame functions only.

A document's key is 36 bits of a hash, so a source's documents have a fixed order that no sort makes. Words are summed by
source and the key's first 12 bits; the bucket in which a source's budget ends is the only one that is summed again by
the next 12 bits, then by the last 12. What lies below the threshold found is taken. A larger budget takes all that a
smaller one takes (nested thresholds), and a rerun takes the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast_if_small, word_count, written

#: Weights by the sources' order, repeating.
WEIGHTS = (5, 2, 1)
#: No source, and no document, is taken more often than this.
MOST = 3
BITS = 12


def mix_key(doc_id: Column, text: Column) -> Column:
    """36 bits of the MD5 of the id and the text as a LONG: equal rows have equal keys."""
    said = F.concat(F.coalesce(doc_id.cast("string"), F.lit("-")), F.lit(":"), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(said.cast("binary")), 1, 9), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """(source, source_size) to (source, source_size, target): shares of the total by weight, no target above `most` times its size.

    Sorted by the share at which a source is full, the full ones are a prefix; its end is where the level of the others
    fits. One row per source goes through the two ordered windows, never a row per document.
    """
    ordinal = Window.orderBy(F.col("source").asc_nulls_last())
    kinds = F.array(*[F.lit(float(w)) for w in weights])
    rows = sizes.withColumn("weight", F.element_at(kinds, (F.row_number().over(ordinal) - 1) % len(weights) + 1))
    rows = rows.withColumn("full", F.col("source_size") * F.lit(float(most))).withColumn("level", F.col("full") / F.col("weight"))
    by_level = Window.orderBy("level", F.col("source").asc_nulls_last())
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    after = by_level.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy(F.lit(1))
    rows = (
        rows.withColumn("place", F.row_number().over(by_level))
        .withColumn("rest", F.sum("source_size").over(everything) - F.coalesce(F.sum("full").over(before), F.lit(0.0)))
        .withColumn("fits", F.col("rest") / F.sum("weight").over(after))
    )
    at = F.min(F.when(F.col("fits") <= F.col("level"), F.struct("place", "fits"))).over(everything)
    return rows.select("source", "source_size", F.least("full", at["fits"] * F.col("weight")).alias("target"))


def plan_mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: float = MOST) -> tuple[DataFrame, DataFrame]:
    """The sized documents (doc_id, source, size, key), a written table, and the plan per source.

    The plan has (source, source_size, target, whole, threshold): each document is taken `whole` times, and once more if
    its key is below `threshold`. Sources may hold any share of the rows: histograms have at most 4,096 rows per source.
    """
    sized = written(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), mix_key(F.col("doc_id"), F.col("text")).alias("key")))
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan = source_targets(sizes, weights, most)
    whole = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size") + F.lit(1e-12)), F.lit(int(most)))).otherwise(F.lit(0))
    plan = plan.withColumn("whole", whole.cast("long")).withColumn("need", F.greatest(F.col("target") - F.col("whole") * F.col("source_size"), F.lit(0.0)))
    plan = written(plan)
    # (source, prefix of the key so far, words still needed): the boundary bucket of each source
    at = plan.select(F.col("source").alias("of"), F.lit(0).cast("long").alias("prefix"), F.col("need"))
    for level in (2, 1, 0):
        at = broadcast_if_small(at)
        here = sized.join(at, F.col("source").eqNullSafe(F.col("of")) & (F.shiftright("key", BITS * (level + 1)) == F.col("prefix")))
        buckets = here.groupBy("of", F.shiftright("key", BITS * level).alias("prefix")).agg(F.sum("size").alias("words"), F.first("need").alias("need"))
        running = Window.partitionBy("of").orderBy("prefix").rowsBetween(Window.unboundedPreceding, 0)
        buckets = buckets.withColumn("up_to", F.sum("words").over(running))
        ends = buckets.filter(F.col("up_to") > F.col("need"))
        ends = ends.groupBy("of").agg(F.min(F.struct("prefix", "words", "up_to", "need")).alias("b"))
        at = written(ends.select("of", F.col("b.prefix").alias("prefix"), (F.col("b.need") - F.col("b.up_to") + F.col("b.words")).alias("need"), F.col("b.words").alias("words")))
    # the last bucket holds one document (or equal rows): in if that comes nearer to the target
    last = at.select("of", (F.col("prefix") + (F.col("need") * 2 > F.col("words")).cast("long")).alias("threshold"))
    plan = plan.join(last, F.col("source").eqNullSafe(F.col("of")), "left")
    return sized, written(plan.select("source", "source_size", "target", "whole", F.coalesce("threshold", F.lit(0).cast("long")).alias("threshold")))


def times_taken(key: Column, whole: Column, threshold: Column) -> Column:
    return whole + (key < threshold).cast("long")


def mix_report(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken (words, repeats counted).

    Null texts have size 0 and take nothing; a null source is a source of its own, last in the order. Rows with equal id
    and text share one decision, as they share a key. Empty input gives no rows. Other columns are not read.
    """
    sized, plan = plan_mix(docs, weights, most)
    plan = broadcast_if_small(plan.withColumnRenamed("source", "of"))
    rows = sized.join(plan, F.col("source").eqNullSafe(F.col("of")))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * times_taken(F.col("key"), F.col("whole"), F.col("threshold"))).alias("taken"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """The mixed corpus: the rows of `docs`, all their columns, each as often as the mix takes it.

    Rows of size 0 (null texts) are taken `whole` times and once more below the threshold, like any; a null source is one of
    its own; an empty table gives no rows.
    """
    _, plan = plan_mix(docs, weights, most)
    plan = broadcast_if_small(plan.select(F.col("source").alias("__of"), F.col("whole").alias("__whole"), F.col("threshold").alias("__threshold")))
    times = times_taken(mix_key(docs["doc_id"], docs["text"]), F.col("__whole"), F.col("__threshold")).cast("int")
    rows = docs.join(plan, docs["source"].eqNullSafe(F.col("__of")))
    rows = rows.withColumn("__copy", F.explode(F.array_repeat(F.lit(1), times)))
    return rows.select(*[docs[c] for c in docs.columns])
