"""Shared folder, tables that cut lineage, and the word rule that several operators use."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word rule `[^\x20\x09-\x0D]+`, as a Java pattern.
SPACES = r"[\x20\x09-\x0D]+"
#: Up to so many rows are broadcast; the rows are counted first, and more go through a shuffle join.
BROADCAST_ROWS = 100_000


def shared_dir(spark: SparkSession) -> str:
    """A new path below the folder that the cluster names in spark.checkpoint.dir.

    Where the setting is absent, a session on one machine (master local) sets a temporary folder once; any other is an error,
    as executors would write where the driver cannot read.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        context = spark.sparkContext
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(tempfile.mkdtemp(prefix="quillwave-"))
        base = context.getCheckpointDir()
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """`df` written as a table in the shared folder and read again: lineage ends there, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def word_count(text: Column) -> Column:
    """Number of words `[^\\x20\\x09-\\x0D]+` (null: 0), without building more than the split."""
    t = F.coalesce(text, F.lit(""))
    white = [9, 10, 11, 12, 13, 32]
    first, last = F.ascii(F.substring(t, 1, 1)), F.ascii(F.substring(t, -1, 1))
    edges = F.when(F.length(t) == 0, 1).otherwise(first.isin(white).cast("int") + last.isin(white).cast("int"))
    return (F.size(F.split(t, SPACES, -1)) - edges).cast("long")


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """`df`, a written table, with a broadcast hint if a count shows that it has at most `limit` rows."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def slices(text: bytes, size: int) -> Iterator[bytes]:
    """The text in pieces of about `size` bytes, cut at ASCII white space only; one piece if there is none."""
    at = 0
    while len(text) - at > size:
        cut = re.compile(rb"[\x20\x09-\x0D]").search(text, at + size)
        if not cut:
            break
        yield text[at : cut.end()]
        at = cut.end()
    yield text[at:]
