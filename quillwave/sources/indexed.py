"""Tables in a few large files sorted by key, with an index of each file's keys, for exports of very many jobs, stems or chunks.

The number of files follows the amount of data, not the number of keys; a key of any size is cut into several files. A reader of
some keys opens the files whose key range can hold them, no others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: The index's folder below the table's; Spark passes over names that begin so when it reads the table as a whole.
INDEX = "_index"


def write_indexed(rows: DataFrame, path: str, keys: list[str], order: list[str] = (), files: int | None = None, rows_per_file: int = 0) -> None:
    """`rows` as Parquet dealt by ranges of `keys` and `order`, sorted within files, and the index (file, rows, low, high).

    `order` cuts keys that are larger than a file. `files`: how many ranges; by default as many as the shuffle has after small
    ones were put together. `rows_per_file` cuts larger ranges, 0 never. Null keys come first; an empty table has an empty index.
    """
    by = [*keys, *order]
    dealt = rows.repartitionByRange(files, *by) if files else rows.repartitionByRange(*by)
    dealt.sortWithinPartitions(*by).write.option("maxRecordsPerFile", rows_per_file).parquet(path)
    of = rows.sparkSession.read.schema(rows.schema).parquet(path).select(F.struct(*keys).alias("key"), F.col("_metadata.file_path").alias("file"))
    ranges = of.groupBy("file").agg(F.count(F.lit(1)).alias("rows"), F.min("key").alias("low"), F.max("key").alias("high"))
    ranges.repartitionByRange(1, "low").sortWithinPartitions("low").write.parquet(f"{path.rstrip('/')}/{INDEX}")


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """(file, rows, low, high): a row per file; low and high are structs of the keys."""
    return spark.read.parquet(f"{path.rstrip('/')}/{INDEX}")


def files_between(spark: SparkSession, path: str, low: dict | None = None, high: dict | None = None) -> list[str]:
    """The files that can hold keys from `low` to `high`, both included; each names the first keys, or some of them, in order."""
    index = read_index(spark, path)
    kinds = index.schema["low"].dataType
    if low:
        index = index.filter(_parts("high", low) >= _values(kinds, low))
    if high:
        index = index.filter(_parts("low", high) <= _values(kinds, high))
    return [r.file for r in index.select("file").collect()]


def read_between(spark: SparkSession, path: str, low: dict | None = None, high: dict | None = None) -> DataFrame:
    """The rows with keys from `low` to `high`, both included (`None`: no bound). What the driver holds is names of those files."""
    found = files_between(spark, path, low, high)
    rows = spark.read.parquet(*found) if found else spark.read.parquet(path).limit(0)
    for bound, inside in ((low, Column.__ge__), (high, Column.__le__)):
        if bound:
            rows = rows.filter(inside(F.struct(*bound), _values(rows.schema, bound)))
            first = next(iter(bound))  # the first key alone reaches the scan's own statistics
            rows = rows.filter(inside(F.col(first), F.lit(bound[first]))) if bound[first] is not None else rows
    return rows


def read_key(spark: SparkSession, path: str, **key) -> DataFrame:
    """The rows of one key, or of all that begin with the keys given; a value None finds null keys."""
    return read_between(spark, path, key, key)


def _parts(side: str, names: dict) -> Column:
    return F.struct(*[F.col(f"{side}.{n}") for n in names])


def _values(schema: StructType, values: dict) -> Column:
    """The values as a struct with the types of the table's keys."""
    kinds = {f.name: f.dataType for f in schema}
    return F.struct(*[F.lit(v).cast(kinds[n]).alias(n) for n, v in values.items()])


def write_stem_table(stems: DataFrame, path: str, files: int | None = None) -> None:
    """stems(job_id, stem, pos, value) by job and stem; read by `read_key(spark, path, job_id=..., stem=...)`."""
    write_indexed(stems, path, ["job_id", "stem"], ["pos"], files)


def write_chunk_table(signal: DataFrame, path: str, rate_hz: int, seconds: int = 20, files: int | None = None) -> None:
    """A signal by series and chunk of `seconds`; read by `read_key(spark, path, series_id=..., chunk_id=...)`."""
    write_indexed(signal.withColumn("chunk_id", F.floor(F.col("pos") / (seconds * rate_hz))), path, ["series_id", "chunk_id"], ["pos"], files)
