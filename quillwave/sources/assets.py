"""Assets and scripts as sources, blocks of samples, chunked and stem-wise sinks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.prefix import sum_before

# Fixed values.
EXTENSIONS = ["wav", "mp3", "flac", "ogg", "m4a", "aiff", "aif"]
CHUNK_SEC, BYTES_PER_FRAME, FULL_SCALE, EMPTY_ROWS = 20, 4, 32768.0, 48_000


def scan_scripts(spark: SparkSession, path: str) -> DataFrame:
    """scripts(path, text): one file, one row, whole."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def name_parts(path: Column) -> tuple[Column, Column]:
    """(stem, lower-case extension) of the last part of a path or address, without query and fragment."""
    name = F.regexp_extract(path, r"([^/?#]*)(?:[?#].*)?$", 1)
    return F.regexp_replace(name, r"\.[^.]*$", ""), F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1))


def scan_assets(paths: DataFrame, extensions: list[str] = EXTENSIONS, path: str = "path") -> DataFrame:
    """Listed paths with an accepted extension: path, stem, ext, by name."""
    stem, ext = name_parts(F.col(path))
    return paths.select(F.col(path).alias("path"), stem.alias("stem"), ext.alias("ext")).filter(F.col("ext").isin(extensions)).orderBy("stem", "path")


def list_assets(spark: SparkSession, folder: str, extensions: list[str] = EXTENSIONS) -> DataFrame:
    """The files of a folder by `scan_assets`, with their size; an absent folder gives no rows. Contents are not read."""
    try:
        files = spark.read.format("binaryFile").option("pathGlobFilter", "*.*").load(folder).select("path", F.col("length").alias("bytes"))
    except AnalysisException:
        files = spark.createDataFrame([], "path string, bytes long")
    return scan_assets(files, extensions).join(files, "path")


def skip_bad_assets(assets: DataFrame, content: str, valid: Column) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected): a row whose content is null or not `valid` goes to the second table, the scan goes on."""
    ok = F.coalesce(F.col(content).isNotNull() & valid, F.lit(False))
    return assets.filter(ok), assets.filter(~ok)


def config_overlay(scanned: DataFrame, config: DataFrame, existing: DataFrame) -> DataFrame:
    """(narrator, phase, audio_path, transcript): config rows override or add to scanned ones, if their audio_path exists."""
    layers = scanned.withColumn("layer", F.lit(0)).unionByName(config.join(existing.select("audio_path"), "audio_path", "left_semi").withColumn("layer", F.lit(1)))
    top = Window.partitionBy("narrator", "phase").orderBy(F.col("layer").desc(), "audio_path", "transcript")
    return layers.withColumn("n", F.row_number().over(top)).filter("n = 1").drop("n", "layer")


def pcm_block_ingest(blocks: DataFrame) -> DataFrame:
    """blocks(block_id, pcm BINARY), interleaved little-endian 16-bit stereo, to (block_id, pos, value): the mean of both channels.

    A sample without a partner at the end is dropped; an empty block is a second of zeros.
    """

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, pcm in zip(b.column(0), b.column(1), strict=True):
                data = pcm.as_py() or b""
                x = np.frombuffer(data[: len(data) // BYTES_PER_FRAME * BYTES_PER_FRAME], "<i2").reshape(-1, 2).mean(1) / FULL_SCALE if data else np.zeros(EMPTY_ROWS)
                for at in range(0, len(x), 500_000):
                    part = x[at : at + 500_000]
                    yield pa.RecordBatch.from_arrays([pa.array([block.as_py()] * len(part), pa.int64()), pa.array(np.arange(at, at + len(part))), pa.array(part)], ["block_id", "pos", "value"])

    return blocks.select("block_id", "pcm").mapInArrow(decode, "block_id long, pos long, value double")


def byte_budget_cutoff(blocks: DataFrame, target_bytes: Column | int) -> DataFrame:
    """blocks(session, seq, bytes) in order until the target is reached; `kept` bytes of the last one end on a whole frame.

    A session may hold any share of the rows.
    """
    target = F.lit(target_bytes) if isinstance(target_bytes, int) else target_bytes
    aligned = target - target % BYTES_PER_FRAME
    rows = sum_before(blocks, "session", "seq", "bytes", "before").filter(F.col("before") < target)
    return rows.withColumn("kept", F.greatest(F.least("bytes", aligned - F.col("before")), F.lit(0))).drop("before")


def write_chunks(signal: DataFrame, path: str, rate_hz: int, seconds: int = CHUNK_SEC) -> None:
    """Parquet by chunk of `seconds`, rows in order within a chunk."""
    rows = signal.withColumn("chunk_id", F.floor(F.col("pos") / (seconds * rate_hz)))
    rows.repartitionByRange("series_id", "chunk_id").sortWithinPartitions("series_id", "chunk_id", "pos").write.partitionBy("chunk_id").parquet(path)


def write_stems(stems: DataFrame, path: str) -> None:
    """stems(job_id, stem, pos, value): one folder per job and stem."""
    stems.repartition("job_id", "stem").sortWithinPartitions("job_id", "stem", "pos").write.partitionBy("job_id", "stem").parquet(path)
