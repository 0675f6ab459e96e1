"""Headers of sampled files: Spark lists the files, tasks read the few bytes that tell rate, channels and length.

Files are opened by their address, on whatever file system it names, and their samples are never read: a header's parts are
walked by their own lengths. A file that cannot be read is a row with an `error`, the scan goes on.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from urllib.parse import quote

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import spread

# Fixed values of the formats.
PCM_BITS, EXTENDED_ZERO = 16, 16383 + 63
FIELDS = "path string, bytes long, format string, rate_hz double, channels int, bits int, frames long, seconds double, error string"


class Broken(ValueError):
    """Why a header cannot be used."""


def _extended(ten: bytes) -> float:
    """An 80-bit float, as which one of the formats gives its rate."""
    exponent, mantissa = struct.unpack(">HQ", ten)
    return mantissa * 2.0 ** ((exponent & 0x7FFF) - EXTENDED_ZERO)


def _parts(read, size: int, order: str) -> Iterator[tuple[bytes, int, int]]:
    """(name, place, length) of the parts behind a file's first twelve bytes."""
    at = 12
    while at + 8 <= size:
        name, length = struct.unpack(order + "4sI", read(at, 8))
        yield name, at + 8, length
        at += 8 + length + length % 2


def _riff(read, size: int) -> tuple:
    form = None
    for name, at, length in _parts(read, size, "<"):
        if name == b"fmt ":
            if length < 16 or at + 16 > size:
                raise Broken("truncated")
            form = struct.unpack("<HHIIHH", read(at, 16))
        elif name == b"data":
            if form is None:
                raise Broken("no format")
            _, channels, rate, _, frame, bits = form
            if not (channels and rate and frame):
                raise Broken("bad format")
            if at + length > size:
                raise Broken("truncated")
            return "wav", float(rate), channels, bits, length // frame
    raise Broken("no samples" if form else "no format")


def _aiff(read, size: int) -> tuple:
    for name, at, length in _parts(read, size, ">"):
        if name == b"COMM":
            if length < 18 or at + 18 > size:
                raise Broken("truncated")
            channels, frames, bits = struct.unpack(">HIH", read(at, 8))
            rate = _extended(read(at + 8, 10))
            if not (channels and rate > 0):
                raise Broken("bad format")
            return "aiff", rate, channels, bits, frames
    raise Broken("no format")


def _flac(read, size: int) -> tuple:
    if size < 42:
        raise Broken("truncated")
    if read(4, 1)[0] & 0x7F:
        raise Broken("no format")
    word = int.from_bytes(read(18, 8), "big")  # rate 20 bits, channels 3, bits 5, frames 36
    rate = word >> 44
    if not rate:
        raise Broken("bad format")
    return "flac", float(rate), (word >> 41 & 7) + 1, (word >> 36 & 31) + 1, word & (1 << 36) - 1


def header(read, size: int) -> tuple:
    """(format, rate_hz, channels, bits, frames) of a file of `size` bytes; read(at, n) gives bytes. Broken if there is none."""
    start = read(0, min(size, 12))
    if start[:4] == b"RIFF" and start[8:] == b"WAVE":
        return _riff(read, size)
    if start[:4] == b"FORM" and start[8:] in (b"AIFF", b"AIFC"):
        return _aiff(read, size)
    if start[:4] == b"fLaC":
        return _flac(read, size)
    raise Broken("unknown format" if size else "empty")


def _located(path: str):
    """(file system, path on it) of an address as Spark writes it, that is with nothing in it encoded."""
    from pyarrow import fs

    if path.startswith("/") or path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(quote(path, safe=":/@"))


def _row(path: str, size: int) -> tuple:
    try:
        system, place = _located(path)
        with system.open_input_file(place) as f:
            kind, rate, channels, bits, frames = header(lambda at, n: f.read_at(n, at), size)
        return kind, rate, channels, bits, frames, frames / rate, None
    except Broken as e:
        return (None,) * 6 + (str(e),)
    except OSError:
        return (None,) * 6 + ("unreadable",)


def scan_media(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """FIELDS of each file of a folder and the folders in it; an absent folder gives no rows.

    `error` is null or tells what is wrong: empty, unknown format, no format, bad format, no samples, truncated, unreadable. The
    other columns are null then, but for path and bytes. A FLAC file whose length is left open has 0 frames.
    """
    try:
        listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder).select("path", F.col("length").alias("bytes"))
    except AnalysisException:
        listed = spark.createDataFrame([], "path string, bytes long")
    names = [f.split()[0] for f in FIELDS.split(", ")]
    kinds = [pa.string(), pa.int64(), pa.string(), pa.float64(), pa.int32(), pa.int32(), pa.int64(), pa.float64(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [_row(p, n) for p, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            columns = [b.column(0), b.column(1), *zip(*found, strict=True)] if found else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return spread(listed).mapInArrow(run, FIELDS)


def split_media(media: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(usable files, broken files with their error)."""
    return media.filter("error IS NULL").drop("error"), media.filter("error IS NOT NULL").select("path", "bytes", "error")


def wave_files(signal: DataFrame, rate_hz: int, rows: int) -> DataFrame:
    """signal to (series_id, part, content): a 16-bit WAVE file for each `rows` positions, channels in their order.

    Values are held within [-1, 1]; a null or missing value is a zero. A file is one task's array of `rows` times channels.
    """
    kind = signal.schema["series_id"].dataType.simpleString()

    def make(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        channels, at = np.unique(part["channel"].to_numpy(), return_inverse=True)
        place = part["pos"].to_numpy() - int(key[1]) * rows
        x = np.zeros((place.max() + 1, len(channels)))
        x[place, at] = np.nan_to_num(part["value"].to_numpy(dtype=float))
        data = np.rint(np.clip(x, -1, 1) * 32767).astype("<i2").tobytes()
        frame = 2 * len(channels)
        head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(data), b"WAVE", b"fmt ", 16, 1, len(channels), rate_hz, rate_hz * frame, frame, PCM_BITS, b"data", len(data))
        return pd.DataFrame({"series_id": pd.Series([key[0]], dtype="object"), "part": [int(key[1])], "content": [head + data]})

    parts = signal.select("series_id", "channel", "pos", "value", F.floor(F.col("pos") / rows).alias("part"))
    return parts.groupBy("series_id", "part").applyInPandas(make, f"series_id {kind}, part long, content binary")


def write_files(files: DataFrame, name: Column, content: Column, folder: str) -> int:
    """Each row's bytes as the file folder/name; the number of files. A task that is run again writes the same files again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _located(folder)
        system.create_dir(root, recursive=True)
        for b in batches:
            for n, c in zip(b.column(0), b.column(1), strict=True):
                with system.open_output_stream(f"{root}/{n.as_py()}") as f:
                    f.write(c.as_py() or b"")
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], ["n"])

    return files.select(name.alias("name"), content.alias("content")).mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
