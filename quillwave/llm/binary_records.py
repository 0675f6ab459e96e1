"""Token ids as length-delimited binary records, with a separate offset index for shuffled reads.

A record file is a row of frames. All numbers are little-endian:

    length of payload, u64 | masked CRC-32 of those 8 bytes, u32 | payload | masked CRC-32 of the payload, u32 | 0x0A

    payload: flags u8 (1: has an id, 2: ids are u32, else u16) | document id i64 | token ids

A checksum c is masked as ((c >> 15 | c << 17) + 0xA282EAD8) mod 2^32, so that a checksum of data that holds checksums
stays useful. Spark's text writer puts frames one behind the other (the closing byte is its line separator), so files are
written and committed by Spark on whatever store the path names. Files follow one another by their part and file numbers;
their records are in ascending doc_id order.
"""

from __future__ import annotations

import itertools
import json
import re
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import broadcast_if_small, slices, written

MASK = 0xA282EAD8
#: A file has at most so many bytes, or one record where that is longer, so that one task reads a file whole. The text
#: writer gets a file's frames as one row.
FILE_BYTES = 8_000_000
#: Text encoded at once in a task, and units whose ids a Python worker remembers.
BATCH_BYTES, KNOWN_WORDS = 2_000_000, 150_000
#: Units that a worker keeps from one task to the next.
KEPT_WORDS = 40_000

INDEX = "part long, file_no long, record long, doc_id long, path string, position long, bytes long, local_start long, n_tokens long, ids_crc32 long"


def masked(data: bytes) -> int:
    c = zlib.crc32(data)
    return ((c >> 15 | c << 17) + MASK) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    """A frame without its closing 0x0A."""
    length = struct.pack("<Q", len(payload))
    return length + struct.pack("<I", masked(length)) + payload + struct.pack("<I", masked(payload))


def frames(data: bytes) -> Iterator[tuple[int, bytes]]:
    """(position, payload) of every frame of a file; ValueError if a length, checksum or closing byte is wrong."""
    at = 0
    while at < len(data):
        length, check = struct.unpack_from("<QI", data, at)
        if masked(data[at : at + 8]) != check or at + length + 17 > len(data):
            raise ValueError(f"damaged length at {at}")
        payload = data[at + 12 : at + 12 + length]
        if masked(payload) != struct.unpack_from("<I", data, at + 12 + length)[0] or data[at + 16 + length] != 10:
            raise ValueError(f"damaged record at {at}")
        yield at, payload
        at += length + 17


def pack(doc_id: int | None, ids: np.ndarray, wide: bool) -> bytes:
    return struct.pack("<Bq", (doc_id is not None) | wide << 1, doc_id or 0) + ids.astype("<u4" if wide else "<u2").tobytes()


def unpack(payload: bytes) -> tuple[int | None, np.ndarray]:
    flags, doc_id = struct.unpack_from("<Bq", payload)
    return doc_id if flags & 1 else None, np.frombuffer(payload, "<u4" if flags & 2 else "<u2", offset=9).astype("<u4")


#: The split rule of tokenizers whose pieces are found in numpy (fixed value), and the mark of a piece's last token.
PIECES, LAST = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+", "</w>"
SPACE, LETTER, DIGIT, SIGN, OTHER = range(5)


def _kinds() -> np.ndarray:
    """Kind of each byte; the letters U+00C0 to U+017F are two bytes of kind LETTER, all that needs a closer look is OTHER."""
    kinds = np.full(256, OTHER, np.uint8)
    kinds[[9, 10, 11, 12, 13, 32]] = SPACE
    for b in range(33, 127):
        kinds[b] = LETTER if chr(b).isalpha() else DIGIT if chr(b).isdigit() else OTHER if b == ord("'") else SIGN
    kinds[0x80:0xC0] = kinds[[0xC3, 0xC4, 0xC5]] = LETTER
    return kinds


KINDS, LOWER = _kinds(), np.array([ord(chr(b).lower()) if b < 128 else b for b in range(256)], np.uint8)
PIECE = re.compile(rb"(?:[a-z]|[\xc3-\xc5][\x80-\xbf])+|[0-9]|[!-&(-/:-@\[-`{-~]+")


class WordIds(dict):
    """unit -> number; ids of unit n are flat[starts[n]:starts[n] + lengths[n]]. Number 0 stands for the end of a document.

    A unit is a word between ASCII white space. With the split rule PIECES, words of ASCII and Latin letters, digits and
    signs are cut further as that rule cuts them, so that "end" and "end," are learned once; other words stay whole.
    """

    def __init__(self, tokenizer, end_id: int) -> None:
        self.tokenizer, self.end_id = tokenizer, end_id
        split = ((json.loads(tokenizer.to_str()).get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
        self.fine = split.get("pattern") == {"Regex": PIECES}
        size = tokenizer.get_vocab_size()
        self.last = np.fromiter(((tokenizer.id_to_token(i) or "").endswith(LAST) for i in range(size)), bool, size) if self.fine else None
        self.reset()

    def reset(self) -> None:
        self.clear()
        self[None] = 0
        self.new: list[bytes] = []
        self.flat, self.starts, self.lengths = np.array([self.end_id], np.uint32), np.zeros(1, np.int64), np.ones(1, np.int64)
        self.uses = np.zeros(1, np.int64)

    def forget(self, most: int) -> None:
        """Keeps the units met more than once, the `most` used at most; counts age, so that others can take their place."""
        known, uses = list(self), self.uses
        order = np.argsort(-uses[1:], kind="stable")[:most] + 1
        kept = np.sort(order[uses[order] > 1])
        lengths, ages = self.lengths[kept], uses[kept] // 2
        flat = self.flat[spread(self.starts[kept], lengths)]
        self.reset()
        for i in kept.tolist():
            self[known[i]] = len(self)
        self.starts = np.concatenate([self.starts, 1 + np.cumsum(lengths) - lengths])
        self.lengths, self.flat, self.uses = np.concatenate([self.lengths, lengths]), np.concatenate([self.flat, flat]), np.concatenate([self.uses, ages])

    def __missing__(self, unit: bytes) -> int:
        self.new.append(unit)
        self[unit] = n = len(self)
        return n

    def learn(self) -> None:
        """Encodes the new units: pieces many in one text, as each of them ends with a token marked LAST; others one by one."""
        starts, lengths, parts = np.zeros(len(self.new), np.int64), np.zeros(len(self.new), np.int64), [self.flat]
        end = len(self.flat)
        apart = np.fromiter((not self.fine or not PIECE.fullmatch(u) for u in self.new), bool, len(self.new))
        for some in np.array_split(np.flatnonzero(~apart), -(-int((~apart).sum()) // 2_000) or 1):
            text = b" ".join(self.new[i] for i in some.tolist()).decode()
            ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
            stops = np.flatnonzero(self.last[ids]) + 1 if self.fine else ids
            if len(stops) != len(some) or len(some) and stops[-1] != len(ids):
                apart[some] = True
            elif len(some):
                starts[some], lengths[some] = end + np.r_[0, stops[:-1]], np.diff(np.r_[0, stops])
                parts.append(ids)
                end += len(ids)
        rest = np.flatnonzero(apart)
        for some in np.array_split(rest, -(-len(rest) // 2_000) or 1):
            found = [e.ids for e in self.tokenizer.encode_batch_fast([self.new[i].decode("utf-8", "replace") for i in some.tolist()], add_special_tokens=False)]
            n = np.fromiter(map(len, found), np.int64, len(found))
            starts[some], lengths[some] = end + np.cumsum(n) - n, n
            parts.append(np.fromiter(itertools.chain.from_iterable(found), np.uint32))
            end += len(parts[-1])
        self.starts, self.lengths = np.concatenate([self.starts, starts]), np.concatenate([self.lengths, lengths])
        self.flat = np.concatenate(parts)
        self.uses = np.concatenate([self.uses, np.zeros(len(starts), np.int64)])
        self.new = []

    def units(self, texts: list[bytes]) -> tuple[pa.DictionaryArray, np.ndarray]:
        """The units of all texts, dictionary-encoded, and the number of units of each text."""
        x = np.frombuffer(b"\n" + b"\n".join(texts) + b"\n", np.uint8)
        kind = KINDS[x]
        space = kind == SPACE
        if self.fine:
            bad = kind == OTHER
            after = np.r_[x[1:], np.uint8(10)]
            # capital I with a dot becomes two signs in lower case; two signs stand among the letters; special tokens begin <|
            bad |= ((x == 0xC4) & (after == 0xB0)) | ((x == 0xC3) & ((after == 0x97) | (after == 0xB7))) | ((x == 0x3C) & (after == 0x7C))
            if bad.any():
                edge = np.flatnonzero(space[1:] != space[:-1]) + 1
                first, stop = edge[0::2], edge[1::2]
                many = np.cumsum(bad, dtype=np.int32)
                whole = many[stop - 1] > many[first - 1]
                inside = np.zeros(len(x) + 1, np.int8)
                inside[first[whole]] += 1
                inside[stop[whole]] -= 1
                inside = np.cumsum(inside[:-1], dtype=np.int8) > 0
                kind[inside] = OTHER
                x = np.where(inside, x, LOWER[x])
            else:
                x = LOWER[x]
        else:
            kind[~space] = OTHER
        begin = np.flatnonzero((kind[1:] != SPACE) & ((kind[1:] != kind[:-1]) | (kind[1:] == DIGIT))) + 1
        offsets = np.r_[begin - np.cumsum(space, dtype=np.int32)[begin], len(x) - int(space.sum())].astype(np.int32)
        found = pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(offsets), pa.py_buffer(x[~space])]).dictionary_encode()
        return found, np.diff(np.searchsorted(begin, np.cumsum([1, *(len(t) + 1 for t in texts)])))

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """Ids of each text, the end included."""
        if len(self) > KNOWN_WORDS:
            self.forget(KNOWN_WORDS // 2)
        found, counts = self.units(texts)
        known = np.fromiter(map(self.__getitem__, found.dictionary.to_pylist()), np.int64, len(found.dictionary))
        if self.new:
            self.learn()
        numbers = np.insert(known[found.indices.to_numpy()], np.cumsum(counts), 0)
        self.uses += np.bincount(numbers, minlength=len(self.uses))
        lengths = self.lengths[numbers]
        stops = np.cumsum(lengths)
        return np.split(self.flat[spread(self.starts[numbers], lengths)], stops[np.cumsum(counts + 1) - 1][:-1]) if texts else []


def spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """All of range(start, start + count), one after the other."""
    stops = np.cumsum(counts)
    return np.repeat(starts - stops + counts, counts) + np.arange(stops[-1] if len(stops) else 0)


_loaded: dict[tuple, object] = {}


def word_ids(path: str, end_id: int) -> WordIds:
    """The tokenizer of this Python worker; kept between tasks."""
    if (path, end_id) not in _loaded:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _loaded[path, end_id] = WordIds(Tokenizer.from_file(path), end_id)
    return _loaded[path, end_id]


def encode_texts(texts: Iterable[bytes], path: str, end_id: int, words_apart: bool) -> Iterator[np.ndarray]:
    """Ids of each whole text and `end_id`. words_apart: ASCII white space always ends a token and leaves no trace in ids.

    Then each distinct word is encoded once. Long texts go in pieces cut at white space.
    """
    known = word_ids(path, end_id)
    if not words_apart:
        for t in texts:
            ids = known.tokenizer.encode(t.decode("utf-8", "replace"), add_special_tokens=False).ids
            yield np.array([*ids, end_id], np.uint32)
        return
    group: list[bytes] = []
    size = 0
    for t in itertools.chain(texts, (None,)):
        if t is None or size + len(t) > BATCH_BYTES:
            yield from known.encode(group)
            group, size = [], 0
        if t is not None and len(t) > BATCH_BYTES:
            parts = [known.encode([p])[0] for p in slices(t, BATCH_BYTES)]
            yield np.concatenate([*(p[:-1] for p in parts), parts[-1][-1:]])
        elif t is not None:
            group.append(t)
            size += len(t)


def write_records(docs: DataFrame, path: str, tokenizer_path: str, end_id: int, words_apart: bool = False, wide: bool = False) -> None:
    """Frames of docs(doc_id, text) below `path`, in ascending doc_id order, null ids first; a null text has no tokens but the end.

    Equal ids follow one another by a hash of their texts; repeated rows are kept. Other columns are not read, whatever their
    names. An empty table writes no record. Texts of any length are encoded whole. Ids above 65,535 need `wide`.
    """

    def to_frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = lambda: pa.RecordBatch.from_arrays([pa.array([b"\n".join(out)], pa.binary())], ["frames"])
        out: list[bytes] = []
        held = 0
        for b in batches:
            texts = (t.as_py() or b"" for t in b.column(1).cast(pa.binary()))
            for doc_id, ids in zip(b.column(0).to_pylist(), encode_texts(texts, tokenizer_path, end_id, words_apart), strict=True):
                if not wide and len(ids) and ids.max() > 0xFFFF:
                    raise ValueError("ids above 65,535: write with wide=True")
                one = frame(pack(doc_id, ids, wide))
                if out and held + len(one) >= FILE_BYTES:
                    yield row()
                    out, held = [], 0
                out.append(one)
                held += len(one) + 1
        if out:
            yield row()
        known = word_ids(tokenizer_path, end_id)
        if len(known) > KEPT_WORDS:
            known.forget(KEPT_WORDS)

    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("h"), F.monotonically_increasing_id().alias("n"))
    rows = rows.repartitionByRange("doc_id", "h", "n").sortWithinPartitions("doc_id", "h", "n").select("doc_id", "text")
    rows = rows.mapInArrow(to_frames, "frames binary").select(F.col("frames").cast("string").alias("value"))
    rows.write.option("lineSep", "\n").option("maxRecordsPerFile", 1).text(path)


def record_files(spark: SparkSession, path: str) -> DataFrame:
    """(part, file_no, path, content), one row per file."""
    files = spark.read.format("binaryFile").load(path)
    number = lambda pattern: F.regexp_extract("path", pattern, 1).cast("long")
    return files.select(number(r"/part-(\d+)-[^/]*$").alias("part"), number(r"-c(\d+)[^/]*$").alias("file_no"), "path", "content")


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in INDEX.split(", ")]
    kinds = [pa.string() if n == "path" else pa.int64() for n in names]
    for b in batches:
        for part, file_no, path, content in zip(*(b.column(i) for i in range(4)), strict=True):
            rows, start = [], 0
            for n, (at, payload) in enumerate(frames(content.as_py())):
                doc_id, ids = unpack(payload)
                rows.append((part.as_py(), file_no.as_py(), n, doc_id, path.as_py(), at, len(payload) + 17, start, len(ids), zlib.crc32(ids.tobytes())))
                start += len(ids)
            columns = list(zip(*rows, strict=True)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def write_index(spark: SparkSession, path: str, index_path: str) -> DataFrame:
    """Reads the files below `path` back, checks them, and writes where each record lies, with the running number of its first id."""
    local = written(record_files(spark, path).mapInArrow(_index, INDEX))
    totals = local.groupBy("part", "file_no").agg(F.sum("n_tokens").alias("tokens"))  # a row per file
    before = Window.orderBy("part", "file_no").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("part", "file_no", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("base"))
    whole = local.join(broadcast_if_small(written(bases)), ["part", "file_no"])
    whole = whole.withColumn("start", F.col("base") + F.col("local_start")).drop("base", "local_start")
    whole.write.parquet(index_path)
    return spark.read.schema(whole.schema).parquet(index_path)


def read_records(spark: SparkSession, path: str, index: DataFrame | None = None) -> DataFrame:
    """(doc_id, ids) of all records, in no order; or, with a part of the offset index, of its records only, in its `order`.

    With an index only the files it names are read, each once and whole, and only its records are decoded, by position and
    length; the rows come sorted by the index's column `order` (as from epoch_slice), with that column. An empty index gives
    no rows.
    """
    schema = pa.list_(pa.int32())

    def everything(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(0):
                got = [unpack(p) for _, p in frames(content.as_py())]
                yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in got], pa.int64()), pa.array([x.astype(np.int32) for _, x in got], schema)], ["doc_id", "ids"])

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content, wanted in zip(b.column(0), b.column(1), strict=True):
                content, wanted = memoryview(content.as_buffer()), wanted.as_py()
                got = [unpack(p) for x in wanted for _, p in frames(bytes(content[x["position"] : x["position"] + x["bytes"]]))]
                yield pa.RecordBatch.from_arrays([pa.array([x["order"] for x in wanted], pa.int64()), pa.array([d for d, _ in got], pa.int64()), pa.array([x.astype(np.int32) for _, x in got], schema)], ["order", "doc_id", "ids"])

    if index is None:
        return record_files(spark, path).select("content").mapInArrow(everything, "doc_id long, ids array<int>")
    wanted = written(index.select("path", "position", "bytes", "order"))
    named = [r[0] for r in wanted.select("path").distinct().collect()]  # the files of one slice
    if not named:
        return wanted.select("order", F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("array<int>").alias("ids"))
    files = spark.read.format("binaryFile").load(named).select("path", "content")
    per_file = wanted.groupBy("path").agg(F.collect_list(F.struct("position", "bytes", "order")).alias("wanted"))  # a file's records at most
    return files.join(per_file, "path").select("content", "wanted").mapInArrow(take, "order long, doc_id long, ids array<int>").sort("order")


def epoch_slice(index: DataFrame, seed: int, number: int, of: int) -> DataFrame:
    """Slice `number` of `of` of an epoch of `seed`: rows of the index in the order to read them.

    A slice is made of whole files, dealt anew with each seed, so that all slices together read every file once; within the
    slice all records are shuffled, across its files.
    """
    mine = F.pmod(F.xxhash64(F.lit(seed), "path"), F.lit(of)) == number
    return index.filter(mine).withColumn("order", F.xxhash64(F.lit(seed + 1), "path", "position")).sort("order")
