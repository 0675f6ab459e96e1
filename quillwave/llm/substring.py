"""Substring dedup with an FM-index per shard.

Shards are made by content: each window of WINDOW words belongs to its minimizer (the smallest hash of STEM words inside), and
the stretch of windows that share one occurrence of a minimizer is a segment. Equal windows have equal minimizers, so all
occurrences of a window are in one shard. Minimizers that occur once can hold no repeat and are left out; equal segments
become one with a count. Each shard builds an FM-index (wavelet matrix over the transform) of its distinct segments, streams
its segments through by backward search, and reports the windows that occur elsewhere. Large shards are dealt in parts, and
each pair of parts is a group: one part is indexed, the other streamed. So a group is no larger than an undealt shard, however
many segments share a minimizer; the work grows with the square of such a minimizer's words, over as many groups.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, written
from .fm_index import FMIndex, repeated_windows

WINDOW, STEM = 35, 6
#: Words of distinct segments that one index holds.
SHARD_WORDS = 300_000
#: Repeated minimizers that may be broadcast (8 bytes each); more go through a shuffle join.
BROADCAST_STEMS = 200_000
BASE = np.uint64(0x9E3779B97F4A7C15)
GROUP_BYTES = 1_000_000


_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE and its inverse modulo 2^64, to the powers 0 to n at least; kept in the worker while short."""
    ahead, back = _powers
    if len(ahead) <= n:
        size = max(n + 1, GROUP_BYTES * 5 // 4)
        ahead = np.cumprod(np.r_[np.uint64(1), np.full(size, BASE)], dtype=np.uint64)
        back = np.cumprod(np.r_[np.uint64(1), np.full(size, np.uint64(pow(int(BASE), -1, 1 << 64)))], dtype=np.uint64)
        if size <= 8 * GROUP_BYTES:
            _powers[:] = ahead, back
    return ahead, back


def spans_hash(values: np.ndarray, first: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Hash of each span of the values, the same wherever it stands: sums of value * BASE ^ place, by differences, then mixed."""
    ahead, back = powers(len(values))
    sums = np.r_[np.uint64(0), np.cumsum(values * ahead[: len(values)], dtype=np.uint64)]
    h = (sums[first + length] - sums[first]) * back[first]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return h * np.uint64(0xFF51AFD7ED558CCD) + length.astype(np.uint64)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word of all texts, number of words of each text), without an object per word."""
    if len(texts) == 1 and len(texts[0]) > 4 * GROUP_BYTES:
        parts = [word_hashes([p])[0] for p in slices(texts[0], GROUP_BYTES)]
        return np.concatenate(parts), np.array([sum(map(len, parts))])
    x = np.frombuffer(b"\n" + b"\n".join(texts) + b"\n", np.uint8)
    space = _SPACE[x]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    first, length = edge[0::2], edge[1::2] - edge[0::2]
    begins = np.cumsum([1, *(len(t) + 1 for t in texts)])
    return spans_hash(x.astype(np.uint64), first, length), np.diff(np.searchsorted(first, begins))


def segments(texts: list[bytes], contents: bool = True) -> tuple[np.ndarray, ...]:
    """(text, minimizer, content hash, first word, words) of each segment of the texts, by text and place.

    Its windows start at its first words - WINDOW + 1 words. All texts are worked on at once; a sliding minimum in doubling
    steps runs over keys of hash and place, so that of equal hashes the first is taken.
    """
    h, counts = word_hashes(texts)
    width = WINDOW - STEM + 1
    n_windows = np.maximum(counts - WINDOW + 1, 0)
    begins = np.cumsum(counts) - counts
    if not n_windows.sum():
        return (np.zeros(0, np.int64),) * 5
    stems = np.zeros(len(h) - STEM + 1, np.uint64)
    for i in range(STEM):
        stems = stems * BASE + h[i : len(stems) + i]
    stems ^= stems >> np.uint64(31)
    stems *= np.uint64(0xD6E8FEB86659FD93)
    stems ^= stems >> np.uint64(29)
    bits = np.uint64(max(1, len(stems)).bit_length())
    least = stems >> bits << bits | np.arange(len(stems), dtype=np.uint64)
    span = 1
    while span * 2 <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if width > span:
        least = np.minimum(least[: len(least) - (width - span)], least[width - span :])
    text = np.repeat(np.arange(len(texts)), n_windows)
    start = np.repeat(begins - np.cumsum(n_windows) + n_windows, n_windows) + np.arange(len(text))
    place = (least[start] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    cut = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]) | (text[1:] != text[:-1])])
    first, length = start[cut], np.diff(np.r_[cut, len(text)]) + WINDOW - 1
    content = spans_hash(h, first, length) if contents else np.zeros(len(cut), np.uint64)
    return text[cut], stems[place[cut]].view(np.int64), content.view(np.int64), first - begins[text[cut]], length


def _groups(column: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    """The texts of an Arrow column in groups of bounded size, each with the number of its first."""
    group: list[bytes] = []
    size = at = 0
    for i, t in enumerate(column.cast(pa.binary())):
        t = t.as_py() or b""
        if group and size + len(t) > GROUP_BYTES:
            yield at, group
            group, size, at = [], 0, i
        group.append(t)
        size += len(t)
    if group:
        yield at, group


def _stem_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[np.ndarray] = []

    def give() -> pa.RecordBatch:
        stems, n = np.unique(np.concatenate(held) if held else np.zeros(0, np.int64), return_counts=True)
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(stems), pa.array(np.minimum(n, 2), pa.int32())], ["stem", "n"])

    for b in batches:
        for _, texts in _groups(b.column(0)):
            held.append(segments(texts, contents=False)[1])
        if sum(map(len, held)) > 2_000_000:
            yield give()
    yield give()


SEGMENT = "doc_id long, h long, stem long, content long, first int, words int"


def _segment_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in SEGMENT.split(", ")]
    for b in batches:
        for at, texts in _groups(b.column(2)):
            text, stem, content, first, words = segments(texts)
            row = pa.array(text + at)
            yield pa.RecordBatch.from_arrays([b.column(0).take(row), b.column(1).take(row), pa.array(stem), pa.array(content), pa.array(first.astype(np.int32)), pa.array(words.astype(np.int32))], names)


def _pack(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    packer = zstandard.ZstdCompressor(3)
    for b in batches:
        yield pa.array([packer.compress(t.as_py() or b"") for t in b.cast(pa.binary())], pa.binary())


_pack.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}


def packed(docs: DataFrame) -> DataFrame:
    """(doc_id, h, z): the texts, compressed for the shuffles that carry them."""
    return docs.select("doc_id", F.xxhash64("text").alias("h"), F.arrow_udf(_pack, "binary")(F.col("text")).alias("z"))


def _contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words of the segments that represent their kind, from the documents they stand in."""
    unpacker = zstandard.ZstdDecompressor()
    for b in batches:
        out: list[tuple] = []
        for z, wanted in zip(b.column(0), b.column(1), strict=True):
            words = unpacker.decompress(z.as_py()).split()
            out += [(s["stem"], s["content"], s["n"], b" ".join(words[s["first"] : s["first"] + s["words"]])) for s in wanted.as_py()]
            if len(out) > 20_000:
                yield _rows(out)
                out = []
        yield _rows(out)


def _rows(out: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*out, strict=True)) or [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.binary())], ["stem", "content", "n", "words"])


FOUND = "stem long, content long, mask long"


def _search(rows: pa.Table) -> pa.Table:
    """Columns stem, content, n, words, own (in this group's index), streamed. Masks of the windows that occur elsewhere."""
    own, streamed, n = (rows.column(name).to_numpy() for name in ("own", "streamed", "n"))
    numbers: dict[bytes, int] = {b"": 0}
    texts = [np.array([numbers.setdefault(w, len(numbers)) for w in t.as_py().split()], np.int64) for t in rows.column("words")]
    lengths = np.array([len(t) for t in texts], np.int64)
    flat = np.concatenate([x for t in texts for x in (t, np.zeros(1, np.int64))])
    starts = np.cumsum(lengths + 1) - lengths - 1
    indexed = np.repeat(own, lengths + 1)
    index = FMIndex(flat[indexed] if not own.all() else flat, 2 * WINDOW)
    stream = np.flatnonzero((n < 2) & streamed)  # equal segments elsewhere: all their windows are repeated
    masks = np.where(n < 2, np.uint64(0), (np.uint64(1) << (lengths - WINDOW + 1).astype(np.uint64)) - np.uint64(1))
    if len(stream):
        # a symbol that the index does not hold ends a match: its range is empty
        known = np.minimum(flat, index.symbols - 1) if int(flat.max()) < index.symbols else flat
        if int(flat.max()) >= index.symbols:
            index.starts = np.r_[index.starts, np.full(int(flat.max()) + 1 - index.symbols, index.starts[-1])]
            index.first = np.r_[index.first, np.zeros(int(flat.max()) + 1 - index.symbols, np.int64)]
        masks[stream] = repeated_windows(index, known, starts[stream], lengths[stream], WINDOW, 1 + own[stream].astype(np.int64))
    keep = np.flatnonzero(masks)
    at = pa.array(keep)
    return pa.Table.from_arrays([rows.column("stem").take(at), rows.column("content").take(at), pa.array(masks[keep].view(np.int64))], ["stem", "content", "mask"])


def repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, h, first, mask): segments with windows that also start elsewhere; bit i: the window at word first + i. h: xxhash64 of the text."""
    source = docs.select("doc_id", F.xxhash64("text").alias("h"), "text")
    stems = docs.select("text").mapInArrow(_stem_counts, "stem long, n int").groupBy("stem").agg(F.sum("n").alias("n")).filter("n > 1").select(F.col("stem").alias("again"))
    stems = written(stems)
    few = stems.limit(BROADCAST_STEMS + 1).count() <= BROADCAST_STEMS
    rows = source.mapInArrow(_segment_rows, SEGMENT)
    rows = written(rows.join(F.broadcast(stems) if few else stems, F.col("stem") == F.col("again"), "left_semi"))
    kinds = rows.groupBy("stem", "content").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "h", "first", "words")).alias("at"))
    kinds = written(kinds.select("stem", "content", "n", "at.*"))
    wanted = kinds.groupBy("doc_id", "h").agg(F.collect_list(F.struct("stem", "content", "n", "first", "words")).alias("wanted"))
    of = wanted.select(F.col("doc_id").alias("d"), F.col("h").alias("g"), "wanted")
    texts = packed(docs).join(of, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("h") == F.col("g")))
    contents = texts.select("z", "wanted").mapInArrow(_contents, "stem long, content long, n long, words binary")
    # shards by minimizer; a repeated row gives its segments again, so they are taken once
    total = kinds.agg(F.coalesce(F.sum("words"), F.lit(0))).first()[0]
    shards = max(1, -(-total // SHARD_WORDS))
    shard = F.pmod(F.xxhash64("stem"), F.lit(shards))
    sizes = written(kinds.groupBy(shard.alias("shard")).agg(F.sum("words").alias("w")).filter(F.col("w") > 2 * SHARD_WORDS).select("shard", F.ceil(F.col("w") / SHARD_WORDS).cast("int").alias("parts")))
    dealt = contents.withColumn("shard", shard)
    if sizes.limit(1).count():
        dealt = dealt.join(sizes, "shard", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
        # a segment of part m is indexed in the groups (m, any) and streamed in (any, m)
        mine, every = F.pmod(F.xxhash64("content"), F.col("parts")), F.sequence(F.lit(0), F.col("parts") - 1)
        dealt = dealt.withColumn("mine", mine.cast("int"))
        indexed = F.transform(every, lambda i: F.struct(F.col("mine").alias("part"), i.alias("slice")))
        streams = F.transform(F.filter(every, lambda i: i != F.col("mine")), lambda i: F.struct(i.alias("part"), F.col("mine").alias("slice")))
        dealt = dealt.withColumn("group", F.explode(F.concat(indexed, streams))).select("stem", "content", "n", "words", "shard", "mine", "group.*")
        dealt = dealt.withColumn("own", F.col("part") == F.col("mine")).withColumn("streamed", F.col("slice") == F.col("mine"))
    else:
        dealt = dealt.withColumns({"part": F.lit(0), "slice": F.lit(0), "own": F.lit(True), "streamed": F.lit(True)})

    def one(table: pa.Table) -> pa.Table:
        pair = np.stack([table.column("stem").to_numpy(), table.column("content").to_numpy()], 1)
        first = np.sort(np.unique(pair, axis=0, return_index=True)[1])
        return _search(table.take(pa.array(first)))

    found = dealt.groupBy("shard", "part", "slice").applyInArrow(one, FOUND).groupBy("stem", "content").agg(F.bit_or("mask").alias("mask"))
    found = written(found.select(F.col("stem").alias("s"), F.col("content").alias("c"), "mask"))
    return rows.join(found, (F.col("stem") == F.col("s")) & (F.col("content") == F.col("c"))).select("doc_id", "h", "first", "mask")


def covered(n_words: int, first: np.ndarray, masks: np.ndarray) -> np.ndarray:
    """Which words a repeated window covers: bit i of a mask is the window at word first + i."""
    edge = np.zeros(n_words + 1, np.int64)
    row, bit = np.nonzero(np.unpackbits(masks.astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
    starts = first[row] + bit
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + WINDOW, -1)
    return np.cumsum(edge[:-1]) > 0


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    unpacker = zstandard.ZstdDecompressor()
    for b in batches:
        hits = b.column(2)
        bounds, rows = hits.offsets.to_numpy() - hits.offsets[0].as_py(), hits.flatten()
        first, masks = rows.field("first").to_numpy().astype(np.int64), rows.field("mask").to_numpy()
        there = hits.is_valid().to_numpy(zero_copy_only=False)
        out: list[tuple] = []
        size = begun = 0
        for i, z in enumerate(b.column(1)):
            words = unpacker.decompress(z.as_py()).split()
            n, lo, hi = len(words), bounds[i], bounds[i + 1]
            if there[i] and hi > lo:
                words = list(itertools.compress(words, (~covered(n, first[lo:hi], masks[lo:hi])).tolist()))
            out.append((n, n - len(words), b" ".join(words)))
            size += len(out[-1][2])
            if size > 8_000_000 or i == b.num_rows - 1:
                columns = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(begun, len(out)), pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.binary())], ["doc_id", "n_words", "n_removed", "kept"])
                out, size, begun = [], 0, i + 1


def remove(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept (the other words joined by one space, UTF-8 binary).

    Null texts have no words; documents of fewer than WINDOW words keep them all. Repeated documents lose all that windows
    cover, as each repeats the other. Null ids and equal ids are kept apart by a hash of the text. Texts of any length are
    worked on whole; an empty table gives no rows; other columns are not read.
    """
    hits = repeats(docs).distinct().groupBy("doc_id", "h").agg(F.collect_list(F.struct("first", "mask")).alias("hits"))
    of = hits.select(F.col("doc_id").alias("d"), F.col("h").alias("g"), "hits")
    rows = packed(docs).join(of, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("h") == F.col("g")), "left")
    return rows.select("doc_id", "z", "hits").mapInArrow(_cut, "doc_id long, n_words long, n_removed long, kept binary")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256."""
    return remove(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
