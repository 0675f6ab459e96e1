"""SimHash near-duplicates by anchor-point covering.

Fingerprints are cut into blocks with thresholds that add up so that two fingerprints within DISTANCE are within the
threshold in at least one block. The anchors of a block are the words of a covering code: a Hamming code on the block's
first 2^r - 1 bits, every value of the other bits; no block value is farther than 1 from an anchor. A fingerprint has its
home at the nearest anchor and goes to every anchor within covering radius plus threshold, so at the home of either of two
linked fingerprints the other one is found. Per anchor, homes are compared with all that came; a spanning forest of the
links goes out, never all pairs. Equal fingerprints are one node throughout.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, slices, written
from .components import components

BITS, DISTANCE, SHINGLE, SEED = 64, 4, 4, 42
#: (bits, threshold) of the blocks; each set's sum of threshold + 1 is DISTANCE + 1. The first for up to WIDE distinct fingerprints.
BLOCKS = ((24, 1), (24, 1), (16, 0))
WIDE_BLOCKS = ((32, 2), (32, 1))
WIDE = 1 << 28
#: Homes of one anchor that a task holds; more are dealt over several tasks.
HOMES = 4_096
PAIRS_AT_ONCE = 2_000_000
PIECE_BYTES = 500_000


def _set_bits(words: list[bytes]) -> np.ndarray:
    """How many shingles of the words set each bit."""
    joined, hashed = b" ".join(words), xxhash.xxh64_intdigest
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    stops = np.cumsum(lengths + 1) - 1
    starts, stops = (stops - lengths)[: len(words) - SHINGLE + 1].tolist(), stops[SHINGLE - 1 :].tolist()
    h = np.fromiter((hashed(joined[a:b], SEED) for a, b in zip(starts, stops, strict=True)), np.uint64, len(starts))
    return np.unpackbits(h.view(np.uint8), bitorder="little").reshape(-1, BITS).sum(0, dtype=np.int64)


def fingerprint(text: bytes | None) -> int:
    """Signed 64-bit fingerprint of the words `[^\\x20\\x09-\\x0D]+`, A-Z lower-cased; no words: 0. Long texts go in pieces."""
    carried: list[bytes] = []
    n, bits = 0, np.zeros(BITS, np.int64)
    for piece in slices((text or b"").lower(), PIECE_BYTES):
        carried += piece.split()
        if len(carried) >= SHINGLE:
            n += len(carried) - SHINGLE + 1
            bits += _set_bits(carried)
            carried = carried[1 - SHINGLE :]
    if n:
        return int(np.packbits(bits * 2 > n, bitorder="little").view(np.int64)[0])
    return int(np.uint64(xxhash.xxh64_intdigest(b" ".join(carried), SEED)).astype(np.int64)) if carried else 0


def _fingerprints(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for b in batches:
        yield pa.array([fingerprint(t.as_py()) for t in b.cast(pa.binary())], pa.int64())


_fingerprints.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}


@cache
def cover(bits: int, threshold: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """(masks whose parities are the syndrome, by syndrome the differences to all anchors within radius + threshold, nearest first).

    Threshold 0: every value is its own anchor.
    """
    if threshold == 0:
        return [], [np.zeros(1, np.uint64)]
    r = (bits + 1).bit_length() - 1
    column = [i + 1 if i < (1 << r) - 1 else 0 for i in range(bits)]
    masks = [np.uint64(sum(1 << i for i in range(bits) if column[i] >> j & 1)) for j in range(r)]
    out: list[list[int]] = [[] for _ in range(1 << r)]
    for weight in range(threshold + 2):
        for places in combinations(range(bits), weight):
            s = 0
            for i in places:
                s ^= column[i]
            out[s].append(sum(1 << i for i in places))
    return masks, [np.array(x, np.uint64) for x in out]


def anchors(fps: np.ndarray, blocks=BLOCKS, homes_only: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, fingerprint, home) of every anchor that the fingerprints go to; the key holds the block's number and the anchor."""
    keys, values, homes = [], [], []
    shift = 0
    for number, (bits, threshold) in enumerate(blocks):
        x = fps.view(np.uint64) >> np.uint64(shift) & np.uint64((1 << bits) - 1)
        shift += bits
        masks, patterns = cover(bits, threshold)
        syndrome = np.zeros(len(x), np.int64)
        for j, m in enumerate(masks):
            syndrome |= (np.bitwise_count(x & m) & 1).astype(np.int64) << j
        for s, p in enumerate(patterns):
            own = np.flatnonzero(syndrome == s)
            p = p[:1] if homes_only else p
            keys.append((x[own][:, None] ^ p[None]).ravel() | np.uint64(number << 56))
            values.append(np.repeat(fps[own], len(p)))
            homes.append(np.tile(np.arange(len(p)) == 0, len(own)))
    return np.concatenate(keys).view(np.int64), np.concatenate(values), np.concatenate(homes)


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links to stars with the same components: each node but the smallest of its component, and that smallest."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    up = np.arange(len(nodes))
    while True:
        p, q = up[x], up[y]
        open_ = p != q
        if not open_.any():
            break
        x, y = x[open_], y[open_]
        np.minimum.at(up, np.maximum(p, q)[open_], np.minimum(p, q)[open_])
        while (up[up] != up).any():
            up = up[up]
    below = np.flatnonzero(up != np.arange(len(nodes)))
    return nodes[below], nodes[up[below]]


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, fp, home) sorted by key, homes first: links within DISTANCE as stars, per batch."""
    last_key, last_homes = None, np.zeros(0, np.int64)
    for b in batches:
        key, fp, home = b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_numpy(zero_copy_only=False)
        if not len(key):
            continue
        carried = len(last_homes) if last_key == key[0] else 0
        homes = np.concatenate([last_homes[:carried], fp[home]])
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        group = np.cumsum(np.r_[True, key[1:] != key[:-1]]) - 1
        n_homes = np.add.reduceat(home.astype(np.int64), first)
        n_homes[0] += carried
        start = np.cumsum(n_homes) - n_homes
        counts = n_homes[group]
        ends = np.cumsum(counts)
        links: list[tuple[np.ndarray, np.ndarray]] = []
        at = 0
        while at < len(key):  # a bounded number of pairs at a time
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS_AT_ONCE, "right")))
            c = counts[at:to]
            left = np.repeat(fp[at:to], c)
            stop = np.cumsum(c)
            right = homes[np.repeat(start[group[at:to]] - stop + c, c) + np.arange(stop[-1])]
            near = (np.bitwise_count(left.view(np.uint64) ^ right.view(np.uint64)) <= DISTANCE) & (left != right)
            if near.any():
                links.append(forest(left[near], right[near]))
            at = to
        last_key, last_homes = key[-1], homes[start[-1] :]
        x, y = forest(*map(np.concatenate, zip(*links, strict=True))) if links else (np.zeros(0, np.int64),) * 2
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], ["a", "b"])


def links(fps: DataFrame, blocks=BLOCKS, homes: int = HOMES) -> DataFrame:
    """fps(fp), distinct, a written table: links(a, b) that connect all fingerprints within DISTANCE."""

    def spread(homes_only: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x = b.column(0).to_numpy()
                for at in range(0, len(x), 2_000):
                    yield pa.RecordBatch.from_arrays(list(map(pa.array, anchors(x[at : at + 2_000], blocks, homes_only))), ["key", "fp", "home"])

        return fps.select("fp").mapInArrow(run, "key long, fp long, home boolean")

    crowded = written(spread(True).groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > homes))
    rows = spread(False)
    if crowded.limit(1).count():  # homes dealt over tasks, all others sent to each of them
        dealt = crowded.select(F.col("key").alias("of"), F.ceil(F.col("n") / homes).cast("int").alias("parts"))
        rows = rows.join(broadcast_if_small(dealt), F.col("key") == F.col("of"), "left")
        own = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
        rows = rows.withColumn("part", F.explode(F.when(F.col("parts").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("parts") - 1))))
        rows = rows.withColumn("home", F.col("home") & (F.col("parts").isNull() | (F.col("part") == own)))
        rows = rows.select(F.xxhash64("key", "part").alias("key"), "fp", "home", F.col("key").alias("anchor"), "part")
        rows = rows.repartition("anchor", "part").sortWithinPartitions("anchor", "part", F.col("home").desc()).select("key", "fp", "home")
    else:
        rows = rows.repartition("key").sortWithinPartitions("key", F.col("home").desc())
    return rows.mapInArrow(_compare, "a long, b long")


def label(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, fp, root (smallest fingerprint reachable), component_id (smallest doc_id reachable).

    Null texts have the fingerprint 0, as have texts without words, and link like any other. Null ids are passed over in
    component_id, which is null only where all ids of a component are. Repeated rows are one node. Texts of any length count
    whole; an empty table gives no rows; other columns are not read. A group of copies of any size is one fingerprint; what
    is joined to a large group's rows is written first, so it is broadcast when counted small, else AQE splits the group.
    """
    udf = F.arrow_udf(_fingerprints, "long")
    rows = written(docs.select("doc_id", udf(F.col("text")).alias("fp")))
    nodes = written(rows.groupBy("fp").agg(F.min("doc_id").alias("first")))
    wide = nodes.count() > WIDE
    found = components(links(nodes, WIDE_BLOCKS if wide else BLOCKS))
    nodes = nodes.join(found, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    nodes = written(nodes)
    least = written(nodes.groupBy(F.col("root").alias("of")).agg(F.min("first").alias("component_id")))
    known = nodes.join(broadcast_if_small(least), F.col("root") == F.col("of")).select("fp", "root", "component_id")
    known = written(known.withColumnRenamed("fp", "of"))
    return rows.join(broadcast_if_small(known), F.col("fp") == F.col("of")).select("doc_id", "fp", "root", "component_id")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id."""
    return label(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: Ids of removed documents that may be broadcast (8 bytes each); they are counted first.
BROADCAST_IDS = 1_000_000


def deduplicate(docs: DataFrame) -> DataFrame:
    """The rows of `docs`, all columns: of each component the document with the smallest id (of equal ids, the smallest fingerprint).

    Repeats of that row go as well. A component whose ids are all null keeps one document. Where ids are unique, the texts
    are not shuffled while the removed ids can be broadcast.
    """
    labelled = written(label(docs))
    ids = labelled.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    if ids.filter("doc_id IS NULL OR n > 1").limit(1).count() == 0:
        removed = written(labelled.filter("doc_id <> component_id").select(F.col("doc_id").alias("__gone")))
        return docs.join(broadcast_if_small(removed, BROADCAST_IDS), docs["doc_id"] == F.col("__gone"), "left_anti")
    kept = labelled.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("root").agg(F.min(F.struct(F.col("doc_id"), F.col("fp"))).alias("k"))
    kept = kept.select(F.col("k.doc_id").alias("__kept_id"), F.col("k.fp").alias("__kept_fp"))
    marked = docs.withColumn("__fp", F.arrow_udf(_fingerprints, "long")(docs["text"]))
    marked = marked.join(kept, F.col("doc_id").eqNullSafe(F.col("__kept_id")) & (F.col("__fp") == F.col("__kept_fp")), "left_semi")
    return marked.dropDuplicates(["doc_id", "__fp"]).drop("__fp")
