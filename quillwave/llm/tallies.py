"""Totals of counted keys over all shards of a table, and back to each shard in the order of its keys.

A shard is a bounded piece of a corpus that one row describes. It sends its distinct keys (unsigned 64-bit, ascending) with
counts, cut into parts by the keys' leading bits: a row for each part, sorted keys as differences, packed. A part's rows meet
in one group, which adds up and answers each shard with a number per key, in the shard's own order, so that keys do not
travel back. A key comes from a shard once, however often it occurs there, so no group depends on how frequent a key is; the
number of parts follows the number of keys.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

#: Keys of all shards that one group holds, about.
GROUP_KEYS = 1_000_000

SENT = "kind int, part int, shard long, keys binary, counts binary"
BACK = "kind int, part int, shard long, totals binary, told array<long>"
_SENT = ["kind", "part", "shard", "keys", "counts"]


def pack(x: np.ndarray) -> bytes:
    """Whole numbers from 0 on, byte by byte of the same rank, compressed."""
    x = np.ascontiguousarray(x, np.uint64)
    size = max(1, (int(x.max()).bit_length() + 7) // 8) if len(x) else 1
    planes = np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8)[:, :size].T)
    return bytes([size]) + zstandard.ZstdCompressor(1).compress(planes)


def unpack(data: bytes) -> np.ndarray:
    size = data[0]
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[1:]), np.uint8).reshape(size, -1)
    x = np.zeros((planes.shape[1], 8), np.uint8)
    x[:, :size] = planes.T
    return x.view(np.uint64).ravel()


def pack_sorted(keys: np.ndarray) -> bytes:
    return pack(np.diff(keys, prepend=np.uint64(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data), dtype=np.uint64)


def part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    """The part of each key, by its leading 32 bits; ascending with the keys."""
    return ((keys >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def sent(kind: int, shard: int, keys: np.ndarray, counts: np.ndarray, parts: int) -> Iterator[pa.RecordBatch]:
    """The rows that a shard sends: ascending distinct keys, and one or more columns of counts (key, column)."""
    part = part_of(keys, parts)
    at = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(part) else np.zeros(0, np.int64)
    counts = counts.reshape(len(keys), -1)
    for i, j in zip(at, np.r_[at[1:], len(part)], strict=True):
        row = [kind, int(part[i]), shard, pack_sorted(keys[i:j]), pack(counts[i:j].ravel())]
        yield pa.RecordBatch.from_arrays([pa.array([row[0]], pa.int32()), pa.array([row[1]], pa.int32()), pa.array([shard]), pa.array([row[3]], pa.binary()), pa.array([row[4]], pa.binary())], _SENT)


def answered(rows: DataFrame, total: Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, list[int]]]) -> DataFrame:
    """SENT to BACK: total(distinct keys, key number of each sent key, counts) gives the numbers of each distinct key (key, column).

    It also gives some numbers about the whole group, which stand in `told` of one of its rows; the others have none.
    """

    def run(table: pa.Table) -> pa.Table:
        kind, part = table.column("kind")[0].as_py(), table.column("part")[0].as_py()
        keys = [unpack_sorted(v.as_py()) for v in table.column("keys")]
        counts = np.concatenate([unpack(v.as_py()).reshape(len(k), -1) for v, k in zip(table.column("counts"), keys, strict=True)])
        stops = np.cumsum([len(k) for k in keys])
        distinct, which = np.unique(np.concatenate(keys), return_inverse=True)
        out, told = total(distinct, which, counts)
        out = out.reshape(len(distinct), -1)
        back = [pack(out[w].ravel()) for w in np.split(which, stops[:-1])]
        n = table.num_rows
        return pa.table({"kind": pa.array([kind] * n, pa.int32()), "part": pa.array([part] * n, pa.int32()), "shard": table.column("shard"), "totals": pa.array(back, pa.binary()), "told": pa.array([told, *[[]] * (n - 1)], pa.list_(pa.int64()))})

    return rows.groupBy("kind", "part").applyInArrow(run, BACK)


def summed(distinct: np.ndarray, which: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """The sum of each column of counts for each key; told: keys whose first sum is above the sum of none, or of one, of the others."""
    sums = np.stack([np.bincount(which, c, len(distinct)).astype(np.int64) for c in counts.T], 1)
    return sums, [int((sums[:, 0] > 0).sum()), *(int((sums[:, 0] > sums[:, i]).sum()) for i in range(1, sums.shape[1]))]


def received(table: pa.Table, kind: int, columns: int) -> np.ndarray:
    """(key, column) of one kind for a shard, from its BACK rows: parts ascend as the keys do."""
    rows = sorted((p, t) for k, p, t in zip(*(table.column(c).to_pylist() for c in ("kind", "part", "totals")), strict=True) if k == kind)
    return np.concatenate([unpack(t) for _, t in rows] or [np.zeros(0, np.uint64)]).astype(np.int64).reshape(-1, columns)


def parts_for(keys: int) -> int:
    return max(1, -(-keys // GROUP_KEYS))


def together(shards: DataFrame, back: DataFrame, run, schema: str) -> DataFrame:
    """run(shard's row, its BACK rows) for every shard."""

    def both(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        return run(left, right)

    return shards.groupBy("shard").cogroup(back.withColumnRenamed("shard", "of").groupBy("of")).applyInArrow(both, schema)


def numbers(bits: int) -> Iterator[int]:
    """Ascending numbers that no other task gives out, 2^bits of them for each task."""
    from pyspark import TaskContext

    return itertools.count(TaskContext.get().partitionId() << bits)
