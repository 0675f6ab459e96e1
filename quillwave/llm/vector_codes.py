"""Vector code compression: product codes by whole-number clustering, the nearest entry found through memoised grid cells.

Each component becomes the integer floor(1024 * x); a vector is cut into PARTS consecutive parts, each with a codebook of
ENTRIES entries. A round assigns every part to its nearest entry and replaces each entry by the floored mean of its parts.
All distances and means are integers, so results do not depend on how Spark deals the rows.

The nearest entry of a part is sought in its grid cell: the components divided by STEP, rounded down. For each cell it is
worked out once which entries can be nearest anywhere in its box: an entry is dominated, and left out, if its least distance
to the box is larger than the largest distance of another entry. Only the entries left are compared exactly with the parts
that fall into the cell. Cells are remembered in a task, up to CELLS of them for each codebook.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .binary_records import spread
from .common import broadcast_if_small, written

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Width of a grid cell, in units of a component.
STEP = 48
#: Cells remembered for each codebook; beyond, the task begins anew with those it meets.
CELLS = 50_000
#: Distances worked out at once.
PAIRS = 400_000


class Cells:
    """Nearest entries of one codebook (entry, component), through the cells that were met."""

    def __init__(self, book: np.ndarray, step: int = STEP) -> None:
        self.book, self.step, self.compared = book, step, 0
        self.forget()

    def forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.starts, self.counts, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def learn(self, cells: np.ndarray) -> None:
        """Adds cells (cell, coordinate): entries that no other entry dominates over the box, in ascending order."""
        found = []
        size = max(1, PAIRS // len(self.book))
        for at in range(0, len(cells), size):
            some = cells[at : at + size]
            least, most = (np.zeros((len(some), len(self.book)), np.int64) for _ in range(2))
            for column, entries in zip(some.T, self.book.T, strict=True):  # a coordinate has few values: their distances are looked up
                values, which = np.unique(column, return_inverse=True)
                under = values[:, None] * self.step - entries
                over = -(under + (self.step - 1))
                gap, far = np.maximum(np.maximum(under, over), 0), np.maximum(np.abs(under), np.abs(over))
                least += (gap * gap)[which]
                most += (far * far)[which]
            found.append(least <= most.min(1, keepdims=True))
        kept = np.concatenate(found)
        counts = kept.sum(1)
        self.starts = np.r_[self.starts, len(self.flat) + np.cumsum(counts) - counts]
        self.counts, self.flat = np.r_[self.counts, counts], np.r_[self.flat, np.nonzero(kept)[1]]

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entry, squared distance) of each row; ties go to the lower entry."""
        cells = np.ascontiguousarray(x // self.step)
        names, first, which = np.unique(cells.view(np.dtype((np.void, cells.itemsize * cells.shape[1]))).ravel(), return_index=True, return_inverse=True)
        if len(self.known) + len(names) > CELLS:
            self.forget()
        new = [i for i, name in enumerate(names.tolist()) if self.known.setdefault(name, len(self.known)) >= len(self.counts)]
        if new:
            self.learn(cells[first[new]])
        numbers = np.fromiter(map(self.known.__getitem__, names.tolist()), np.int64, len(names))[which]
        counts = self.counts[numbers]
        self.compared += int(counts.sum())
        entry, distance = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
        stops = np.cumsum(counts)
        at = 0
        while at < len(x):
            to = max(at + 1, int(np.searchsorted(stops, stops[at] - counts[at] + PAIRS, "right")))
            n = counts[at:to]
            among = self.flat[spread(self.starts[numbers[at:to]], n)]
            d = x[np.repeat(np.arange(at, to), n)] - self.book[among]
            d = (d * d).sum(1)
            begin = np.cumsum(n) - n
            least = np.minimum.reduceat(d, begin)
            hit = np.flatnonzero(d == np.repeat(least, n))
            entry[at:to], distance[at:to] = among[hit[np.searchsorted(hit, begin)]], least
            at = to
        return entry, distance


def limit(width: int) -> int:
    """Components are held within this bound, so that the distances of a whole vector fit into 63 bits."""
    return int((2**61 / max(1, width)) ** 0.5) // 2


def _integers(width: int):
    """(vec_id, label, embedding) to (vec_id, label, part, ...): integers of vectors `width` long, padded to a multiple of PARTS."""
    padded = -(-width // PARTS) * PARTS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat = b.column(2).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(b), width)
            x = np.clip(np.floor(flat * SCALE), -limit(width), limit(width)).astype(np.int64)
            x = np.ascontiguousarray(np.pad(x, ((0, 0), (0, padded - width))))
            whole = pa.Array.from_buffers(pa.binary(padded * 8), len(b), [None, pa.py_buffer(x)]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), whole], ["vec_id", "label", "whole"])

    return run


def _rows(b: pa.RecordBatch, column: int) -> np.ndarray:
    return np.stack([np.frombuffer(v.as_buffer(), np.int64) for v in b.column(column)])


def _sums(books: np.ndarray, step: int):
    """(part, entry, n, sums) of a task's vectors: sums has the components of all parts assigned to that entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = [Cells(book, step) for book in books]
        n, sums = np.zeros(books.shape[:2], np.int64), np.zeros(books.shape, np.int64)
        for b in batches:
            if len(b):
                x = _rows(b, 0).reshape(len(b), len(books), -1)
                for p, c in enumerate(cells):
                    entry, _ = c.nearest(np.ascontiguousarray(x[:, p]))
                    n[p] += np.bincount(entry, minlength=n.shape[1])
                    np.add.at(sums[p], entry, x[:, p])
        p, e = np.nonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(e), pa.array(n[p, e]), pa.array(list(sums[p, e]), pa.list_(pa.int64()))], ["part", "entry", "n", "sums"])

    return run


def _codes(books: np.ndarray, step: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = [Cells(book, step) for book in books]
        for b in batches:
            if len(b):
                x = _rows(b, 2).reshape(len(b), len(books), -1)
                found = [c.nearest(np.ascontiguousarray(x[:, p])) for p, c in enumerate(cells)]
                code = np.stack([e for e, _ in found], 1).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([r.tobytes().hex() for r in code]), pa.array(sum(d for _, d in found))], ["vec_id", "label", "code", "error"])

    return run


def kept(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, embedding) without vectors that are null, empty or hold null or non-finite components."""
    e = F.col("embedding")
    finite = F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return vectors.select("vec_id", "label", "embedding").filter(e.isNotNull() & (F.size(e) > 0) & finite)


def fit(integers: DataFrame, width: int, rounds: int = ROUNDS, step: int = STEP) -> np.ndarray:
    """Codebooks (part, entry, component) of (vec_id, whole), after so many rounds over all rows."""
    first = integers.filter("vec_id IS NOT NULL").select("vec_id", "whole").orderBy("vec_id", "whole").limit(ENTRIES).collect()
    if not first:  # no vector has an id
        first = integers.select("whole").orderBy("whole").limit(ENTRIES).collect()
    padded = -(-width // PARTS) * PARTS
    books = np.stack([np.frombuffer(bytes(r["whole"]), np.int64) for r in first]).reshape(len(first), PARTS, padded // PARTS).transpose(1, 0, 2).copy()
    for _ in range(rounds):
        told = integers.select("whole").mapInArrow(_sums(books, step), "part long, entry long, n long, sums array<long>")
        each = told.select("part", "entry", "n", F.posexplode("sums").alias("place", "value"))
        totals = each.groupBy("part", "entry", "place").agg(F.sum("n").alias("n"), F.sum("value").alias("value"))
        for r in totals.collect():  # a number of each codebook component at most
            books[r["part"], r["entry"], r["place"]] = r["value"] // r["n"]
    return books


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress(vectors: DataFrame, rounds: int = ROUNDS, step: int = STEP) -> DataFrame:
    """vectors(vec_id, embedding, label) to (vec_id, code, error, label_error, codebooks_sha256).

    Vectors that are null, empty or hold a null or non-finite component are dropped, and so are those of another length than
    the kept vector with the smallest id. A length that is no multiple of PARTS is filled up with zeros at its end. Integers
    beyond limit(length) count as that bound. Null ids are coded, but begin no codebook unless all ids are null. Repeated ids
    and rows count each. With fewer vectors than ENTRIES a codebook has as many entries as there are. An empty table gives no
    rows; other columns are not read.
    """
    rows = kept(vectors)
    least = rows.select("vec_id", F.size("embedding").alias("width")).orderBy(F.col("vec_id").asc_nulls_last(), "width").limit(1).collect()
    width = least[0]["width"] if least else PARTS
    kind = vectors.schema["label"].dataType.simpleString()
    name = vectors.schema["vec_id"].dataType.simpleString()
    rows = rows.filter(F.size("embedding") == width).select("vec_id", "label", "embedding")
    integers = written(rows.mapInArrow(_integers(width), f"vec_id {name}, label {kind}, whole binary"))
    books = fit(integers, width, rounds, step) if least else np.zeros((PARTS, 1, 1), np.int64)
    coded = written(integers.mapInArrow(_codes(books, step), f"vec_id {name}, label {kind}, code string, error long"))
    sums = coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of")
    return (
        coded.join(broadcast_if_small(written(sums)), F.col("label").eqNullSafe(F.col("of")))
        .select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
    )
