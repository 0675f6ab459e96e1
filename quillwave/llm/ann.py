"""Approximate nearest neighbours by cross-polytope hashing.

A hash turns a unit vector by a fast pseudo-rotation (three rounds of random signs and a Walsh-Hadamard transform) and names
the nearest signed axis. A table joins two hashes, and every vector is in one bucket of every table. A query probes the
buckets of all tables together in the order of the sum of its coordinates on their two axes, the nearest first. How many it
probes is measured: for a bounded sample of vectors the true neighbours are found by comparison with all rows, and the number
is taken at which the wanted share of them is in a probed bucket. Small tables have far neighbours and need many probes,
large ones fewer.

Buckets of one first axis meet the queries that probe any of them in one group; only vectors of probed buckets are compared.
Each group gives out the best few of each query, scored exactly. Queries that found fewer than there are, and those of a width
at which too few of the sample's neighbours can be met by probing, go through all rows, in blocks. Equal vectors are one entry that carries the smallest ids, which is all that a list of K can hold of them.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast_if_small, written

TABLES, K = 10, 5
#: Share of the sample's true neighbours that the probed buckets hold, and the sample's size in vectors.
RECALL, SAMPLE = 0.94, 256
#: Axes of each hash, the query's nearest, that are combined to buckets: all of them up to a width of 256. Where the sample's
#: neighbours of a wider vector lie beyond, that width is searched exactly.
AXES = 512
#: Vectors of one group, and queries of one group, that a task compares; larger groups are dealt in tiles.
TILE, TILE_QUERIES = 20_000, 4_000
#: Queries that are compared with all rows at once.
BLOCK = 1_000
BITS = 17  # of an axis: vectors up to 65,536 wide

FOUND = "query long, first long, score double"


def hadamard(x: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of the rows, in n log n; the width is a power of two."""
    n, width = x.shape[0], 1
    while width < x.shape[1]:
        y = x.reshape(n, -1, 2, width)
        x = np.concatenate([y[:, :, :1] + y[:, :, 1:], y[:, :, :1] - y[:, :, 1:]], 2).reshape(n, -1)
        width *= 2
    return x


@cache
def _signs(rotation: int, width: int) -> np.ndarray:
    return np.random.default_rng(1_000 + rotation).choice([-1.0, 1.0], (3, width))


def rotated(x: np.ndarray, rotation: int) -> np.ndarray:
    """The rows, padded to a power of two, after the pseudo-rotation of that number."""
    width = 1 << max(0, x.shape[1] - 1).bit_length()
    x = np.pad(x, ((0, 0), (0, width - x.shape[1])))
    for signs in _signs(rotation, width):
        x = hadamard(x * signs) / np.sqrt(width)
    return x


def axes(x: np.ndarray, rotation: int) -> np.ndarray:
    """The coordinates of each row on the signed axes: 2 * axis is the negative side, plus 1 the positive one."""
    y = rotated(x, rotation)
    return np.stack([-y, y], 2).reshape(len(y), -1)


def buckets(x: np.ndarray, table: int) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of each row: the nearest signed axis of either hash."""
    return axes(x, 2 * table).argmax(1), axes(x, 2 * table + 1).argmax(1)


def _sums(q: np.ndarray, tables: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each query, its nearest axes of the first and second hash of each table, and the sum of its coordinates on every two of them."""
    y = np.stack([axes(q, r) for r in range(2 * tables)], 1).astype(np.float32)
    near = np.argsort(-y, 2, kind="stable")[:, :, :AXES]
    high = np.take_along_axis(y, near, 2)
    for n, h in zip(near, high, strict=True):
        yield n[0::2], n[1::2], h[0::2, :, None] + h[1::2, None, :]


def needed(q: np.ndarray, neighbours: list[np.ndarray], tables: int) -> Iterator[float]:
    """How many buckets each query must probe until it meets each of its neighbours; infinite for one beyond the query's AXES."""
    where = [buckets(np.concatenate(neighbours), t) for t in range(tables)]
    stops = np.cumsum([len(x) for x in neighbours])
    for (first, second, sums), own, stop in zip(_sums(q, tables), neighbours, stops, strict=True):
        best = np.full(len(own), -np.inf)
        for t in range(tables):
            a, b = (x[stop - len(own) : stop] for x in where[t])
            i, j = first[t][None] == a[:, None], second[t][None] == b[:, None]
            met = i.any(1) & j.any(1)
            best = np.where(met, np.maximum(best, sums[t][i.argmax(1), j.argmax(1)]), best)
        yield from (float((sums >= v).sum()) if np.isfinite(v) else np.inf for v in best)


def probes(q: np.ndarray, count: int, tables: int) -> Iterator[list[tuple[int, int, np.ndarray]]]:
    """For each query (table, first axis, second axes) of its `count` nearest buckets."""
    for first, second, sums in _sums(q, tables):
        least = -np.partition(-sums.ravel(), count - 1)[count - 1] if count < sums.size else -np.inf
        t, i, j = np.nonzero(sums >= least)
        cut = np.flatnonzero(np.r_[True, (t[1:] != t[:-1]) | (i[1:] != i[:-1])])
        yield [(int(t[a]), int(first[t[a], i[a]]), second[t[a], j[a:b]]) for a, b in zip(cut, np.r_[cut[1:], len(t)], strict=True)]


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding) without null ids and without vectors that are null, empty, zero or not finite; repeated rows once."""
    e = F.col("embedding")
    finite = F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    rows = vectors.select("vec_id", e.alias("embedding")).filter("vec_id IS NOT NULL AND embedding IS NOT NULL")
    return rows.filter(finite & F.exists("embedding", lambda v: v != 0)).distinct()


def _matrices(b: pa.RecordBatch, kind: str) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(first, rows, unit rows) of a batch (first, vector), by width."""
    first, vectors = b.column(0).to_numpy(), [v.as_buffer() for v in b.column(1)]
    widths = np.array([v.size for v in vectors])
    for width in np.unique(widths):
        own = np.flatnonzero(widths == width)
        x = np.stack([np.frombuffer(vectors[i], kind) for i in own]).astype(float)
        yield first[own], x, x / np.linalg.norm(x, axis=1, keepdims=True)


def _packed(entries: DataFrame) -> tuple[DataFrame, str]:
    """(first, vector): the numbers of each vector, little-endian, in the width they are given in."""
    kind = "<f4" if entries.schema["embedding"].dataType.elementType.typeName() == "float" else "<f8"

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            flat, at = b.flatten().to_numpy(zero_copy_only=False).astype(kind), b.offsets.to_numpy() - b.offsets[0].as_py()
            yield pa.array([flat[i:j].tobytes() for i, j in zip(at, at[1:])], pa.binary())

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return entries.select("first", F.arrow_udf(run, "binary")(F.col("embedding")).alias("vector")), kind


def _key(width: int, table: int, axis: np.ndarray, part: np.ndarray) -> np.ndarray:
    return ((np.int64(width) << 6 | table) << BITS | axis) << BITS | part


def _in_buckets(kind: str, tables: int, parts: int):
    """(key, axis, first, vector): each vector in every table, by first axis and part of the second axes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, x, unit in _matrices(b, kind):
                packed = pa.array([r.tobytes() for r in x.astype(kind)], pa.binary())
                for t in range(tables):
                    a, c = buckets(unit, t)
                    key = _key(x.shape[1], t, a, c * parts >> BITS)
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(c.astype(np.int32)), pa.array(first), packed], ["key", "axis", "first", "vector"])

    return run


def _probing(kind: str, tables: int, parts: int, counts: dict[int, int], other: int):
    """(key, axes, query, vector): what each query probes, the second axes of one key as one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, x, unit in _matrices(b, kind):
                wished = itertools.chain.from_iterable(probes(unit[at : at + 256], counts.get(x.shape[1], other), tables) for at in range(0, len(unit), 256))
                for name, raw, wishes in zip(first, x.astype(kind), wished, strict=True):
                    keys, lists = [], []
                    for t, a, second in wishes:
                        part = second * parts >> BITS
                        for p in np.unique(part):
                            keys.append(int(_key(x.shape[1], t, a, p)))
                            lists.append(second[part == p].astype("<i4").tobytes())
                    n = len(keys)
                    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(lists, pa.binary()), pa.array([name] * n, pa.int64()), pa.array([raw.tobytes()] * n, pa.binary())], ["key", "axes", "query", "vector"])

    return run


def _best(name: np.ndarray, q: np.ndarray, first: np.ndarray, x: np.ndarray, pairs: Iterator[tuple[np.ndarray, np.ndarray]], most: int) -> list[np.ndarray]:
    """(query, first, score): the best `most` of each query among its pairs. pairs gives (queries, vectors) to compare each with each.

    Scores are computed per pair, alike in every group.
    """
    norm_q, norm_x = np.sqrt((q * q).sum(1)), np.sqrt((x * x).sum(1))
    unit_q, unit_x = q / norm_q[:, None], x / norm_x[:, None]
    out: list[tuple] = []
    for rows, columns in pairs:
        s = unit_q[rows] @ unit_x[columns].T
        if len(columns) > most:
            least = -np.partition(-s, most - 1, 1)[:, most - 1]
            i, j = np.nonzero(s >= least[:, None] - 1e-12)
        else:
            i, j = (v.ravel() for v in np.indices(s.shape))
        i, j = rows[i], columns[j]
        out.append((i, j, (q[i] * x[j]).sum(1) / (norm_q[i] * norm_x[j])))
    if not out:
        return [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
    i, j, score = (np.concatenate(c) for c in zip(*out, strict=True))
    order = np.lexsort((first[j], -score, i))
    i, j, score = i[order], j[order], score[order]
    take = np.arange(len(i)) - np.searchsorted(i, i) < most
    return [name[i[take]], first[j[take]], score[take]]


def _table(columns: list[np.ndarray]) -> list[pa.Array]:
    return [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.float64())]


NAMES = ["query", "first", "score"]


def _comparer(kind: str, most: int):
    """One tile of a group: base (axis, first, vector) against the queries that probe some of its buckets."""

    def compare(key: tuple, queries: pa.Table, base: pa.Table) -> pa.Table:
        if not queries.num_rows or not base.num_rows:
            return pa.Table.from_arrays(_table([np.zeros(0)] * 3), NAMES)
        read = lambda c: np.stack([np.frombuffer(v.as_buffer(), kind) for v in c]).astype(float)
        q, x = read(queries.column("qvector")), read(base.column("vector"))
        axis = base.column("axis").to_numpy()
        asked = [np.frombuffer(v.as_buffer(), "<i4") for v in queries.column("axes")]
        wants = np.repeat(np.arange(len(asked)), [len(v) for v in asked])
        asked = np.concatenate(asked)
        by_axis, by_wish = np.argsort(axis, kind="stable"), np.argsort(asked, kind="stable")

        def pairs() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            there, at = np.unique(axis[by_axis], return_index=True)
            stops = np.r_[at[1:], len(axis)]
            lo, hi = np.searchsorted(asked[by_wish], there, "left"), np.searchsorted(asked[by_wish], there, "right")
            for a, b, c, d in zip(at, stops, lo, hi, strict=True):
                for w in range(c, d, 512):
                    yield wants[by_wish[w : min(d, w + 512)]], by_axis[a:b]

        return pa.Table.from_arrays(_table(_best(queries.column("query").to_numpy(), q, base.column("first").to_numpy(), x, pairs(), most)), NAMES)

    return compare


def brute_force(packed: DataFrame, kind: str, asked: DataFrame, most: int) -> DataFrame:
    """(query, first, score): the best `most` of asked(first), at most BLOCK of them, among all vectors of their width."""
    given: dict[int, tuple] = {}
    rows = packed.join(F.broadcast(asked.select(F.col("first").alias("of"))), F.col("first") == F.col("of"), "left_semi").toArrow()
    for b in rows.combine_chunks().to_batches():
        for first, x, _ in _matrices(b, kind):
            names, vectors = given.get(x.shape[1], (np.zeros(0, np.int64), x[:0]))
            given[x.shape[1]] = np.r_[names, first], np.r_[vectors, x]
    shared = packed.sparkSession.sparkContext.broadcast(given)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, x, _ in _matrices(b, kind):
                if x.shape[1] in shared.value:
                    name, q = shared.value[x.shape[1]]
                    whole = ((np.arange(at, min(len(q), at + 128)), np.arange(len(x))) for at in range(0, len(q), 128))
                    yield pa.RecordBatch.from_arrays(_table(_best(name, q, first, x, whole, most)), NAMES)

    best = Window.partitionBy("query").orderBy(F.col("score").desc(), "first")
    return packed.mapInArrow(run, FOUND).withColumn("n", F.row_number().over(best)).filter(F.col("n") <= most).select(*NAMES)


def fit(packed: DataFrame, kind: str, k: int = K, tables: int = TABLES, recall: float = RECALL) -> dict[int, int | None]:
    """Buckets to probe, by width of the vectors: enough for `recall` of the true neighbours of SAMPLE vectors, compared with all rows.

    None: no number of probes is enough. The share is raised by two standard errors of the sample, so few neighbours (a small table) are all to be met.
    """
    sample = written(packed.select("first").orderBy(F.xxhash64("first"), "first").limit(SAMPLE))
    near = written(brute_force(packed, kind, sample, k + 1).filter("query <> first").select("query", F.col("first").alias("of")))
    told = packed.join(F.broadcast(near.select(F.col("of").alias("x")).unionByName(near.select(F.col("query").alias("x"))).distinct()), F.col("first") == F.col("x"), "left_semi").toArrow()
    units = {int(f): u for b in told.combine_chunks().to_batches() for first, _, unit in _matrices(b, kind) for f, u in zip(first, unit, strict=True)}
    pairs: dict[int, list[int]] = {}
    for query, of in near.collect():  # k for each vector of the sample
        pairs.setdefault(query, []).append(of)
    counts: dict[int, list[float]] = {}
    for width in {len(units[q]) for q in pairs}:
        own = [q for q in pairs if len(units[q]) == width]
        counts[width] = list(needed(np.stack([units[q] for q in own]), [np.stack([units[o] for o in pairs[q]]) for q in own], tables))
    sure = lambda n: min(1.0, recall + 2 * (recall * (1 - recall) / len(n)) ** 0.5)
    most = {width: np.quantile(n, sure(n), method="higher") for width, n in counts.items()}
    return {width: int(n) if np.isfinite(n) else None for width, n in most.items()}


def search(vectors: DataFrame, is_query=None, k: int = K, tables: int = TABLES, recall: float = RECALL) -> DataFrame:
    """vectors(vec_id, embedding) to (query_id, rank, vec_id, score): the k nearest found for each query, by cosine, or all if fewer.

    is_query: a condition on vec_id; by default the ids divisible by 50. Ties go to the smaller vec_id. Null ids, and vectors that
    are null, empty, zero or not finite, take no part; a row that repeats in full counts once. A vec_id with several vectors is
    asked with each of them, so its ranks repeat; it is never its own neighbour. Vectors of different length are never
    compared; above 65,536 numbers they are an error. A bucket or a vector may hold any share of the rows. An empty table gives
    no rows; other columns are not read.
    """
    rows = written(usable(vectors))
    query = (F.col("vec_id") % 50 == 0) if is_query is None else is_query
    smallest = Window.partitionBy("embedding").orderBy("vec_id")
    few = rows.withColumn("n", F.row_number().over(smallest)).filter(F.col("n") <= k + 1)
    # first: the smallest id of equal vectors, made one-to-one where an id has several vectors
    entries = few.groupBy("embedding").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    entries = written(entries.select(F.element_at("ids", 1).alias("least"), "embedding", "ids"))
    again = entries.groupBy("least").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").limit(1).count() > 0
    entries = written(entries.sort("least", "embedding").withColumn("first", F.monotonically_increasing_id())) if again else entries.withColumn("first", F.col("least"))
    asked = rows.filter(query).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("e"))
    asked = written(asked.join(entries.select("first", "embedding"), F.col("e") == F.col("embedding")).select("query_id", "first", F.size("embedding").alias("width")))
    packed, kind = _packed(entries)
    packed = written(packed)
    widest = packed.agg(F.count(F.lit(1)), F.max(F.octet_length("vector"))).first()
    if (widest[1] or 0) // int(kind[2]) > 1 << BITS - 1:
        raise ValueError(f"vectors of {widest[1] // int(kind[2])} numbers; {1 << BITS - 1} is the most")
    fitted = fit(packed, kind, k, tables, recall)
    counts, exact = {w: n for w, n in fitted.items() if n is not None}, [w for w, n in fitted.items() if n is None]
    # parts of the second axes: as many as bring a group's vectors near TILE
    axes_ = 1 << max(1, (max(1, (widest[1] or 4) // int(kind[2])) - 1).bit_length() + 1)
    parts = (1 << BITS) // axes_ * max(1, min(axes_, -(-widest[0] // (axes_ * TILE))))
    base = packed.mapInArrow(_in_buckets(kind, tables, parts), "key long, axis int, first long, vector binary")
    asking = packed.join(broadcast_if_small(written(asked.filter(~F.col("width").isin(exact)).select(F.col("first").alias("of")).distinct())), F.col("first") == F.col("of"), "left_semi").repartition(packed.sparkSession.sparkContext.defaultParallelism, "first")
    probing = asking.mapInArrow(_probing(kind, tables, parts, counts, max(counts.values(), default=1)), "key long, axes binary, query long, vector binary")
    # tiles: a row per group that has both sides
    count = lambda df, n: df.groupBy("key").agg(F.count(F.lit(1)).alias(n))
    tiles = count(base, "b").join(count(probing, "q"), "key").select(F.col("key").alias("of"), F.ceil(F.col("b") / TILE).cast("int").alias("nb"), F.ceil(F.col("q") / TILE_QUERIES).cast("int").alias("nq"))
    tiles = broadcast_if_small(written(tiles))
    own = lambda name, n: F.pmod(F.xxhash64(name), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    dealt = base.join(tiles, F.col("key") == F.col("of")).withColumn("x", own("first", "nb")).withColumn("y", every("nq")).select("key", "x", "y", "axis", "first", "vector")
    probing = probing.withColumnsRenamed({"key": "asked", "vector": "qvector"}).join(tiles, F.col("asked") == F.col("of")).withColumn("v", own("query", "nq")).withColumn("u", every("nb"))
    probing = probing.select("asked", "u", "v", "axes", "query", "qvector")
    found = probing.groupBy("asked", "u", "v").cogroup(dealt.groupBy("key", "x", "y")).applyInArrow(_comparer(kind, k + 1), FOUND)
    best = Window.partitionBy("query").orderBy(F.col("score").desc(), "first")
    found = written(found.dropDuplicates(["query", "first"]).withColumn("n", F.row_number().over(best)).filter(F.col("n") <= k + 1).select(*NAMES))

    def ranked(found: DataFrame) -> DataFrame:
        lists = found.join(entries.select(F.col("first").alias("of"), "ids"), F.col("first") == F.col("of")).select("query", "score", F.explode("ids").alias("vec_id"))
        pairs = asked.join(lists, F.col("first") == F.col("query")).filter("query_id <> vec_id")
        rank = Window.partitionBy("query_id", "query").orderBy(F.col("score").desc(), "vec_id")
        return pairs.withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= k)

    out = written(ranked(found).select("query_id", "query", "rank", "vec_id", "score"))
    there = rows.groupBy(F.size("embedding").alias("of")).agg(F.count_distinct("vec_id").alias("n"))
    got = out.groupBy("query_id", "query").agg(F.count(F.lit(1)).alias("have"))
    open_ = asked.join(F.broadcast(there), F.col("width") == F.col("of")).join(got.withColumnRenamed("query_id", "qid"), (F.col("query_id") == F.col("qid")) & (F.col("first") == F.col("query")), "left")
    open_ = written(open_.filter(F.coalesce("have", F.lit(0)) < F.least(F.lit(k), F.col("n") - 1)).select("first").distinct())
    blocks = -(-open_.count() // BLOCK)
    if blocks:
        part = F.pmod(F.xxhash64("first"), F.lit(2 * blocks - 1))
        whole = [written(brute_force(packed, kind, open_.filter(part == i), k + 1)) for i in range(2 * blocks - 1)]
        for more in whole[1:]:
            whole[0] = whole[0].unionByName(more)
        kept = out.join(broadcast_if_small(open_.select(F.col("first").alias("of"))), F.col("query") == F.col("of"), "left_anti")
        out = kept.unionByName(ranked(whole[0]).select(*kept.columns))
    return out.select("query_id", "rank", "vec_id", "score")
