"""Language-model scores by deleted interpolation.

The model mixes the maximum-likelihood estimates of 1-grams to ORDER-grams and the uniform distribution over all known tokens
and one unknown. The mixture weights depend on the bucket of the context: how long the longest context is that was met in
training, and the power of two that its frequency reaches. They are learned by expectation-maximisation: the counts of a part
of the training documents are taken out of the totals, and the weights are chosen to make that part most likely. The scores
then use the counts of all training documents.

Texts become shards of bounded size: the word numbers of many documents and the hashes of the shard's distinct words. A shard
sends its distinct n-grams with their counts and gets their totals back (`tallies`); the frequency of a context is the total
of the n-gram that ends one token earlier, so a shard then scores its documents alone. A document longer than a shard is
several, each of which begins with the last words of the one before. Words and n-grams are told apart by 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import tallies
from .common import slices, written
from .substring import word_hashes

ORDER = 2
#: Bytes of text in a shard.
SHARD_BYTES = 5_000_000
#: Of ten parts of the documents, the one that is scored only, and the one that weights are learned from.
TEST_PART, DELETED_PART, OF_PARTS = 0, 1, 10
#: Rounds of expectation-maximisation at most, and the change of a weight below which they end.
ROUNDS, STILL = 20, 0.002
ADDED = 0.1  # of the base score

START, END = np.uint64(0x5BD1E9955BD1E995), np.uint64(0xC2B2AE3D27D4EB4F)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Bytes of text whose words are hashed at once.
_GROUP = 1_000_000
_LEVEL = 64  # buckets of one context length

SHARDS = "shard long, deleted boolean, docs array<long>, doc_ids array<long>, parts array<int>, sizes array<long>, begins array<boolean>, words binary, known binary"
SCORED = "doc long, doc_id long, part int, n_tokens long, n_known long, base_score double, score double"


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0xFF51AFD7ED558CCD)


def part_of(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo OF_PARTS; a null id is an empty text."""
    return (F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % OF_PARTS).cast("int")


def _hashes(texts: list[bytes]) -> list[np.ndarray]:
    """Hashes of the words of each text, lower-cased."""
    out: list[np.ndarray] = []
    group: list[bytes] = []
    held = 0
    for i, t in enumerate(texts):
        group.append(t.translate(_LOWER))
        held += len(t)
        if held > _GROUP or i == len(texts) - 1:
            h, n = word_hashes(group)
            out += np.split(h, np.cumsum(n)[:-1])
            group, held = [], 0
    return out


def _encode(order: int):
    lead = order - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, doc_number = tallies.numbers(32), tallies.numbers(40)

        def shard(deleted: bool, rows: list[tuple[int, int | None, int, bool, np.ndarray]]) -> pa.RecordBatch:
            flat = np.concatenate([h for *_, h in rows])
            known, first = np.unique(flat, return_inverse=True)
            uses = np.argsort(-np.bincount(first, minlength=len(known)), kind="stable")  # frequent words get small numbers
            place = np.empty(len(known), np.int64)
            place[uses] = np.arange(len(known))
            columns = [
                pa.array([2 * next(number) + deleted]), pa.array([deleted]), pa.array([[r[0] for r in rows]], pa.list_(pa.int64())), pa.array([[r[1] for r in rows]], pa.list_(pa.int64())),
                pa.array([[r[2] for r in rows]], pa.list_(pa.int32())), pa.array([[len(r[4]) for r in rows]], pa.list_(pa.int64())), pa.array([[r[3] for r in rows]], pa.list_(pa.bool_())),
                pa.array([tallies.pack(place[first])], pa.binary()), pa.array([known[uses].tobytes()], pa.binary()),
            ]
            return pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in SHARDS.split(", ")])

        def encoded(deleted: bool, rows: list[tuple]) -> Iterator[pa.RecordBatch]:
            if len(rows) == 1 and len(rows[0][3]) > SHARD_BYTES:
                doc, doc_id, part, text = rows[0]
                before, pieces = np.full(lead, START), slices(text, SHARD_BYTES)
                piece, first = next(pieces), True
                while piece is not None:
                    after = next(pieces, None)
                    h = np.concatenate([before, *_hashes([piece]), np.full(int(after is None), END)])
                    yield shard(deleted, [(doc, doc_id, part, first, h)])
                    before, piece, first = h[len(h) - lead :], after, False
            else:
                found = _hashes([text for *_, text in rows])
                yield shard(deleted, [(*r[:3], True, np.concatenate([np.full(lead, START), h, [END]])) for r, h in zip(rows, found, strict=True)])

        held: dict[bool, tuple[list[tuple], int]] = {False: ([], 0), True: ([], 0)}
        for b in batches:
            for doc_id, part, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).cast(pa.binary()), strict=True):
                text, deleted = text.as_py() or b"", part == DELETED_PART
                rows, size = held[deleted]
                if rows and size + len(text) > SHARD_BYTES:
                    yield from encoded(deleted, rows)
                    rows, size = [], 0
                rows.append((next(doc_number), doc_id, part, text))
                held[deleted] = rows, size + len(text)
        for deleted, (rows, _) in held.items():
            if rows:
                yield from encoded(deleted, rows)

    return run


class Shard:
    """A shard's tokens and the keys of its n-grams.

    real: tokens that count here; the others are what stands before the shard's part of a document. For each n below the
    order a key is also asked for at the last of those, as the context of the first token.
    """

    def __init__(self, row: dict, order: int) -> None:
        sizes = np.array(row["sizes"])
        self.order, self.sizes, begin = order, sizes, np.cumsum(sizes) - sizes
        tokens = np.frombuffer(row["known"], np.uint64)[tallies.unpack(row["words"]).astype(np.int64)]
        self.piece = np.repeat(np.arange(len(sizes)), sizes)
        place = np.arange(len(tokens)) - begin[self.piece]
        self.real = place >= order - 1
        edge = place == order - 2
        part = np.array(row["parts"])[self.piece]
        counted = (self.real | edge & np.array(row["begins"], bool)[self.piece]) & (part != TEST_PART)
        self.at: list[np.ndarray] = []  # positions of the n-grams of each length
        self.keys: list[np.ndarray] = []
        self.which: list[np.ndarray] = []  # the number of the key at each position
        self.counts: list[np.ndarray] = []
        chain = np.zeros(len(tokens), np.uint64)
        for n in range(1, order + 1):
            chain = np.concatenate([np.zeros(1, np.uint64), chain[:-1]]) * _BASE + tokens + np.uint64(n)
            chain = _mixed(chain)
            at = np.flatnonzero(self.real | edge) if n < order else np.flatnonzero(self.real)
            keys, which = np.unique(chain[at], return_inverse=True)
            train = counted[at].astype(float)
            self.counts.append(np.stack([np.bincount(which, train, len(keys)), np.bincount(which, train * (part[at] == DELETED_PART), len(keys))], 1).astype(np.int64))
            self.at.append(at)
            self.keys.append(keys)
            self.which.append(which)

    def totals(self, back: pa.Table, deleted: bool, all_tokens: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """For each real token, the total of the n-gram that ends there and of its context, by n; deleted: without that part's."""
        counts, contexts = [], [np.full(int(self.real.sum()), all_tokens)]
        for n in range(1, self.order + 1):
            got = tallies.received(back, n, 2)
            got = got[:, 0] - got[:, 1] if deleted else got[:, 0]
            here = np.zeros(len(self.real), np.int64)
            here[self.at[n - 1]] = got[self.which[n - 1]]
            counts.append(here[self.real])
            if n < self.order:
                contexts.append(here[np.flatnonzero(self.real) - 1])
        return counts, contexts


def buckets(contexts: list[np.ndarray]) -> np.ndarray:
    """Bucket of each token: _LEVEL * length of its longest known context's n-gram + the power of two that its frequency reaches."""
    out = np.zeros(len(contexts[0]), np.int64)
    for n, c in enumerate(contexts, 1):
        out = np.where(c > 0, _LEVEL * n + (np.frexp(c.astype(float))[1] - 1) * (n > 1), out)
    return out


def _send(order: int, parts: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                s = Shard(row, order)
                for n in range(order):
                    yield from tallies.sent(n + 1, row["shard"], s.keys[n], s.counts[n], parts[n])

    return run


def _deleted_tokens(order: int, all_tokens: int):
    """A row for each combination of bucket, counts and contexts of the deleted part's tokens."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["bucket", *(f"{x}{n}" for n in range(1, order + 1) for x in "cx")]
        found = []
        for row in left.to_pylist():
            counts, contexts = Shard(row, order).totals(right, True, all_tokens)
            found.append(np.stack([buckets(contexts), *(x for pair in zip(counts, contexts, strict=True) for x in pair)], 1))
        rows, n = np.unique(np.concatenate(found) if found else np.zeros((0, len(names)), np.int64), axis=0, return_counts=True)
        return pa.table([*(pa.array(c) for c in rows.T), pa.array(n)], [*names, "n"])

    return run


def learned(told: DataFrame, order: int, n_types: int, rounds: int = ROUNDS) -> dict[int, list[float]]:
    """bucket -> weights of the uniform distribution and the 1-grams to order-grams, by expectation-maximisation.

    A token more of every estimate that the bucket has is added in each round, so that no weight becomes nothing.
    """
    estimates = [F.lit(1.0 / (n_types + 1)), *(F.when(F.col(f"x{n}") > 0, F.col(f"c{n}") / F.col(f"x{n}")).otherwise(0.0) for n in range(1, order + 1))]
    told = written(told.select("bucket", "n", *(e.alias(f"f{k}") for k, e in enumerate(estimates))).groupBy("bucket", *(f"f{k}" for k in range(order + 1))).agg(F.sum("n").alias("n")))
    weights = {b: [1.0 / (b // _LEVEL + 1) if k <= b // _LEVEL else 0.0 for k in range(order + 1)] for (b,) in told.select("bucket").distinct().collect()}
    for _ in range(rounds if weights else 0):
        table = [F.array(*[F.lit(weights.get(b, [0.0] * (order + 1))[k]) for b in range(max(weights) + 1)]) for k in range(order + 1)]
        shares = [F.get(table[k], F.col("bucket").cast("int")) * F.col(f"f{k}") for k in range(order + 1)]
        whole = sum(shares[1:], shares[0])
        sums = told.groupBy("bucket").agg(*(F.sum(F.col("n") * s / whole).alias(f"s{k}") for k, s in enumerate(shares))).collect()  # a row per bucket
        moved = 0.0
        for row in sums:
            used = row["bucket"] // _LEVEL + 1
            got = [row[f"s{k}"] + 1.0 if k < used else 0.0 for k in range(order + 1)]
            new = [g / sum(got) for g in got]
            moved = max(moved, *(abs(a - b) for a, b in zip(new, weights[row["bucket"]], strict=True)))
            weights[row["bucket"]] = new
        if moved < STILL:
            break
    return weights


def _weight_table(weights: dict[int, list[float]], order: int) -> np.ndarray:
    """Weights of every bucket; one that was not met has those of the nearest of its length, or equal ones."""
    out = np.zeros((_LEVEL * (order + 2), order + 1))
    for b in range(len(out)):
        level = min(b // _LEVEL, order)
        near = min((x for x in weights if x // _LEVEL == level), key=lambda x: (abs(x - b), x), default=None)
        out[b] = weights[near] if near is not None else [1.0 / (level + 1) if k <= level else 0.0 for k in range(order + 1)]
    return out


def _scores(order: int, all_tokens: int, n_types: int, weights: np.ndarray):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list] = [[] for _ in range(7)]
        for row in left.to_pylist():
            s = Shard(row, order)
            counts, contexts = s.totals(right, False, all_tokens)
            w = weights[buckets(contexts)]
            p = w[:, 0] / (n_types + 1)
            for n, (c, x) in enumerate(zip(counts, contexts, strict=True), 1):
                p += w[:, n] * np.divide(c, x, out=np.zeros(len(c)), where=x > 0)
            base = np.log10((counts[0] + ADDED) / (all_tokens + ADDED * (n_types + 1)))
            piece, n = s.piece[s.real], len(s.sizes)
            sums = [np.bincount(piece, minlength=n), np.bincount(piece, counts[0] > 0, n).astype(np.int64), np.bincount(piece, base, n), np.bincount(piece, np.log10(p), n)]
            for column, values in zip(out, [row["docs"], row["doc_ids"], row["parts"], *(x.tolist() for x in sums)], strict=True):
                column.extend(values)
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        return pa.table([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], [x.split()[0] for x in SCORED.split(", ")])

    return run


def score(docs: DataFrame, order: int = ORDER, rounds: int = ROUNDS) -> DataFrame:
    """docs(doc_id, text) to (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), a row for each row.

    Learned from all documents but those whose crc32(doc_id as text) is divisible by OF_PARTS, which are held out. Null and
    empty texts have the end token only; a null id counts as an empty text, so it is held out; repeated rows and ids count
    each. Without training documents every token is unknown: all scores are 0. An empty table gives no rows; other columns
    are not read, whatever their names.
    """
    shards = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), part_of(F.col("doc_id")).alias("part"), "text").mapInArrow(_encode(order), SHARDS))
    each = F.arrays_zip("parts", "sizes")
    of = lambda keep: F.aggregate(F.filter(each, keep), F.lit(0).cast("long"), lambda a, x: a + x["sizes"] - (order - 1))
    parts_here = {"train": lambda x: x["parts"] != TEST_PART, "deleted": lambda x: x["parts"] == DELETED_PART, "all": lambda x: F.lit(True)}
    train, deleted, every = (int(v or 0) for v in shards.select(*(of(keep).alias(name) for name, keep in parts_here.items())).agg(*map(F.sum, parts_here)).first())
    parts = [tallies.parts_for(every)] * order
    back = written(tallies.answered(shards.mapInArrow(_send(order, parts), tallies.SENT), tallies.summed))
    sums = back.filter("kind = 1 AND size(told) > 0").agg(F.sum(F.get("told", F.lit(0))), F.sum(F.get("told", F.lit(1)))).first()
    edge = int(order > 1)  # what stands before a text is asked for as a context, but is no token
    types, types_left = (max(0, int(n or 0) - edge) for n in sums)
    tuples = ", ".join(["bucket long", *(f"{x}{n} long" for n in range(1, order + 1) for x in "cx"), "n long"])
    told = tallies.together(shards.filter("deleted"), back.filter("shard % 2 = 1"), _deleted_tokens(order, train - deleted), tuples)
    weights = _weight_table(learned(told, order, types_left, rounds), order)
    scored = tallies.together(shards, back, _scores(order, train, types, weights), SCORED)
    sums = [F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base_score", "score")]
    whole = scored.groupBy("doc", "doc_id", "part").agg(*sums)
    return whole.select("doc_id", (F.col("part") == TEST_PART).alias("held_out"), "n_tokens", "n_known", F.lit(train).cast("long").alias("train_tokens"), "base_score", "score")
