"""Benchmark decontamination with suffix arrays of the training texts.

Each task turns its documents, a few MB at a time, into a shard: word numbers of all texts in a row, and the suffix array
of the positions at which a test suffix can match at all (the array is sparse: the first words there occur at the start of
a test suffix). Every test suffix is looked up in the shard by binary search; the range found holds all its occurrences.
The array is sorted WINDOW words deep, which is all that a hit needs; runs of occurrences on one diagonal give the longest
verbatim match of a document and an item, with its place in both.

A window that many items share is found once per position; the items stand in a set per distinct combination, and a document
names the sets it holds. So a passage common to all items costs a document its own length, not that times the items.

The tests are broadcast up to a checked size; larger benchmarks go in blocks of that size, one pass over the texts each. An
item longer than a block is a block of its own.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices, written

WINDOW = 10
#: Words at a suffix's start that decide whether it enters the suffix array.
STEM = 3
SHARD_BYTES = 2_000_000
#: Text of test items that one broadcast may hold; its windows take some twenty times as much on the driver and in a worker.
BLOCK_BYTES = 4_000_000

HITS = "n_words long, hits array<struct<lo:int,hi:int>>"
FOUND = HITS + ", matches array<struct<item_id:long,words:int,doc_word:int,item_word:int>>"
#: What a search tells of a text: its hits, and the longest match of each item, or the items' number and digest, or the sets of items.
KINDS = {"hits": HITS, "matches": FOUND, "items": HITS + ", n_items long, items_sha256 string", "sets": HITS + ", sets array<long>"}
#: Digests of combinations of sets that a task remembers.
REMEMBERED = 10_000

#: Bytes to the word rule [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after A-Z became a-z: what is no word byte is a space.
WORD_BYTES = bytes(c if c >= 0x80 or chr(c).isalnum() else 32 for c in (ord(chr(b).lower()) if b < 0x80 else b for b in range(256)))


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(WORD_BYTES).split() if text else []


@dataclass
class Tests:
    """Test suffixes by the number of words that must match: sorted distinct keys, and the (item, word) places of each key."""

    numbers: dict[bytes, int] = field(default_factory=dict)
    ids: list = field(default_factory=list)
    groups: list = field(default_factory=list)
    #: Items (their numbers) by set, for the sets of several; a number below len(ids) is the set of that item alone.
    sets: list = field(default_factory=list)
    set_of: list = field(default_factory=list)

    @classmethod
    def of(cls, items: list[tuple[int | None, bytes | None]], window: int = WINDOW) -> Tests:
        made = cls()
        texts: list[np.ndarray] = []
        for item_id, text in items:
            texts.append(np.fromiter((made.numbers.setdefault(w, len(made.numbers) + 1) for w in words_of(text)), np.int32))
            made.ids.append(item_id)
        counts = np.fromiter(map(len, texts), np.int64, len(texts))
        known: dict[bytes, int] = {}
        flat, starts, depth = np.concatenate([np.zeros(0, np.int32), *texts]), np.cumsum(counts) - counts, np.minimum(counts, window)
        for n in np.unique(depth[depth > 0]).tolist():
            own = np.flatnonzero(depth == n)
            many = counts[own] - n + 1
            item = np.repeat(own, many)
            at = _ragged(starts[own], many)
            windows = flat[at[:, None] + np.arange(n)]
            keys, inverse = np.unique(as_keys(windows), return_inverse=True)
            order = np.argsort(inverse, kind="stable")
            place = np.stack([item, at - starts[item]], 1).astype(np.int32)[order]
            stems = np.zeros(1 << 22, bool)
            stems[stem_hash(*(windows[:, i] for i in range(min(n, STEM))))] = True
            bounds = np.searchsorted(inverse[order], np.arange(len(keys) + 1))
            made.groups.append((n, keys, bounds, place, stems))
            made.set_of.append(made._sets(place[:, 0], bounds, known))
        return made

    def _sets(self, items: np.ndarray, bounds: np.ndarray, known: dict[bytes, int]) -> np.ndarray:
        """The set of each key's items, which stand together in ascending order, repeats included."""
        of = items[bounds[:-1]].astype(np.int32)
        for k in np.flatnonzero(of != items[bounds[1:] - 1]).tolist():
            own = np.unique(items[bounds[k] : bounds[k + 1]])
            of[k] = known.setdefault(own.tobytes(), len(self.ids) + len(known))
            if of[k] == len(self.ids) + len(self.sets):
                self.sets.append(own)
        return of

    def items_of(self, sets) -> set:
        """The ids of the items in the sets."""
        n = len(self.ids)
        return {self.ids[i] for k in sets for i in ([k] if k < n else self.sets[k - n])}


def as_keys(windows: np.ndarray) -> np.ndarray:
    """Rows of word numbers as byte strings that sort alike."""
    return np.ascontiguousarray(windows.astype(">u4")).view(f"S{4 * windows.shape[1]}").ravel()


def stem_hash(*columns: np.ndarray) -> np.ndarray:
    h = np.zeros(len(columns[0]), np.uint64)
    for c in columns:
        h = (h ^ c.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return (h & np.uint64((1 << 22) - 1)).astype(np.int64)


def _ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """All of range(start, start + count), one after the other."""
    ends = np.cumsum(counts)
    return np.repeat(starts - ends + counts, counts) + np.arange(ends[-1] if len(ends) else 0)


def found_windows(numbers: np.ndarray, tests: Tests) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(group, positions, keys) of every occurrence of a test window in the shard's word numbers, a row per position and group."""
    out = []
    for g, (n, keys, _, _, stems) in enumerate(tests.groups):
        last = len(numbers) - n + 1
        if last <= 0:
            continue
        first = [numbers[i : last + i] for i in range(min(n, STEM))]
        at = np.flatnonzero(stems[stem_hash(*first)] & (first[0] > 0))
        if not len(at):
            continue
        suffixes = as_keys(numbers[at[:, None] + np.arange(n)])
        order = np.argsort(suffixes, kind="stable")
        suffixes, at = suffixes[order], at[order]
        lo, hi = np.searchsorted(suffixes, keys, "left"), np.searchsorted(suffixes, keys, "right")
        hit = np.flatnonzero(hi > lo)
        out.append((g, at[_ragged(lo[hit], (hi - lo)[hit])], np.repeat(hit, (hi - lo)[hit])))
    return out


def occurrences(numbers: np.ndarray, tests: Tests) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(position, item, word in the item, length) of every occurrence, a row per place of the window in an item."""
    out = []
    for g, position, which in found_windows(numbers, tests):
        n, _, bounds, place, _ = tests.groups[g]
        times = (bounds[1:] - bounds[:-1])[which]
        rows = place[_ragged(bounds[:-1][which], times)]
        out.append((np.repeat(position, times), rows[:, 0], rows[:, 1], np.full(len(rows), n)))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 4


def sets_found(numbers: np.ndarray, tests: Tests) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(position, set of items, length) of every occurrence, a row per position and length."""
    out = [(position, tests.set_of[g][which], np.full(len(which), tests.groups[g][0])) for g, position, which in found_windows(numbers, tests)]
    return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3


def _one_shard(texts: list[bytes | None], tests: Tests, kind: str = "matches", first_set: int = 0, digests: dict | None = None) -> Iterator[dict]:
    get = tests.numbers.get
    lists: list[np.ndarray] = []
    counts = np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        for piece in slices(text or b"", SHARD_BYTES):  # white space always ends a word
            words = words_of(piece)
            lists.append(np.fromiter(map(get, words, itertools.repeat(0)), np.int32, len(words)))
            counts[i] += len(words)
        lists.append(np.zeros(1, np.int32))  # a 0, which no test has, ends each text
    numbers = np.concatenate(lists)
    starts = np.cumsum(counts + 1) - counts - 1
    if kind != "matches":
        yield from _without_places(*sets_found(numbers, tests), starts, counts, tests, kind, first_set, {} if digests is None else digests)
        return
    position, item, word, length = occurrences(numbers, tests)
    doc = np.searchsorted(starts, position, "right") - 1
    order = np.lexsort((position, position - word, item, doc))
    position, item, word, length, doc = (x[order] for x in (position, item, word, length, doc))
    bounds = np.searchsorted(doc, np.arange(len(texts) + 1))
    for d in range(len(texts)):
        a, b = bounds[d], bounds[d + 1]
        if a == b:
            yield {"n_words": int(counts[d]), "hits": [], "matches": []}
            continue
        p, i, w, n = position[a:b] - starts[d], item[a:b], word[a:b], length[a:b]
        new = np.r_[True, (i[1:] != i[:-1]) | (p[1:] - w[1:] != p[:-1] - w[:-1]) | (p[1:] != p[:-1] + 1)]
        first, last = np.flatnonzero(new), np.r_[np.flatnonzero(new)[1:], len(new)] - 1
        words_run = p[last] - p[first] + n[first]
        best = np.lexsort((w[first], p[first], -words_run, i[first]))
        best = best[np.r_[True, i[first][best][1:] != i[first][best][:-1]]]
        matches = [{"item_id": tests.ids[i[first[r]]], "words": int(words_run[r]), "doc_word": int(p[first[r]]), "item_word": int(w[first[r]])} for r in best]
        yield {"n_words": int(counts[d]), "hits": _intervals(p, n, int(counts[d])), "matches": matches}


def _intervals(p: np.ndarray, n: np.ndarray, words: int) -> list[dict]:
    """Intervals [lo, hi) of the words that windows of n words at p cover."""
    mask = np.zeros(words + 2, np.int64)
    np.add.at(mask, p + 1, 1)
    np.add.at(mask, p + n + 1, -1)
    on = np.diff(np.r_[0, (np.cumsum(mask)[1:] > 0).astype(np.int8), 0])
    return [{"lo": int(x), "hi": int(y)} for x, y in zip(np.flatnonzero(on > 0), np.flatnonzero(on < 0), strict=True)]


def _without_places(position, owner, length, starts, counts, tests: Tests, kind: str, first_set: int, digests: dict) -> Iterator[dict]:
    doc = np.searchsorted(starts, position, "right") - 1
    order = np.argsort(doc, kind="stable")
    position, owner, length = position[order], owner[order], length[order]
    bounds = np.searchsorted(doc[order], np.arange(len(starts) + 1))
    for d in range(len(starts)):
        a, b = bounds[d], bounds[d + 1]
        row = {"n_words": int(counts[d]), "hits": _intervals(position[a:b] - starts[d], length[a:b], int(counts[d])) if b > a else []}
        own = np.unique(owner[a:b])
        if kind == "sets":
            row["sets"] = (own.astype(np.int64) + first_set).tolist()
        elif kind == "items":
            if len(digests) >= REMEMBERED:
                digests.clear()
            known = own.astype(np.int32).tobytes()
            if known not in digests:
                ids = tests.items_of(own.tolist())
                digests[known] = len(ids), hashlib.sha256(",".join(sorted(str(i) for i in ids if i is not None)).encode()).hexdigest()
            row["n_items"], row["items_sha256"] = digests[known]
        yield row


def matcher(tests_of, kind: str = "matches", first_set: int = 0):
    """An Arrow UDF text -> KINDS[kind]. tests_of() gives the Tests in a task; sets of items are numbered from first_set."""
    last = {
        "hits": [], "items": [("n_items", pa.int64()), ("items_sha256", pa.string())], "sets": [("sets", pa.list_(pa.int64()))],
        "matches": [("matches", pa.list_(pa.struct([("item_id", pa.int64()), ("words", pa.int32()), ("doc_word", pa.int32()), ("item_word", pa.int32())])))],
    }[kind]
    schema = pa.struct([("n_words", pa.int64()), ("hits", pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))), *last])

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tests = tests_of()
        digests: dict = {}
        for b in batches:
            out: list[dict] = []
            group: list[bytes | None] = []
            size = 0
            for t in itertools.chain(b.cast(pa.binary()), (False,)):
                t = t and t.as_py()
                if group and (t is False or size + len(t or b"") > SHARD_BYTES):
                    out += _one_shard(group, tests, kind, first_set, digests)
                    group, size = [], 0
                if t is not False:
                    group.append(t)
                    size += len(t or b"")
            yield pa.array(out, schema)

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, KINDS[kind])


def _tests(items: DataFrame, window: int) -> Tests:
    return Tests.of([(r[0], r[1].encode() if r[1] is not None else None) for r in items.collect()], window)


def _udf(docs: DataFrame, tests: Tests, kind: str, first_set: int = 0):
    shared = docs.sparkSession.sparkContext.broadcast(tests)
    return matcher(lambda: shared.value, kind, first_set)


def _blocks(benchmark: DataFrame, block_bytes: int) -> tuple[DataFrame, int]:
    """(distinct items, number of blocks): repeated items are one before blocks are dealt."""
    items = benchmark.select("item_id", "text").distinct()
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-size // block_bytes))
    return (items if blocks == 1 else written(items)), blocks


def free_name(df: DataFrame, name: str) -> str:
    """A column name that `df` does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def with_matches(docs: DataFrame, benchmark: DataFrame, text: str = "text", window: int = WINDOW, name: str = "found", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs with the column `name` (FOUND): words of the text, hit intervals [lo, hi), and the longest match of each item.

    A window is `window` consecutive words of an item; an item of fewer, but not none, is one window. Null and empty texts
    have no words; a null item_id stays null in the matches. Items equal but for their ids all match, repeated rows once.
    Repeated documents get equal results. Texts of any length are searched whole. Empty tables give no rows, or no hits. Extra
    columns of `docs` stay as they are. An entry per document and item: where many items share passages, take `report`.
    """
    items, blocks = _blocks(benchmark, block_bytes)
    return _searched(docs, items, blocks, text, window, name, "matches")[0]


def _searched(docs: DataFrame, items: DataFrame, blocks: int, text: str, window: int, name: str, kind: str) -> tuple[DataFrame, DataFrame | None]:
    """docs with the column `name` (KINDS[kind]), and for kind "sets" the table (set, item_id)."""
    spark = docs.sparkSession
    if blocks == 1 and kind != "sets":
        return docs.withColumn(name, _udf(docs, _tests(items, window), kind)(docs[text])), None
    h, n, m = (free_name(docs, c) for c in ("__h", "__n", "__m"))
    keys = {h: F.xxhash64(docs[text]), n: F.octet_length(docs[text]), m: F.md5(docs[text].cast("binary"))}
    texts = docs.select(*[c.alias(k) for k, c in keys.items()], docs[text].alias("t"))
    passes, members = [], []
    for k in range(blocks):
        tests = _tests(items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k), window)
        passes.append(written(texts.select(h, n, m, _udf(docs, tests, kind, k << 32)(F.col("t")).alias("f")).dropDuplicates([h, n, m])))
        if kind == "sets":
            rows = [((k << 32) + i, [item]) for i, item in enumerate(tests.ids)] + [((k << 32) + len(tests.ids) + i, [tests.ids[x] for x in own]) for i, own in enumerate(tests.sets)]
            members.append(written(spark.createDataFrame(rows, "set long, items array<long>")))
    rows = passes[0]
    for p in passes[1:]:
        rows = rows.unionByName(p)
    more = {"matches": ["matches"], "sets": ["sets"], "hits": []}[kind]
    merged = rows.groupBy(h, n, m).agg(F.first("f.n_words").alias("n_words"), F.array_sort(F.flatten(F.collect_list("f.hits"))).alias("hits"), *[F.flatten(F.collect_list(f"f.{c}")).alias(c) for c in more])
    start = F.expr("cast(array() as array<struct<lo:int,hi:int>>)")
    union = F.aggregate("hits", start, lambda a, x: F.when((F.size(a) > 0) & (F.element_at(a, -1)["hi"] >= x["lo"]), F.concat(F.slice(a, 1, F.size(a) - 1), F.array(F.struct(F.element_at(a, -1)["lo"].alias("lo"), F.greatest(F.element_at(a, -1)["hi"], x["hi"]).alias("hi"))))).otherwise(F.concat(a, F.array(x))))
    merged = merged.select(h, n, m, F.struct("n_words", union.alias("hits"), *more).alias("found"))
    joined = docs.withColumns(keys).alias("d").join(merged.alias("f"), [F.col(f"d.{c}").eqNullSafe(F.col(f"f.{c}")) for c in (h, n, m)])
    joined = joined.select(*[F.col(f"d.{c}") for c in docs.columns], F.col("f.found").alias(name))
    for p in members[1:]:
        members[0] = members[0].unionByName(p)
    return joined, members[0] if members else None


def hit_words(found: Column) -> Column:
    return F.aggregate(found["hits"], F.lit(0).cast("long"), lambda a, x: a + x["hi"] - x["lo"])


def report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    Nulls, repeats and empty tables as in `with_matches`; a null item_id counts, but has no name. The items of a combination of
    sets are named once, whatever number of documents hold it.
    """
    items, blocks = _blocks(benchmark, block_bytes)
    rows, members = _searched(docs.select("doc_id", "text"), items, blocks, "text", window, "found", "items" if blocks == 1 else "sets")
    if members is not None:
        rows = written(rows.select("doc_id", "found", F.array_sort("found.sets").alias("all")))
        named = rows.select("all").distinct().withColumn("set", F.explode("all")).join(members, "set").select("all", F.explode("items").alias("item")).distinct()
        named = named.groupBy("all").agg(F.count(F.lit(1)).alias("n_items"), F.array_join(F.array_sort(F.collect_list(F.col("item").cast("string"))), ",").alias("names"))
        rows = rows.join(named, "all", "left").withColumn("found", F.struct("found.n_words", "found.hits", F.coalesce("n_items", F.lit(0)).alias("n_items"), F.sha2(F.coalesce("names", F.lit("")), 256).alias("items_sha256")))
    n_hit = hit_words(F.col("found"))
    return rows.select("doc_id", "found.n_words", n_hit.alias("n_hit"), "found.n_items", "found.items_sha256", (n_hit > 0).alias("contaminated"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of `docs`, all columns, without the documents that hold a test window.

    Null and empty texts hold none and stay; repeated documents stay or go together; an empty benchmark removes nothing, an
    empty `docs` stays empty. Only hits are looked for, no items.
    """
    items, blocks = _blocks(benchmark, block_bytes)
    name = free_name(docs, "__found")
    rows = _searched(docs, items, blocks, "text", window, name, "hits")[0]
    return rows.filter(F.size(F.col(name)["hits"]) == 0).drop(name)
