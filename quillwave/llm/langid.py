"""Language identification with a bit-sliced Bloom filter over n-grams.

The filter has a row of language bits per slot. An n-gram sets its language's bit in K slots; the AND of its K rows is the
set of languages that may contain it, all of them found by one lookup. A text's n-grams are looked up, the bits are counted
per language, the share that chance would give (the language's fill, to the power K) is taken off, and the largest
corrected share decides.

An n-gram belongs to every language in which its rate is at least RATE, so a language has at most 1 / RATE n-grams whatever
the size of the corpus. Counts cover all learning documents: tasks count, Spark adds up.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, written

#: Bytes in an n-gram, words kept apart by one space.
ORDERS = (3, 4, 5)
RATE = 5e-6
K = 3
#: Slots for each n-gram that the filter holds.
SLOTS_PER_GRAM = 12
UNKNOWN = "und"
#: N-grams of a long text are made for so many places at a time.
PLACES = 250_000

RESULT = "lang_pred string, score double"

_SPACES = bytes(b if b >= 0x80 or chr(b).isalpha() else 32 for b in range(256))


def normal(text: str) -> bytes:
    """Lower-case letters in UTF-8 with single spaces between and around the words; ASCII that is no letter is space."""
    return b" " + b" ".join(text.lower().encode("utf-8", "replace").translate(_SPACES).split()) + b" "


def has_letters(text: str) -> bool:
    return any(map(str.isalpha, text)) if text else False


def grams(data: bytes, places: int | None = None) -> Iterator[np.ndarray]:
    """64-bit codes of all n-grams of the bytes, those that begin at `places` (PLACES) bytes at a time; the order is part of the code.

    Every n-gram comes once, also where it reaches over the end of its part.
    """
    x, places = np.frombuffer(data, np.uint8), places or PLACES
    for at in range(0, len(x), places):
        part = x[at : at + places + max(ORDERS) - 1].astype(np.uint64)
        out = []
        for n in ORDERS:
            count = min(places, len(part) - n + 1)
            if count > 0:
                code = np.full(count, n, np.uint64)
                for i in range(n):
                    code = code << np.uint64(8) | part[i : count + i]
                out.append(code)
        if out:
            yield np.concatenate(out)


def slots(codes: np.ndarray, size: int, k: int = K) -> list[np.ndarray]:
    """k slots per code in a filter of `size` (a power of two) slots."""
    h = codes * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    step = (h >> np.uint64(40)) | np.uint64(1)
    return [((h + step * np.uint64(i)) & np.uint64(size - 1)).astype(np.int64) for i in range(k)]


@dataclass
class LanguageFilter:
    languages: list[str]
    rows: np.ndarray
    chance: np.ndarray

    @classmethod
    def of(cls, languages: list[str], codes: list[np.ndarray]) -> LanguageFilter:
        """codes: the n-grams of each language. The filter's fill, measured after building, gives the chance of a false hit."""
        size = 1 << max(12, int(np.ceil(np.log2(max(1, SLOTS_PER_GRAM * max([len(c) for c in codes], default=1))))))
        kind, bits = (np.uint8, 8) if len(languages) <= 8 else (np.uint64, 64)
        rows = np.zeros((size, -(-max(1, len(languages)) // bits)), kind)
        for i, c in enumerate(codes):
            for s in slots(c, size):
                rows[s, i // bits] |= kind(1 << (i % bits))
        fill = np.array([(rows[:, i // bits] >> kind(i % bits) & kind(1)).mean() for i in range(len(languages))])
        return cls(languages, rows, fill**K)

    def hits(self, codes: np.ndarray) -> np.ndarray:
        """Number of the n-grams found for each language."""
        n = len(self.languages)
        if n <= 8:  # the bit sets fit a byte: one table of counts
            found = np.bitwise_and.reduce([self.rows[s, 0] for s in slots(codes, len(self.rows))])
            sets = np.bincount(found, minlength=256)
            return self.members @ sets
        found = np.bitwise_and.reduce([self.rows[s] for s in slots(codes, len(self.rows))])
        return np.array([int((found[:, i // 64] >> np.uint64(i % 64) & np.uint64(1)).sum()) for i in range(n)])

    def __post_init__(self) -> None:
        self.members = np.array([[s >> i & 1 for s in range(256)] for i in range(min(8, len(self.languages)))])

    def predict(self, text: str | None) -> tuple[str, float]:
        """(language, corrected share of the text's n-grams that it holds); ("und", 0) without letters."""
        if not self.languages or not has_letters(text):
            return UNKNOWN, 0.0
        total, counts = 0, np.zeros(len(self.languages))
        for codes in grams(normal(text)):
            total += len(codes)
            counts += self.hits(codes)
        if not total:
            return self.languages[0], 0.0
        share = (counts / total - self.chance) / np.maximum(1e-9, 1 - self.chance)
        best = int(np.argmax(share))
        return self.languages[best], float(min(1.0, max(0.0, share[best])))


def learns(doc_id: Column) -> Column:
    """Whether a document may be learned from: crc32 of its id as text, mod 3, is not 1. A null id counts as the text ''."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 != 1


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, gram, n) of a task's documents: counts per language, merged and given out when they are many."""
    held: dict[str, list] = {}
    size = 0
    waiting: dict[str, list[np.ndarray]] = {}
    waits = 0

    def merge() -> None:
        nonlocal size, waits
        for lang, parts in waiting.items():
            codes, n = np.unique(np.concatenate(parts), return_counts=True)
            if lang in held:  # two sorted runs: the stable sort only merges them
                codes, n = np.concatenate([held[lang][0], codes]), np.concatenate([held[lang][1], n])
                order = np.argsort(codes, kind="stable")
                codes, n = codes[order], n[order]
                first = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
                codes, n = codes[first], np.add.reduceat(n, first)
            held[lang] = [codes, n]
        waiting.clear()
        waits, size = 0, sum(len(h[0]) for h in held.values())

    def give() -> Iterator[pa.RecordBatch]:
        for lang, (codes, n) in held.items():
            for at in range(0, len(codes), 100_000):
                c = codes[at : at + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(c)), pa.array(c.view(np.int64)), pa.array(n[at : at + 100_000], pa.int64())], ["lang", "gram", "n"])
        held.clear()

    for b in batches:
        for text, lang in zip(b.column(0), b.column(1), strict=True):
            for codes in grams(normal(text.as_py())):
                waiting.setdefault(lang.as_py(), []).append(codes)
                waits += len(codes)
                if waits > 2_000_000:
                    merge()
                    if size > 2_000_000:
                        yield from give()
    merge()
    yield from give()


def fit(docs: DataFrame) -> LanguageFilter:
    """Learns from text and lang of docs(doc_id, text, lang); rows with a null text or lang, and held-out ids, teach nothing.

    What comes to the driver are the chosen n-grams: at most 1 / RATE per language, whatever the corpus.
    """
    taught = docs.filter(learns(F.col("doc_id")) & F.col("text").isNotNull() & F.col("lang").isNotNull())
    counts = taught.select("text", "lang").mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counts = written(counts)
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    totals = written(totals)
    rows = counts.join(broadcast_if_small(totals), "lang").filter(F.col("n") >= RATE * F.col("total")).select("lang", "gram").toArrow()
    languages = sorted(r["lang"] for r in totals.select("lang").collect())
    lang, gram = np.array(rows.column("lang").to_pylist(), dtype=object), rows.column("gram").to_numpy().view(np.uint64)
    return LanguageFilter.of(languages, [np.sort(gram[lang == x]) for x in languages])


def predictor(docs: DataFrame, model: LanguageFilter):
    """An Arrow UDF text -> struct(lang_pred, score)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = pa.struct([("lang_pred", pa.string()), ("score", pa.float64())])

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            said = [shared.value.predict(t.as_py()) for t in b]
            yield pa.array([{"lang_pred": x, "score": y} for x, y in said], schema)

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, RESULT)


def identify(docs: DataFrame, model: LanguageFilter | None = None) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score. Predictions use the text alone.

    Null texts and texts without letters are `und` with score 0; so is everything if nothing can be learned. Ties go to the
    first language by name. Repeated rows get equal results; texts of any length count whole; an empty table gives no rows;
    other columns are not read.
    """
    model = model or fit(docs)
    rows = docs.select("doc_id", "text").withColumn("said", predictor(docs, model)(F.col("text")))
    return rows.select("doc_id", (~learns(F.col("doc_id"))).alias("held_out"), F.col("said.lang_pred").alias("lang_pred"), F.col("said.score").alias("score"))


def keep_identified(docs: DataFrame, least_score: float = 0.0, languages: tuple[str, ...] | None = None, model: LanguageFilter | None = None) -> DataFrame:
    """The rows of `docs`, all columns, whose language is known with at least `least_score`, and is one of `languages` if they are given.

    Rows with null texts or texts without letters go; null ids stay and may teach; repeated rows are kept or go together. If
    nothing can be learned (no rows with text and lang), only texts without letters go. An empty table gives no rows.
    """
    model = model or fit(docs)
    if not model.languages:  # nothing to learn from: only texts without letters are rejected
        return docs.filter(docs["text"].rlike(r"\p{L}"))
    said = F.col("__said_lang")
    wanted = (said["lang_pred"] != UNKNOWN) & (said["score"] >= least_score)
    if languages:
        wanted &= said["lang_pred"].isin(*languages)
    return docs.withColumn("__said_lang", predictor(docs, model)(docs["text"])).filter(wanted).drop("__said_lang")
