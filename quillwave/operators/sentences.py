"""Sentences and chunks: splits, and groups of the sentences of a text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import folds
from ..functions import rules as R
from ..functions.text import count_words, strip


def sentence_array(text: Column, ends: str = ".!?") -> Column:
    return F.filter(F.split(strip(text), rf"(?U)(?<=[{ends}])\s+"), lambda s: strip(s) != "")


def split_sentences(docs: DataFrame, ends: str = ".!?") -> DataFrame:
    """docs(doc_id, text): a row per sentence; the second policy also ends at `…`."""
    return docs.select("doc_id", F.posexplode(sentence_array(F.col("text"), ends)).alias("sent_no", "sentence"))


def merge_short_sentences(sentences: Column) -> Column:
    """A sentence of fewer than 4 words is carried into the next, what is left over joins the last.

    The last sentence stands alone even if short, but only if nothing was carried into it. A single sentence is left as it is.
    """
    return folds.carried_groups(folds.told(sentences, count_words), R.SHORT_SENTENCE)["text"]


def estimate_tokens(text: Column) -> Column:
    return F.floor(count_words(text) * F.lit(R.TOKENS_PER_WORD)).cast("int")


def chunk_by_tokens(sentences: Column, most: int = R.CHUNK_TOKENS, ceiling: int = R.CEILING_TOKENS) -> Column:
    """Greedy packing to `most` tokens; a sentence above `ceiling` ends the chunk and is cut every ceiling / 1.3 words."""
    cut = int(ceiling / R.TOKENS_PER_WORD)

    def pieces(s: Column) -> Column:
        words = F.filter(F.split(s, r"(?U)\s+"), lambda w: w != "")
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(words) - 1) / cut).cast("int")), lambda i: F.array_join(F.slice(words, i * cut + 1, cut), " "))

    groups = folds.packed_groups(folds.told(sentences, estimate_tokens), most, 0, ceiling)
    return F.flatten(F.transform(groups, lambda g: F.when(g["cut"], pieces(g["text"])).otherwise(F.array(g["text"]))))


def chunk_by_chars(text: Column, most: int = R.CHUNK_CHARS, full_stop: bool = True) -> Column:
    """Greedy packing of sentences to `most` characters; with `full_stop` every chunk ends in punctuation. Long sentences stay whole."""
    close = lambda t: F.when(F.lit(full_stop) & (t != "") & ~t.rlike(r"[.!?…]\z"), F.concat(t, F.lit("."))).otherwise(t)
    body = close(strip(text))
    sentences = F.split(body, r"(?U)(?<=[.!?…])\s+")
    groups = folds.packed_groups(folds.told(sentences, F.length), most, 1)
    return F.transform(groups, lambda g: close(strip(g["text"])))


def annotate_speed(sentence: Column, base_speed: Column | float = 0.9) -> Column:
    """Slower for short sentences, questions and trailing ellipses, in this order; never below 0.65."""
    base = F.lit(base_speed) if isinstance(base_speed, float) else base_speed
    s = strip(sentence)
    factor = F.when(count_words(s) < 6, 0.88).when(s.endswith("?"), 0.95).when(s.endswith("...") | s.endswith("…"), 0.92).otherwise(1.0)
    return F.greatest(base * factor, F.lit(R.LEAST_SPEED))
