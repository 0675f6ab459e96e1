"""The corpus pipeline: language ID, near duplicates, decontamination, mixing, token records.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame; it is written as Parquet and read again as the next one's docs.
All stages but the last keep the columns of documents, extra ones included.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillwave.llm import binary_records, decontam, langid, mixing, simhash
from quillwave.llm.common import shared_dir, written
from quillwave.llm.queries import tokenizer_file
from quillwave.session import table

#: A document is rejected if its language is not known: no letters, or a share of known n-grams below this.
LEAST_SCORE = 0.1
ORACLE_SQL = None  # learned language filters and tokens are beyond SQL; tests compare with brute force


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known; null texts and texts without letters go. Learned from the stage's own input."""
    return langid.keep_identified(docs, LEAST_SCORE)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates: the one with the smallest id."""
    return simhash.deduplicate(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix takes them: sources at their targets, up to three times a document."""
    return mixing.mix(docs)


def records(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token records of all rows in ascending doc_id order, written and read back: doc_id, start, n_tokens, ids_crc32."""
    path = shared_dir(spark)
    binary_records.write_records(docs, path, tokenizer_file(), end_id=1, words_apart=True)
    index = binary_records.write_index(spark, path, f"{path}-index")
    return index.select("doc_id", "start", "n_tokens", "ids_crc32")


STAGES = [
    ("language_id", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontaminate),
    ("mixing", mixture),
    ("token_records", records),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result but the last is written before the next stage reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = written(docs)
    return docs
