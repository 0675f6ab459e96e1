"""Folds over arrays: slices of a batch give what whole batches give, and what Python holds does not grow with the batch."""

import tracemalloc

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillwave.functions import folds
from quillwave.functions import text as X
from quillwave.operators import sentences as N

TEXTS = [None, "", "one two. Three, four five six seven. Eight! nine", "word " * 30 + "and more. " * 40, "é. " * 50, None, "a b c d e f g h i j k l m and n. o"] * 40


@pytest.mark.parametrize(
    "rule",
    [X.prosody_rules, X.break_breath_groups, X.break_long_clauses, lambda t: N.merge_short_sentences(N.sentence_array(t)), lambda t: N.chunk_by_tokens(N.sentence_array(t), 20, 30), N.chunk_by_chars],
    ids=["prosody", "breaths", "clauses", "merge", "tokens", "chars"],
)
def test_slices_give_what_each_text_alone_gives(spark, rule):
    made = lambda rows, n: {r["i"]: r["x"] for r in spark.createDataFrame(rows, "i int, t string").repartition(n).select("i", rule(F.col("t")).alias("x")).collect()}
    alone = made(list(enumerate(TEXTS[:7])), 7)
    got = made([(i, (t * 300 if t else t) if i % 7 == 4 else t) for i, t in enumerate(TEXTS)], 1)
    assert all(got[i] == alone[i % 7] for i in got if i % 7 != 4) and len(got) == len(TEXTS)


def _spans(batches):
    return [len(b) for b in folds._sliced(batches)]


def test_slices_are_whole_rows(monkeypatch):
    monkeypatch.setattr(folds, "PIECE", 10)
    texts = pa.array(["a" * 4, None, "b" * 6, "c", "d" * 30, "", "e"])
    assert _spans([texts, texts[:0], texts[2:]]) == [3, 1, 1, 2, 2, 1, 2]
    lists = pa.array([[("a" * 4, 1), ("b" * 6, 2)], None, [], [("c" * 30, 1)], [("d", 1)]], pa.list_(pa.struct([("text", pa.string()), ("number", pa.int32())])))
    assert _spans([lists, lists[3:]]) == [3, 1, 1, 1, 1]
    assert [s.to_pylist() for s in folds._sliced([lists[2:]])] == [[[]], [[{"text": "c" * 30, "number": 1}]], [[{"text": "d", "number": 1}]]]


def test_memory_of_breaths_does_not_grow_with_the_batch(monkeypatch):
    held = {}
    monkeypatch.setattr(folds.F, "arrow_udf", lambda run, kind: lambda text: run)
    run = folds.with_breaths(None, ["and"], 12)
    folds._classes()
    for n in (1, 20):
        batch = pa.array(["some words without an end and more of them " * 12_000] * (2 * n))
        tracemalloc.start()
        assert sum(len(b) for b in run(iter([batch]))) == 2 * n
        held[n] = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
    assert held[20] < 1.5 * held[1], held
