"""Replaceable estimate of how long a chunk of text lasts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F


def duration_model(seconds_of):
    """A column function text -> seconds from a function over a pandas Series of texts; the place of any model of speech."""

    @F.pandas_udf("double")
    def estimate(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield seconds_of(texts)

    return estimate


def words_per_minute(text, wpm: float = 140.0):
    """The default model: words over words per minute."""
    return duration_model(lambda texts: texts.fillna("").str.split().str.len() / wpm * 60.0)(text)
