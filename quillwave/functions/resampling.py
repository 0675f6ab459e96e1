"""Resampling of series by a polyphase filter, in blocks of positions with the neighbours that the filter reaches."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 100_000
#: Zero crossings of the filter on either side, and the shape of its window.
CROSSINGS, SHAPE = 10, 5.0


def taps(up: int, down: int) -> np.ndarray:
    """A windowed sine filter that passes what both rates can hold; its gain makes up for the zeros put in between."""
    most = max(up, down)
    half = CROSSINGS * most
    h = np.sinc(np.arange(-half, half + 1) / most) * np.kaiser(2 * half + 1, SHAPE)
    return h / h.sum() * up


def resampled(signal: DataFrame, up: int, down: int, block: int = BLOCK) -> DataFrame:
    """(series_id, channel, pos, value) at up / down times the rate: rows m with m * down < n * up, zeros beyond the ends.

    Positions are numbered from 0 without gaps; a row that is missing counts as zero. Blocks keep to multiples of `down`.
    """
    h, half = taps(up, down), CROSSINGS * max(up, down)
    reach, size = -(-half // up), -(-block // down) * down

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        first = int(key[2]) * size
        x = np.zeros(size + 2 * reach)
        x[rows["pos"].to_numpy() - (first - reach)] = rows["value"].to_numpy()
        last = int(rows["pos"].max()) + 1
        if last <= first:  # copies alone
            return rows.iloc[:0].drop(columns="home")
        spaced = np.zeros(len(x) * up)
        spaced[::up] = x
        m = np.arange(first * up // down, -(-min(first + size, last) * up // down))
        y = np.convolve(spaced, h)[m * down - (first - reach) * up + half]
        return pd.DataFrame({"series_id": key[0], "channel": key[1], "pos": m, "value": y})

    at = F.col("pos")
    homes = F.array_distinct(F.array(F.floor(at / size), F.floor(F.greatest(at - reach, F.lit(0)) / size), F.floor((at + reach) / size)))
    rows = signal.select("series_id", "channel", "pos", F.col("value").cast("double").alias("value"), F.explode(homes).alias("home"))
    kinds = {f.name: f.dataType.simpleString() for f in signal.schema}
    return rows.groupBy("series_id", "channel", "home").applyInPandas(run, f"series_id {kinds['series_id']}, channel {kinds['channel']}, pos long, value double")
