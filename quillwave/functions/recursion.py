"""Recursions over ordered rows that no window can say. Series are dealt in blocks where the recursion is linear."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 100_000
#: exp(-SETTLED) of a state's error is left; below the precision of a double.
SETTLED = 40.0


def alpha_of(ms: float, rate_hz: float) -> float:
    return math.exp(-1.0 / (rate_hz * ms / 1000.0))


def decayed(x: np.ndarray, alpha: float, start: float = 0.0) -> np.ndarray:
    """y[i] = alpha * y[i-1] + (1 - alpha) * x[i], in pieces short enough for the powers to stay finite."""
    piece = max(1, min(4096, int(-600 / math.log(alpha)))) if 0 < alpha < 1 else 4096
    out = np.empty(len(x))
    for at in range(0, len(x), piece):
        p = alpha ** np.arange(1, len(x[at : at + piece]) + 1)
        out[at : at + piece] = p * (start + np.cumsum((1 - alpha) * x[at : at + piece] / p))
        start = out[min(at + piece, len(x)) - 1]
    return out


def asymmetric(x: np.ndarray, attack: float, release: float, start: float) -> np.ndarray:
    """The same with one factor while falling and another while rising."""
    out, now = np.empty(len(x)), start
    for i, t in enumerate(x.tolist()):
        a = attack if t < now else release
        now = a * now + (1 - a) * t
        out[i] = now
    return out


def linear_ema(series: DataFrame, alpha: float, value: str = "value", block: int = BLOCK) -> DataFrame:
    """series(series_id, pos, value) with `smooth`: the decayed mean from the start of each series.

    Each block runs from zero in its own task; the ends of the blocks, a row each, give what every block starts with.
    """
    rows = series.select("series_id", "pos", F.col(value).cast("double").alias("x")).withColumn("block", F.floor(F.col("pos") / block))

    def local(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("pos")
        return p.assign(smooth=decayed(p.x.to_numpy(), alpha), k=np.arange(1, len(p) + 1))

    part = rows.groupBy("series_id", "block").applyInPandas(local, "series_id string, pos long, x double, block long, smooth double, k long")
    ends = part.groupBy("series_id", "block").agg(F.max_by("smooth", "pos").alias("end"), F.count(F.lit(1)).alias("n"))

    def carry(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("block")
        now, starts = 0.0, []
        for end, n in zip(p.end, p.n, strict=True):
            starts.append(now)
            now = end + now * alpha**n
        return pd.DataFrame({"series_id": p.series_id, "block": p.block, "start": starts})

    starts = ends.groupBy("series_id").applyInPandas(carry, "series_id string, block long, start double")
    return part.join(starts, ["series_id", "block"]).select("series_id", "pos", (F.col("smooth") + F.col("start") * F.pow(F.lit(alpha), F.col("k"))).alias("smooth"))


def asymmetric_ema(series: DataFrame, attack: float, release: float, start: float = 0.0, value: str = "value", block: int = BLOCK) -> DataFrame:
    """series(series_id, pos, value) with `smooth`, in blocks of positions.

    Every step brings any two states nearer by the larger factor at least, so a block that begins SETTLED steps early, from
    any state, is right to the last bits when its own rows come; the first block begins at `start`.
    """
    slowest = max(attack, release)
    early = int(math.ceil(SETTLED / -math.log(slowest))) if slowest > 0 else 1
    block = max(block, 4 * early)
    rows = series.select("series_id", "pos", F.col(value).cast("double").alias("x"))
    own = F.floor(F.col("pos") / block)
    rows = rows.withColumn("home", F.explode(F.array_distinct(F.array(own, F.floor((F.col("pos") + early) / block)))))

    def run(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("pos")
        now = start if p.home.iloc[0] == 0 else float(p.x.iloc[0])
        out = pd.DataFrame({"series_id": p.series_id, "pos": p.pos, "smooth": asymmetric(p.x.to_numpy(), attack, release, now)})
        return out[(p.pos // block).to_numpy() == p.home.to_numpy()]

    kind = rows.schema["series_id"].dataType.simpleString()
    return rows.groupBy("series_id", "home").applyInPandas(run, f"series_id {kind}, pos long, smooth double")
