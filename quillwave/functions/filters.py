"""Linear filters over long series, in blocks of positions.

A filter is a state space: state' = A state + B x, y = C state + D x. Each block runs from a zero state in its own task; the
blocks' end states, a row each, give what every block starts with, and its response is added. So a long series is many tasks.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written
from .recursion import BLOCK


def space(b: np.ndarray, a: np.ndarray) -> tuple[np.ndarray, ...]:
    """(A, B, C, D) of the transfer function b / a, a[0] = 1."""
    n = len(a) - 1
    step = np.eye(n, k=1)
    step[:, 0] = -np.asarray(a[1:])
    return step, np.asarray(b[1:]) - np.asarray(a[1:]) * b[0], np.eye(n)[0], float(b[0])


def chained(first: tuple, second: tuple) -> tuple[np.ndarray, ...]:
    """The second filter behind the first."""
    (a1, b1, c1, d1), (a2, b2, c2, d2) = first, second
    step = np.block([[a1, np.zeros((len(a1), len(a2)))], [np.outer(b2, c1), a2]])
    return step, np.r_[b1, b2 * d1], np.r_[d2 * c1, c2], d1 * d2


def low_pass(hz: float, rate_hz: float, high: bool = False) -> tuple[np.ndarray, ...]:
    """Butterworth of order 2; `high`: the high pass."""
    k = math.tan(math.pi * hz / rate_hz)
    d = 1 + math.sqrt(2) * k + k * k
    b = np.array([1.0, -2.0, 1.0]) / d if high else np.array([1.0, 2.0, 1.0]) * k * k / d
    return space(b, np.array([1.0, 2 * (k * k - 1) / d, (1 - math.sqrt(2) * k + k * k) / d]))


def band_pass(low_hz: float, high_hz: float, rate_hz: float) -> tuple[np.ndarray, ...]:
    """Butterworth band of order 2: the analogue poles, moved to the band, through the bilinear transform."""
    fs2 = 2 * rate_hz
    w1, w2 = (fs2 * math.tan(math.pi * f / rate_hz) for f in (low_hz, high_hz))
    poles = np.concatenate([np.roots([1, -p * (w2 - w1), w1 * w2]) for p in np.exp(1j * np.pi * np.array([0.75, 1.25]))])
    gain = ((w2 - w1) ** 2 * fs2**2 / np.prod(fs2 - poles)).real
    return space(gain * np.poly([1, 1, -1, -1]), np.poly((fs2 + poles) / (fs2 - poles)).real)


def run(x: np.ndarray, system: tuple) -> tuple[np.ndarray, np.ndarray]:
    """(y, end state) from a zero state: a few hundred steps over all pieces at once, instead of a step per row."""
    a, b, c, d = system
    size = max(1, math.isqrt(len(x)))
    pieces = len(x) // size
    whole = x[: pieces * size].reshape(pieces, size)
    y, z = np.empty_like(whole), np.zeros((pieces, len(b)))
    for i in range(size):
        y[:, i] = z @ c + d * whole[:, i]
        z = z @ a.T + whole[:, i, None] * b
    leap, starts, now = np.linalg.matrix_power(a, size), np.zeros((pieces, len(b))), np.zeros(len(b))
    for j in range(pieces):
        starts[j] = now
        now = leap @ now + z[j]
    y += starts @ responses(system, size).T
    rest = np.empty(len(x) - pieces * size)
    for i, v in enumerate(x[pieces * size :]):
        rest[i] = c @ now + d * v
        now = a @ now + b * v
    return np.r_[y.ravel(), rest], now


def responses(system: tuple, n: int) -> np.ndarray:
    """What a state adds to each of the next n rows: C A^i, by doubling."""
    a, _, c, _ = system
    out, leap = c[None, :], a
    while len(out) < n:
        out = np.concatenate([out, out @ leap])
        leap = leap @ leap
    return out[:n]


def filtered(series: DataFrame, system: tuple, settled: bool = False, block: int = BLOCK, by: tuple[str, ...] = ("series_id",)) -> DataFrame:
    """series(by, pos, value), positions from 0 without gaps, to (by, pos, value) behind the filter.

    settled: it starts in the state that the first value, held for ever, would give; else at rest.
    """
    a, b, _, _ = system
    order, keys = len(b), list(by)
    rows = series.select(*keys, "pos", F.col("value").cast("double").alias("value")).withColumn("block", F.floor(F.col("pos") / block))
    kinds = "".join(f"{k} {series.schema[k].dataType.simpleString()}, " for k in keys)

    def local(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("pos")
        y, end = run(p.value.to_numpy(), system)
        ends = [None] * len(p)
        ends[-1] = end
        return p[[*keys, "block", "pos"]].assign(y=y, x=p.value, end=ends)

    # read by two branches, so written once
    part = rows.groupBy(*keys, "block").applyInPandas(local, f"{kinds}block long, pos long, y double, x double, end array<double>")
    part = written(part)
    ends = part.groupBy(*keys, "block").agg(F.max("end").alias("end"), F.count(F.lit(1)).alias("n"), F.min_by("x", "pos").alias("x"))
    still = np.linalg.solve(np.eye(order) - a, b) if settled else np.zeros(order)

    def carry(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("block")
        now, starts = still * (p.x.iloc[0] if settled else 0.0), []
        for end, n in zip(p.end, p.n, strict=True):
            starts.append(now)
            now = np.linalg.matrix_power(a, int(n)) @ now + np.asarray(end)
        return p[[*keys, "block"]].assign(start=starts)

    starts = ends.groupBy(*keys).applyInPandas(carry, f"{kinds}block long, start array<double>")  # a row per block

    def add(batches):
        table = responses(system, block)
        for p in batches:
            state = np.stack(p.start.to_numpy()) if len(p) else np.zeros((0, order))
            yield p[[*keys, "pos"]].assign(value=p.y + (state * table[(p.pos % block).to_numpy(int)]).sum(1))

    joined = part.join(starts, [*keys, "block"]).select(*keys, "pos", "y", "start")
    return joined.mapInPandas(add, f"{kinds}pos long, value double")


#: Rows by which a series is mirrored at its ends before it is filtered in both directions, and the length up to which it is left as it is.
EDGE, SHORT = 9, 12


def zero_phase(series: DataFrame, system: tuple) -> DataFrame:
    """The series filtered forward and backward, so that nothing is delayed; its ends are continued point-symmetrically.

    Series of up to SHORT rows stay as they are.
    """
    series = written(series.select("series_id", "pos", "value"))
    n = series.groupBy("series_id").agg((F.max("pos") + 1).alias("n"), F.min_by("value", "pos").alias("first"), F.max_by("value", "pos").alias("last"))
    rows = series.select("series_id", "pos", F.col("value").cast("double").alias("value")).join(n, "series_id")
    long = rows.filter(F.col("n") > SHORT)
    one = lambda pos, value: F.struct(pos.cast("long").alias("pos"), value.alias("value"))
    pos, value, size = F.col("pos"), F.col("value"), F.col("n")
    copies = F.array(
        one(pos + EDGE, value),
        F.when(pos.between(1, EDGE), one(EDGE - pos, 2 * F.col("first") - value)),
        F.when((size - 1 - pos).between(1, EDGE), one(2 * (size - 1) - pos + EDGE, 2 * F.col("last") - value)),
    )
    wide = long.select("series_id", F.explode(F.filter(copies, lambda c: c.isNotNull())).alias("c")).select("series_id", "c.*")

    def turned(df: DataFrame, by: Column) -> DataFrame:
        return df.join(n.select("series_id", "n"), "series_id").select("series_id", (by - F.col("pos")).alias("pos"), "value")

    whole = F.col("n") + 2 * EDGE - 1
    back = filtered(turned(filtered(wide, system, settled=True), whole), system, settled=True)
    inside = turned(back, whole).join(n.select("series_id", "n"), "series_id").filter((F.col("pos") >= EDGE) & (F.col("pos") < F.col("n") + EDGE))
    out = inside.select("series_id", (F.col("pos") - EDGE).alias("pos"), "value")
    return out.unionByName(rows.filter(F.col("n") <= SHORT).select("series_id", "pos", "value"))
