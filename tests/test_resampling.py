"""Resampling against a direct sum, and peaks between samples."""

import numpy as np
import pytest

from quillwave.functions import resampling
from quillwave.operators import frames


def table(spark, x):
    return spark.createDataFrame([("s", 0, i, float(v)) for i, v in enumerate(x)], "series_id string, channel int, pos long, value double").repartition(3)


def values(df):
    return np.array([r["value"] for r in df.orderBy("pos").collect()])


@pytest.mark.parametrize("up, down, block", [(4, 1, 37), (1, 4, 50), (3, 2, 41), (4, 1, 100_000)])
def test_blocks_equal_a_direct_sum(spark, up, down, block):
    x = np.random.default_rng(up).normal(0, 1, 203)
    h, half = resampling.taps(up, down), len(resampling.taps(up, down)) // 2
    want = [sum(x[k] * h[half + m * down - k * up] for k in range(len(x)) if 0 <= half + m * down - k * up < len(h)) for m in range(-(-len(x) * up // down))]
    assert np.allclose(values(resampling.resampled(table(spark, x), up, down, block)), want, atol=1e-12)


def test_peaks_between_samples_are_limited(spark):
    """A tone at a quarter of the rate, sampled half a sample beside its peaks: its samples stay under the ceiling, it does not."""
    i = np.arange(400)
    x = 0.95 * np.sin(np.pi / 2 * i + np.pi / 4)
    top = 10 ** (-1.3 / 20)
    assert np.abs(x).max() < top
    as_it_stands = values(frames.lookahead_limit(table(spark, x), 1000.0, smooth_hz=0, oversample=1))
    assert np.allclose(as_it_stands, x)
    limited = frames.lookahead_limit(table(spark, x), 1000.0, smooth_hz=0)
    assert len(values(limited)) == len(x)
    inner = np.abs(values(resampling.resampled(limited, 4, 1)))[200:-200]
    before = np.abs(values(resampling.resampled(table(spark, x), 4, 1)))[200:-200]
    assert before.max() > top + 0.05 and inner.max() < top + 0.01
