"""Spectra in blocks and mel bands against plain numpy."""

import numpy as np
import pandas as pd
import pytest

from quillwave.operators import spectrum as S

RATE, SIZE = 100.0, 16


def series(spark, values, name="a", channel=0):
    return spark.createDataFrame(pd.DataFrame({"series_id": name, "channel": channel, "pos": np.arange(len(values)), "value": values}))


def plain(x):
    """Power and magnitude of every frame, one at a time."""
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(SIZE) / SIZE)
    out = []
    for at in range(0, len(x) - SIZE + 1, SIZE // 2):
        f = x[at : at + SIZE]
        m = [abs(sum((v - f.mean()) * w * np.exp(-2j * np.pi * b * k / SIZE) for k, (v, w) in enumerate(zip(f, window)))) for b in range(SIZE // 2 + 1)]
        out.append(m)
    m = np.array(out)
    p = m**2 / (RATE * (window**2).sum())
    p[:, 1:-1] *= 2
    return p, m


@pytest.fixture()
def small_blocks(monkeypatch):
    monkeypatch.setattr(S, "BLOCK", 40)  # five frames


def test_blocks_give_the_frames_of_the_whole_series(spark, small_blocks):
    x = np.random.default_rng(3).normal(size=333)
    power, magnitude = plain(x)
    got = S.spectra(series(spark, x), RATE, SIZE).orderBy("frame").toPandas()
    assert list(got.frame) == list(range(len(power)))
    assert np.allclose(np.stack(got.power), power) and np.allclose(np.stack(got.magnitude), magnitude)
    f = S.frame_features(series(spark, x), RATE, SIZE).orderBy("frame").toPandas()
    assert list(f.frame) == list(range(len(power)))
    assert np.isnan(f.rise[0]) and np.allclose(f.rise[1:], np.maximum(np.diff(magnitude, axis=0), 0).mean(1))
    hz = np.arange(SIZE // 2 + 1) * RATE / SIZE
    assert np.allclose(f.centroid, (magnitude * hz).sum(1) / magnitude.sum(1))
    assert f.pitch_before[0] is None and all(np.allclose(a, b) for a, b in zip(f.pitch_before[1:], f.pitch))
    assert f.psd_sum.notna().sum() > 5  # a row per block
    psd = S._welch(S.frame_features(series(spark, x), RATE, SIZE)).orderBy("hz").toPandas()
    assert np.allclose(psd.psd, power.mean(0)) and np.allclose(psd.hz, hz)


def test_gaps_channels_silence_and_empty(spark, small_blocks):
    x = np.random.default_rng(4).normal(size=200)
    both = series(spark, x).unionByName(series(spark, 3 * x, channel=1))
    got = S.spectra(both, RATE, SIZE).orderBy("frame").toPandas()
    assert np.allclose(np.stack(got.magnitude), plain(2 * x)[1])  # channels are mixed
    holes = series(spark, x).filter("pos <> 100").unionByName(series(spark, x[:1]).selectExpr("series_id", "channel", "100L pos", "CAST(NULL AS DOUBLE) value"))
    f = S.frame_features(holes, RATE, SIZE).orderBy("frame").toPandas()
    assert set(range(24)) - set(f.frame) == {11, 12} and f[f.rise.isna()].frame.tolist() == [0, 13]
    silent = S.frame_features(series(spark, np.zeros(64)), RATE, SIZE)
    assert silent.filter("centroid IS NULL").count() == silent.count() == 7
    assert S.onset_strength(silent).first().onset_ratio == 0.0 and S.harmonic_stability(silent).first().stability == 1.0
    empty = series(spark, x).limit(0)
    assert S.spectra(empty, RATE, SIZE).count() == 0 and S.rolloff(S.frame_features(empty, RATE, SIZE)).count() == 0
    assert S.spectra(series(spark, x[:15]), RATE, SIZE).count() == 0  # shorter than a frame


def test_mel_bands():
    w = S.mel_bands(48_000.0, 2048)
    assert w.shape == (64, 1025) and (w >= 0).all() and (w.max(1) > 0).all()
    hz = np.arange(1025) * 48_000 / 2048
    middle = hz[w.argmax(1)]
    assert (np.diff(middle) > 0).all() and abs(np.diff(middle[:10]).std()) < 24 and middle[-1] / middle[-2] > 1.05  # even, then in proportion
    few = S.mel_bands(100.0, 16, 40)  # more bands than bins: some are empty, none is negative or not a number
    assert np.isfinite(few).all() and (few.sum(1) == 0).any() and few.sum() > 0


def test_boundaries_by_mel(spark):
    t = np.arange(64)
    low, high = np.sin(2 * np.pi * 10 * t / RATE), np.sin(2 * np.pi * 35 * t / RATE)
    parts = [low, low, high, high[:10]]
    rows = [("a", n, p, float(v)) for n, x in enumerate(parts) for p, v in enumerate(x)]
    chunks = spark.createDataFrame(rows, "series_id string, chunk_no long, pos long, value double")
    got = {r.boundary: (r.similarity, r.passed) for r in S.boundary_similarity(chunks, 32, RATE, SIZE, least_rows=12, bands=8).collect()}
    assert set(got) == {0, 1, 2} and got[0][0] > 0.99 and got[1][0] < 0.5 and not got[1][1] and got[2] == (1.0, True)
    w = S.mel_bands(RATE, SIZE, 8)
    a, b = (w @ plain(x)[0].mean(0) for x in (low[-32:], high[:32]))
    assert abs(got[1][0] - a @ b / np.sqrt(a @ a) / np.sqrt(b @ b)) < 1e-9
    assert S.boundary_similarity(chunks.limit(0), 32, RATE, SIZE).count() == 0
