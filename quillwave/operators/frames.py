"""Levels, silences and checks of sampled series: signal(series_id, channel, pos, value)."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.runs import merged_runs
from ..session import written

BLOCK = 100_000
# Fixed limits.
SILENCE, CLIP, TAIL_DB, TAIL_MS, FLAT, HYGIENE = 0.001, 0.99, -45.0, 50.0, 0.85, (16_000, 4.0, 15.0, -1.0, -45.0)


def db(level: Column, floor: float = 1e-10) -> Column:
    return 20.0 * F.log10(F.greatest(level, F.lit(floor)))


def blocked(signal: DataFrame, before: int, after: int, make, block: int = BLOCK) -> DataFrame:
    """`make`(window) as a column over each row, `before` rows and `after` rows around it, without a task per series.

    Rows near a block's edge are copied to the next block, so that every row finds its neighbours there.
    """
    own = F.floor(F.col("pos") / block)
    homes = F.array_distinct(F.array(own, F.floor(F.greatest(F.col("pos") - after, F.lit(0)) / block), F.floor((F.col("pos") + before) / block)))
    rows = signal.withColumn("own", own).withColumn("home", F.explode(homes))
    window = Window.partitionBy("series_id", "home").orderBy("pos")
    for name, column in make(window).items():
        rows = rows.withColumn(name, column)
    return rows.filter(F.col("own") == F.col("home")).drop("own", "home")


def frame_rms(signal: DataFrame, window: int) -> DataFrame:
    """rms and dbfs of each frame of `window` rows."""
    rows = signal.groupBy("series_id", F.floor(F.col("pos") / window).alias("frame")).agg(F.sqrt(F.avg(F.col("value") * F.col("value"))).alias("rms"))
    return rows.withColumn("dbfs", db(F.col("rms")))


def sliding_rms(signal: DataFrame, window: int) -> DataFrame:
    """Centred moving RMS over `window` rows, zeros beyond the ends."""
    before, after = window // 2, (window - 1) // 2
    square = F.col("value") * F.col("value")
    return blocked(signal, before, after, lambda w: {"env": F.sqrt(F.sum(square).over(w.rowsBetween(-before, after)) / window)})


def _inspected(signal: DataFrame, window: int) -> DataFrame:
    """Frames that the checks look at: those that start before the last whole window's start; n is the series' length."""
    n = signal.groupBy("series_id").agg((F.max("pos") + 1).alias("n"))
    return frame_rms(signal, window).join(n, "series_id").filter(F.col("frame") * window < F.col("n") - window)


def silence_gaps(signal: DataFrame, rate_hz: float, window: int, threshold: float = SILENCE, max_silence_sec: float = 15.0) -> DataFrame:
    """Runs of quiet frames longer than the limit; a run that reaches the last frame looked at lasts to the end."""
    frames = written(_inspected(signal, window))
    last = frames.groupBy("series_id").agg(F.first("n").alias("n"), F.max("frame").alias("last"))
    runs = merged_runs(frames.filter(F.col("rms") < threshold), "series_id", "frame").join(last, "series_id")
    end = F.when(F.col("b") == F.col("last"), F.col("n")).otherwise((F.col("b") + 1) * window)
    length = (end - F.col("a") * window) / rate_hz
    return runs.filter(length > max_silence_sec).select("series_id", F.round(F.col("a") * window / rate_hz, 1).alias("start_sec"), F.round(length, 1).alias("duration_sec"))


def silence_ratio(signal: DataFrame, window: int, threshold: float = SILENCE) -> DataFrame:
    """Share of quiet frames among all whole ones; passes from 0.15 to 0.75."""
    rows = _inspected(signal, window).groupBy("series_id").agg(F.count_if(F.col("rms") < threshold).alias("quiet"), F.first("n").alias("n"))
    ratio = F.col("quiet") / F.greatest(F.floor(F.col("n") / window), F.lit(1))
    return rows.select("series_id", F.round(ratio, 3).alias("silence_ratio"), ratio.between(0.15, 0.75).alias("passed"))


def clipping(signal: DataFrame, threshold: float = CLIP) -> DataFrame:
    rows = signal.groupBy("series_id").agg(F.count_if(F.abs("value") >= threshold).alias("clipped"), F.count(F.lit(1)).alias("n"))
    return rows.select("series_id", "clipped", F.round(F.col("clipped") / F.col("n"), 6).alias("clipped_ratio"), (F.col("clipped") / F.col("n") < 0.001).alias("passed"))


def dynamic_range(signal: DataFrame, window: int, max_rms_std: float = 0.01) -> DataFrame:
    """Population deviation of the RMS of whole windows; series shorter than one window have 0."""
    n = signal.groupBy("series_id").agg((F.max("pos") + 1).alias("n"))
    rows = n.join(frame_rms(signal, window), "series_id").filter(((F.col("frame") + 1) * window <= F.col("n")) | (F.col("n") < window))
    rows = rows.groupBy("series_id").agg(F.when(F.first("n") < window, F.lit(0.0)).otherwise(F.stddev_pop("rms")).alias("s"))
    return rows.select("series_id", F.round("s", 5).alias("rms_std"), (F.col("s") <= max_rms_std).alias("passed"))


def zero_crossing(signal: DataFrame, most: float = 0.4) -> DataFrame:
    rows = blocked(signal, 1, 0, lambda w: {"step": F.abs(F.signum("value") - F.lag(F.signum("value")).over(w))})
    rate = F.coalesce(F.sum("step"), F.lit(0.0)) / (2 * F.count(F.lit(1)))
    return rows.groupBy("series_id").agg(rate.alias("zcr")).withColumn("noise", F.col("zcr") > most)


def signal_sanity(series: DataFrame, signal: DataFrame) -> DataFrame:
    """series(series_id): the first rule that fails: empty, nan, silent, noise; else ok."""
    facts = signal.groupBy("series_id").agg(F.count(F.lit(1)).alias("n"), F.max(F.isnan("value")).alias("nan"), F.max(F.when(~F.isnan("value"), F.abs("value"))).alias("peak"))
    rows = series.join(facts, "series_id", "left").join(zero_crossing(signal), "series_id", "left")
    status = F.when(F.col("n").isNull(), "empty").when(F.col("nan"), "nan").when(F.col("peak") < 1e-6, "silent").when(F.col("noise"), "noise").otherwise("ok")
    return rows.select("series_id", status.alias("status"))


def validate_candidates(wanted: DataFrame, signal: DataFrame) -> DataFrame:
    """wanted(series_id, wanted_rows): (valid, reason); the first rule that fails gives the reason."""
    bad = F.isnan("value") | (F.abs("value") == float("inf"))
    facts = signal.groupBy("series_id").agg(F.max(bad).alias("bad"), F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(F.col("value") * F.col("value"))).alias("rms"), F.count_if(F.abs("value") >= CLIP).alias("clipped"))
    rows = wanted.join(facts, "series_id", "left")
    n = F.coalesce("n", F.lit(0))
    reason = (
        F.when(F.coalesce("bad", F.lit(False)), "NaN/Inf detected").when(n < F.floor(F.col("wanted_rows") * 0.5), "Output too short")
        .when(db(F.coalesce("rms", F.lit(0.0))) < -50.0, "Near-silent output").when(F.col("clipped") / F.greatest(n, F.lit(1)) > 0.05, "Excessive clipping").otherwise("OK")
    )
    return rows.select("series_id", (reason == "OK").alias("valid"), reason.alias("reason"))


def reference_hygiene(series: DataFrame, signal: DataFrame) -> DataFrame:
    """series(series_id, rate_hz, channels): messages about what harms a reference; nothing is rejected."""
    rate, short, long, peak_db, rms_db = HYGIENE
    facts = signal.groupBy("series_id").agg((F.max("pos") + 1).alias("n"), F.max(F.abs("value")).alias("peak"), F.sqrt(F.avg(F.col("value") * F.col("value"))).alias("rms"))
    rows = series.join(facts, "series_id", "left")
    seconds = F.coalesce("n", F.lit(0)) / F.col("rate_hz")
    flags = F.array(
        F.when(F.col("rate_hz") < rate, "low rate"), F.when(seconds < short, "too short").when(seconds > long, "too long"), F.when(F.col("channels") > 1, "not mono"),
        F.when(F.coalesce("peak", F.lit(0.0)) >= 10 ** (peak_db / 20), "peak too high"), F.when(db(F.coalesce("rms", F.lit(0.0)), 1e-9) < rms_db, "silent"),
    )
    return rows.select("series_id", F.filter(flags, lambda x: x.isNotNull()).alias("flags"))


def activity_mask(signal: DataFrame, chunk: int, share: float = 0.15) -> DataFrame:
    rows = signal.withColumn("chunk", F.floor(F.col("pos") / chunk))
    mean = F.avg(F.abs("value")).over(Window.partitionBy("series_id", "chunk"))
    return rows.withColumn("active", F.abs("value") > share * mean)


def trim_tail(signal: DataFrame, rate_hz: float) -> DataFrame:
    """Rows up to 50 ms behind the last one above -45 dBFS; series without such a row stay whole."""
    loud = signal.groupBy("series_id").agg(F.max(F.when(F.abs("value") > 10 ** (TAIL_DB / 20), F.col("pos"))).alias("last"))
    keep = F.col("last").isNull() | (F.col("pos") <= F.col("last") + int(TAIL_MS / 1000 * rate_hz))
    return signal.join(loud, "series_id").filter(keep).drop("last")


def trim_tail_windows(signal: DataFrame, rate_hz: float, window_sec: float = 0.02) -> DataFrame:
    """Offset removed, quiet windows stripped from the end (one window stays), then an 800 ms tail dropped if it is flat as noise.

    Windows are counted from the end, so the last loud row of each series decides how many go; the tail test needs one short
    tail per series.
    """
    win = max(1, int(window_sec * rate_hz))
    rows = remove_offset(signal)
    rows = rows.join(signal.groupBy("series_id").agg((F.max("pos") + 1).alias("n")), "series_id")
    back = F.floor((F.col("n") - 1 - F.col("pos")) / win)
    whole = (back + 1) * win + win <= F.col("n")
    level = rows.withColumn("back", back).filter(whole).groupBy("series_id", "back").agg(F.sqrt(F.avg(F.col("value") * F.col("value"))).alias("rms"))
    loud = level.groupBy("series_id").agg(F.min(F.when(F.col("rms") >= 10 ** (TAIL_DB / 20), F.col("back"))).alias("stop"), F.max("back").alias("all"))
    rows = rows.join(loud, "series_id", "left")
    end = F.greatest(F.col("n") - F.coalesce("stop", F.col("all") + 1, F.lit(0)) * win, F.least(F.lit(win), F.col("n")))
    rows = rows.withColumn("end", end).filter(F.col("pos") < F.col("end"))
    least, most = int(0.2 * rate_hz), int(0.8 * rate_hz)
    tails = rows.filter(F.col("pos") >= F.col("end") - most).groupBy("series_id", "end").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "value"))), lambda x: x["value"]).alias("tail"))

    def flat(batches):
        for p in batches:
            out = []
            for tail in p["tail"]:
                x = np.abs(np.fft.rfft(np.asarray(tail) * np.hanning(len(tail)), 2048))
                x = np.maximum(x, 1e-10)
                out.append(len(tail) >= least and float(np.exp(np.log(x).mean()) / x.mean()) > FLAT)
            yield pd.DataFrame({"series_id": p.series_id, "flat": out})

    noisy = tails.mapInPandas(flat, "series_id string, flat boolean")
    rows = rows.join(noisy, "series_id", "left")
    cut = F.greatest(F.col("end") - F.least(F.lit(most), F.col("end")), F.least(F.lit(win), F.col("end")))
    return rows.filter(~F.coalesce("flat", F.lit(False)) | (F.col("pos") < cut)).drop("n", "stop", "all", "end", "flat")


def clamp(value: Column) -> Column:
    return F.greatest(F.least(value, F.lit(1.0)), F.lit(-1.0))


def remove_offset(signal: DataFrame) -> DataFrame:
    means = signal.groupBy("series_id").agg(F.avg("value").alias("mean"))
    return signal.join(means, "series_id").withColumn("value", clamp(F.col("value") - F.col("mean"))).drop("mean")


def normalize_rms(signal: DataFrame, target_db: float = -23.0, min_rms_db: float = -60.0, most_db: float | None = 12.0) -> DataFrame:
    """Scaled to the target level, the gain within `most_db`; series below `min_rms_db` stay as they are."""
    gain = F.lit(10 ** (target_db / 20)) / F.col("rms")
    if most_db is not None:
        gain = F.greatest(F.least(gain, F.lit(10 ** (most_db / 20))), F.lit(10 ** (-most_db / 20)))
    levels = signal.groupBy("series_id").agg(F.sqrt(F.avg(F.col("value") * F.col("value"))).alias("rms"))
    levels = levels.select("series_id", F.when(F.col("rms") >= 10 ** (min_rms_db / 20), gain).alias("gain"))
    rows = signal.join(levels, "series_id")
    return rows.withColumn("value", F.when(F.col("gain").isNull(), F.col("value")).otherwise(clamp(F.col("value") * F.col("gain")))).drop("gain")


def normalize_peak(signal: DataFrame, target_db: float = -1.0) -> DataFrame:
    peaks = signal.groupBy("series_id").agg(F.max(F.abs("value")).alias("peak"))
    scaled = F.when(F.col("peak") > 0, clamp(F.col("value") * F.lit(10 ** (target_db / 20)) / F.col("peak"))).otherwise(F.col("value"))
    return signal.join(peaks, "series_id").withColumn("value", scaled).drop("peak")


def _biquads(rate: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """The two stages of ITU-R BS.1770 weighting (shelf, high pass) for a sample rate; fixed design values."""
    out = []
    for kind, f0, q, g in (("shelf", 1681.974450955533, 0.7071752369554196, 3.999843853973347), ("high", 38.13547087602444, 0.5003270373238773, 0.0)):
        k = math.tan(math.pi * f0 / rate)
        vh, a0 = 10 ** (g / 20), 1 + k / q + k * k
        a = np.array([1.0, 2 * (k * k - 1) / a0, (1 - k / q + k * k) / a0])
        vb = vh**0.4996667741545416
        b = np.array([vh + vb * k / q + k * k, 2 * (k * k - vh), vh - vb * k / q + k * k]) / a0 if kind == "shelf" else np.array([1.0, -2.0, 1.0])
        out.append((b, a))
    return out


def k_weighted(signal: DataFrame, rate_hz: float) -> DataFrame:
    """The series after the loudness weighting, channel by channel, in blocks of positions."""
    from ..functions.filters import chained, filtered, space

    system = chained(*(space(b, a) for b, a in _biquads(rate_hz)))
    return filtered(signal, system, by=("series_id", "channel"))


def gated_loudness(signal: DataFrame, rate_hz: float, target_lufs: float = -18.0, weighted: bool = True) -> DataFrame:
    """Integrated loudness (400 ms blocks, 75 % overlap, gates at -70 and -10 below the mean) and the gain to the target.

    A mono series aims 3 below a target of -18. Gain 1 for series under 0.4 s, without loudness, or more than 40 dB away.
    """
    block, step = int(0.4 * rate_hz), max(1, int(0.1 * rate_hz))
    facts = signal.groupBy("series_id").agg((F.max("pos") + 1).alias("n"), F.countDistinct("channel").alias("channels"))
    source = k_weighted(signal, rate_hz) if weighted else signal
    last, first = F.floor(F.col("pos") / step), F.ceil((F.col("pos") - block + 1) / step)
    rows = source.withColumn("b", F.explode(F.sequence(F.greatest(first, F.lit(0)), last)))
    power = rows.groupBy("series_id", "b").agg((F.sum(F.col("value") * F.col("value")) / block).alias("z"))
    power = power.join(facts, "series_id").filter(F.col("b") * step + block <= F.col("n"))
    loud = lambda z: -0.691 + 10 * F.log10(z)
    heard = power.filter(loud(F.col("z")) > -70.0)
    relative = heard.groupBy("series_id").agg((loud(F.avg("z")) - 10.0).alias("gate"))
    gated = heard.join(relative, "series_id").filter(loud(F.col("z")) > F.col("gate")).groupBy("series_id").agg(loud(F.avg("z")).alias("lufs"))
    rows = facts.join(gated, "series_id", "left")
    aim = F.when((F.col("channels") == 1) & F.lit(target_lufs == -18.0), F.lit(-21.0)).otherwise(F.lit(target_lufs))
    none = (F.col("n") < block) | F.col("lufs").isNull() | (F.abs(aim - F.col("lufs")) > 40.0)
    return rows.select("series_id", "lufs", F.when(none, F.lit(1.0)).otherwise(F.pow(F.lit(10.0), (aim - F.col("lufs")) / 20)).alias("gain"))


def lookahead_limit(signal: DataFrame, rate_hz: float, threshold_db: float = -1.0, margin_db: float = 0.3, lookahead_ms: float = 2.0, smooth_hz: float = 200.0, oversample: int = 4) -> DataFrame:
    """Each row's gain is the smallest that it or the rows of the next `lookahead_ms` need, or less where a zero-phase low pass
    at `smooth_hz` (0: none) rounds it; all channels share it.

    Peaks between samples count: the series is limited at `oversample` times its rate and brought back (1: as it stands). Only
    series_id, channel, pos and value are kept.
    """
    from ..functions.filters import low_pass, zero_phase
    from ..functions.resampling import resampled

    rate = rate_hz * oversample
    top, ahead = 10 ** ((threshold_db - margin_db) / 20), max(1, int(rate * lookahead_ms / 1000))
    held = lambda v: F.greatest(F.least(v, F.lit(top)), F.lit(-top))
    fine = written(resampled(signal, oversample, 1)) if oversample > 1 else signal.select("series_id", "channel", "pos", "value")
    peaks = fine.groupBy("series_id", "pos").agg(F.least(F.lit(1.0), F.lit(top) / F.greatest(F.max(F.abs("value")), F.lit(1e-12))).alias("need"))
    gains = blocked(peaks, 0, ahead - 1, lambda w: {"gain": F.min("need").over(w.rowsBetween(0, ahead - 1))}).select("series_id", "pos", "gain")
    if smooth_hz > 0:
        gains = written(gains)
        smooth = zero_phase(gains.withColumnRenamed("gain", "value"), low_pass(min(smooth_hz, 0.45 * rate), rate)).withColumnRenamed("value", "smooth")
        gains = gains.join(smooth, ["series_id", "pos"]).withColumn("gain", F.least("gain", "smooth")).drop("smooth")
    rows = fine.join(gains, ["series_id", "pos"]).select("series_id", "channel", "pos", held(F.col("value") * F.col("gain")).alias("value"))
    return resampled(rows, 1, oversample).withColumn("value", held(F.col("value"))) if oversample > 1 else rows


def onepole_envelope(signal: DataFrame, rate_hz: float, ms: float = 30.0) -> DataFrame:
    """Recursive RMS envelope."""
    from ..functions.recursion import alpha_of, linear_ema

    rows = signal.select("series_id", "pos", (F.col("value") * F.col("value")).alias("value"))
    return linear_ema(rows, alpha_of(ms, rate_hz)).select("series_id", "pos", F.sqrt(F.greatest("smooth", F.lit(1e-12))).alias("env"))
