"""Spectra of series and the quality metrics, report and score drawn from them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.quantiles import exact_quantile
from ..session import written
from . import frames as L

# Fixed limits and weights.
WARM, PRESENT, BAND = (100.0, 300.0), (2000.0, 5000.0), (4000.0, 12000.0)
ROLLOFF, MAX_ROLLOFF, MAX_FLATNESS, MAX_CENTROID, MIN_HARMONIC = 0.85, 8000.0, 0.3, 50.0, 0.85
ONSET_RATIO, ONSET_DENSITY, MAX_RMS_STD, MIN_SIMILARITY, MIN_RATIO_DB, MAX_RATE = 5.0, 0.5, 0.01, 0.85, 15.0, 30.0
LOUDNESS, TOLERANCE, MELS = -16.0, 6.0, 64
WEIGHTS = {"balance": 0.12, "rolloff": 0.12, "onset": 0.10, "clipping": 0.15, "loudness": 0.06, "flatness": 0.10, "centroid": 0.10, "harmony": 0.10, "density": 0.08, "dynamics": 0.07}


#: Positions of a block that is transformed in one piece.
BLOCK = 1 << 18


def _objects(values) -> pd.Series:
    """A column of arrays or names, of that kind without rows too."""
    return pd.Series(list(values), dtype="object")


def _framed(signal: DataFrame, size: int, make, fields: str) -> DataFrame:
    """`make`(first, frames, numbers) for each block of frames, as a table of series_id and `fields`.

    A block of positions goes to a task with the rows that its last frames reach into and those of the one frame before it,
    whose number is below `first`. A position that stands there more than once counts with its mean, so channels are
    mixed; a frame with a missing or null position is left out.
    """
    hop = size // 2
    per = max(4, BLOCK // hop)
    last = F.floor(F.col("pos") / hop)
    homes = F.array_distinct(F.array(*(F.floor(F.greatest(last + i, F.lit(0)) / per) for i in (-2, -1, 0, 1))))
    rows = signal.filter("value IS NOT NULL AND pos IS NOT NULL").select("series_id", "pos", F.col("value").cast("double").alias("value"), F.explode(homes).alias("home"))

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        first = int(key[1]) * per
        begin = max(first - 1, 0)
        count = first + per - begin
        length = (count - 1) * hop + size
        at = rows["pos"].to_numpy() - begin * hop
        inside = (at >= 0) & (at < length)
        n = np.bincount(at[inside], minlength=length)
        x = np.bincount(at[inside], weights=rows["value"].to_numpy()[inside], minlength=length) / np.maximum(n, 1)
        filled = np.r_[0, np.cumsum(n > 0)]
        starts = np.arange(count) * hop
        whole = np.flatnonzero(filled[starts + size] - filled[starts] == size)
        frames = np.lib.stride_tricks.sliding_window_view(x, size)[starts[whole]]
        out = make(first, frames, begin + whole)
        out.insert(0, "series_id", _objects([key[0]] * len(out)))
        return out

    kind = signal.schema["series_id"].dataType.simpleString()
    return rows.groupBy("series_id", "home").applyInPandas(run, f"series_id {kind}, {fields}")


def _power(frames: np.ndarray, rate_hz: float) -> tuple[np.ndarray, np.ndarray]:
    """(power, magnitude) of each frame and bin: mean removed, Hann window; power is a density as in Welch's method."""
    size = frames.shape[1]
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / size)
    magnitude = np.abs(np.fft.rfft((frames - frames.mean(1, keepdims=True)) * window, axis=1))
    power = magnitude**2 / (rate_hz * (window**2).sum())
    power[:, 1:-1] *= 2
    return power, magnitude


def spectra(signal: DataFrame, rate_hz: float, size: int = 4096) -> DataFrame:
    """(series_id, frame, power, magnitude): the spectrum of each whole frame of `size` rows, half overlapping, as arrays by bin."""

    def make(first: int, frames: np.ndarray, numbers: np.ndarray) -> pd.DataFrame:
        own = numbers >= first
        power, magnitude = _power(frames[own], rate_hz)
        return pd.DataFrame({"frame": numbers[own], "power": _objects(power), "magnitude": _objects(magnitude)})

    return _framed(signal, size, make, "frame long, power array<double>, magnitude array<double>")


def dft_frames(signal: DataFrame, rate_hz: float, size: int = 4096) -> DataFrame:
    """(series_id, frame, bin, hz, power, magnitude): `spectra` with a row for each bin. The metrics do without these rows."""
    rows = spectra(signal, rate_hz, size).select("series_id", "frame", F.posexplode(F.arrays_zip("power", "magnitude")).alias("bin", "of"))
    return rows.select("series_id", "frame", F.col("bin").cast("long").alias("bin"), (F.col("bin") * rate_hz / size).alias("hz"), "of.power", "of.magnitude")


def frame_features(signal: DataFrame, rate_hz: float, size: int = 4096, share: float = ROLLOFF, reference_hz: float = 440.0) -> DataFrame:
    """A row per frame with all that the metrics need of its spectrum, made in the task that transforms it.

    rolloff_hz: lowest frequency with `share` of the magnitude at or below it. centroid: null in a silent frame. rise: mean rise
    of the magnitudes since the frame before, null without one. pitch, pitch_before: power by pitch class, the largest 1, of the
    frame and the one before (null without one). psd_sum, frames: the sum of a block's powers by bin and how many they are, on
    the block's first frame, so that means over a series merge from a row per block. step_hz: width of a bin.
    """
    hz = np.arange(size // 2 + 1) * rate_hz / size
    classes, of = np.unique(np.mod(np.floor(12 * np.log2(hz[1:] / reference_hz) + 0.5), 12), return_inverse=True)
    member = (of[:, None] == np.arange(len(classes))).astype(float)

    def make(first: int, frames: np.ndarray, numbers: np.ndarray) -> pd.DataFrame:
        power, magnitude = _power(frames, rate_hz)
        below = np.cumsum(magnitude, 1)
        total = below[:, -1]
        pitch = power[:, 1:] @ member
        pitch /= np.maximum(pitch.max(1, keepdims=True, initial=0.0), 1e-20)
        follows = np.r_[False, numbers[1:] == numbers[:-1] + 1][: len(numbers)]
        rise = np.full(len(numbers), np.nan)
        rise[1:] = np.maximum(np.diff(magnitude, axis=0), 0).mean(1)
        own = np.flatnonzero(numbers >= first)
        sums = [None] * len(own)
        if len(own):
            sums[0] = power[own].sum(0)
        return pd.DataFrame({
            "frame": numbers[own], "rolloff_hz": hz[(below >= share * total[:, None]).argmax(1)][own],
            "centroid": pd.Series(np.where(total > 0, (magnitude @ hz) / np.maximum(total, 1e-300), np.nan)[own], dtype="object").where(total[own] > 0, None),
            "rise": [float(rise[i]) if follows[i] else None for i in own], "pitch": _objects(pitch[own]), "pitch_before": _objects([pitch[i - 1] if follows[i] else None for i in own]),
            "psd_sum": _objects(sums), "frames": np.full(len(own), len(own), np.int64), "step_hz": np.full(len(own), rate_hz / size),
        })

    return _framed(signal, size, make, "frame long, rolloff_hz double, centroid double, rise double, pitch array<double>, pitch_before array<double>, psd_sum array<double>, frames long, step_hz double")


def _welch(features: DataFrame) -> DataFrame:
    """(series_id, hz, psd): mean power by bin, merged from a row per block."""
    rows = features.filter("psd_sum IS NOT NULL").select("series_id", "frames", "step_hz", F.posexplode("psd_sum").alias("bin", "p"))
    return rows.groupBy("series_id", "bin").agg((F.sum("p") / F.sum("frames")).alias("psd"), (F.first("step_hz") * F.col("bin")).alias("hz"))


def band_balance(features: DataFrame, warm=WARM, present=PRESENT) -> DataFrame:
    """Energy of a low and a high band; passes if the low one is not smaller."""
    band = lambda b: F.coalesce(F.sum(F.when(F.col("hz").between(*b), F.col("psd"))), F.lit(0.0))
    rows = _welch(features).groupBy("series_id").agg(band(warm).alias("warmth"), band(present).alias("presence"))
    return rows.withColumn("passed", F.col("warmth") >= F.col("presence"))


def rolloff(features: DataFrame, max_hz: float = MAX_ROLLOFF) -> DataFrame:
    """Median over frames of the frequency below which the features' share of the magnitude lies."""
    rows = exact_quantile(features.select("series_id", "rolloff_hz"), "series_id", "rolloff_hz", 0.5)
    return rows.withColumn("passed", F.col("rolloff_hz") <= max_hz)


def flatness(features: DataFrame, band=BAND, most: float = MAX_FLATNESS) -> DataFrame:
    """Geometric over arithmetic mean of the power in a band; 0 if the band is empty."""
    p = F.greatest("psd", F.lit(1e-20))
    inside = F.col("hz").between(*band)
    rows = _welch(features).groupBy("series_id").agg((F.exp(F.avg(F.when(inside, F.ln(p)))) / F.avg(F.when(inside, p))).alias("flatness"))
    return rows.withColumn("flatness", F.coalesce("flatness", F.lit(0.0))).withColumn("passed", F.col("flatness") <= most)


def centroid_variation(features: DataFrame, most: float = MAX_CENTROID) -> DataFrame:
    """Deviation of the frames' centroids in per cent of their mean; silent frames have none."""
    rows = features.groupBy("series_id").agg((F.stddev_pop("centroid") / F.greatest(F.avg("centroid"), F.lit(1.0)) * 100).alias("variation"))
    return rows.withColumn("passed", F.col("variation") <= most)


def harmonic_stability(features: DataFrame, least: float = MIN_HARMONIC) -> DataFrame:
    """Correlation of each pitch class with itself one frame on, averaged; a class that does not change counts 1."""
    before = F.coalesce("pitch_before", F.transform("pitch", lambda _: F.lit(None).cast("double")))
    rows = features.select("series_id", F.posexplode(F.arrays_zip(F.col("pitch").alias("p"), before.alias("before"))).alias("pitch", "of")).select("series_id", "pitch", "of.p", "of.before")
    classes = rows.groupBy("series_id", "pitch").agg(F.stddev_pop("p").alias("s"), F.try_divide(F.covar_pop("before", "p"), F.stddev_pop("before") * F.stddev_pop(F.when(F.col("before").isNotNull(), F.col("p")))).alias("c"), F.count(F.lit(1)).alias("n"))
    value = F.when((F.col("s") < 1e-8) | (F.col("n") < 2), 1.0).when(~F.isnan("c"), F.col("c"))
    return classes.groupBy("series_id").agg(F.coalesce(F.avg(value), F.lit(0.0)).alias("stability")).withColumn("passed", F.col("stability") >= least)


def onsets(features: DataFrame) -> DataFrame:
    """(series_id, frame, strength): mean rise of the magnitudes since the frame before; a frame without one before it has none."""
    return features.select("series_id", "frame", F.col("rise").alias("strength")).filter("strength IS NOT NULL")


def onset_strength(features: DataFrame, most: float = ONSET_RATIO) -> DataFrame:
    """Largest over median onset; 0 if there is next to none."""
    found = written(onsets(features))
    middle = exact_quantile(found, "series_id", "strength", 0.5).withColumnRenamed("strength", "mid")
    rows = found.groupBy("series_id").agg(F.max("strength").alias("top"), F.count(F.lit(1)).alias("n")).join(middle, "series_id")
    ratio = F.when((F.col("n") < 2) | (F.col("mid") < 1e-8), 0.0).otherwise(F.col("top") / F.col("mid"))
    return rows.select("series_id", ratio.alias("onset_ratio"), (ratio < most).alias("passed"))


def onset_density(features: DataFrame, lengths: DataFrame, most: float = ONSET_DENSITY, around: int = 3, above: float = 1.5) -> DataFrame:
    """lengths(series_id, duration_sec): onsets per second. An onset is a local maximum above `above` times the mean around it."""
    s = F.col("strength")

    def peaks(w) -> dict:
        high = (s >= F.coalesce(F.lag("strength").over(w), s)) & (s > F.coalesce(F.lead("strength").over(w), F.lit(-1.0)))
        return {"peak": high & (s > above * F.avg("strength").over(w.rowsBetween(-around, around)))}

    rows = L.blocked(onsets(features).withColumnRenamed("frame", "pos"), around, around, peaks)
    counts = rows.groupBy("series_id").agg(F.count_if("peak").alias("n"))
    rate = F.when(F.col("duration_sec") < 1.0, 0.0).otherwise(F.coalesce("n", F.lit(0)) / F.col("duration_sec"))
    return lengths.join(counts, "series_id", "left").select("series_id", rate.alias("onsets_per_sec"), (rate <= most).alias("passed"))


def mel_bands(rate_hz: float, size: int, bands: int = MELS) -> np.ndarray:
    """Weights by band and bin: triangles of equal area, evenly spaced in mel from 0 to half the rate.

    The mel scale is even up to 1,000 Hz and logarithmic above. A band narrower than a bin may hold none and is all zeros.
    """
    linear, ratio = 200.0 / 3, np.log(6.4) / 27
    knee = 1000.0 / linear
    top = rate_hz / 2
    mel = np.linspace(0, top / linear if top < 1000 else knee + np.log(top / 1000.0) / ratio, bands + 2)
    edge = np.where(mel < knee, mel * linear, 1000.0 * np.exp(ratio * (mel - knee)))
    hz = np.arange(size // 2 + 1) * rate_hz / size
    low, mid, high = (edge[i : bands + i, None] for i in range(3))
    return np.maximum(0, np.minimum((hz - low) / (mid - low), (high - hz) / (high - mid))) * 2 / (high - low)


def boundary_similarity(chunks: DataFrame, overlap: int, rate_hz: float, size: int = 2048, least_rows: int = 1024, least: float = MIN_SIMILARITY, bands: int = MELS) -> DataFrame:
    """chunks(series_id, chunk_no, pos, value): cosine of the mean mel spectra of a chunk's last and the next one's first `overlap`
    rows; ends shorter than `least_rows`, or than a frame, count 1.

    A boundary's rows, twice `overlap` at most, meet in one group; no other rows are shuffled but for their chunk's length.
    """
    weights = mel_bands(rate_hz, size, bands)
    rows = chunks.select("series_id", "chunk_no", "pos", F.col("value").cast("double").alias("value"))
    n = written(rows.groupBy("series_id", "chunk_no").agg((F.max("pos") + 1).alias("n")))
    from_end = F.col("pos") - F.greatest(F.col("n") - overlap, F.lit(0))
    ends = rows.join(n, ["series_id", "chunk_no"])
    tails = ends.filter(from_end >= 0).select("series_id", F.col("chunk_no").cast("long").alias("boundary"), F.lit(0).alias("side"), from_end.alias("at"), "value")
    heads = rows.filter(F.col("pos") < overlap).select("series_id", (F.col("chunk_no") - 1).cast("long").alias("boundary"), F.lit(1).alias("side"), F.col("pos").alias("at"), "value")

    def compare(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        means = []
        for side in (0, 1):
            own = rows[rows["side"] == side].sort_values("at")["value"].to_numpy()
            if len(own) >= size:
                frames = np.lib.stride_tricks.sliding_window_view(own, size)[:: size // 2]
                means.append(weights @ _power(frames, rate_hz)[0].mean(0))
        if len(means) < 2:
            return pd.DataFrame({"of": _objects([]), "at": np.zeros(0, np.int64), "cos": np.zeros(0)})
        return pd.DataFrame({"of": _objects([key[0]]), "at": [key[1]], "cos": [means[0] @ means[1] / max(np.sqrt(means[0] @ means[0]) * np.sqrt(means[1] @ means[1]), 1e-8)]})

    kind = chunks.schema["series_id"].dataType.simpleString()
    found = tails.unionByName(heads).groupBy("series_id", "boundary").applyInPandas(compare, f"of {kind}, at long, cos double")
    order = Window.partitionBy("series_id").orderBy("chunk_no")  # a row per chunk
    pairs = n.select("series_id", F.col("chunk_no").alias("boundary"), F.least(F.col("n"), F.lead("n").over(order), F.lit(overlap)).alias("rows"), F.lead("n").over(order).alias("next")).filter("next IS NOT NULL")
    value = F.when(F.col("rows") < least_rows, 1.0).otherwise(F.coalesce("cos", F.lit(1.0)))
    return pairs.join(found, (F.col("series_id") == F.col("of")) & (F.col("boundary") == F.col("at")), "left").select("series_id", "boundary", value.alias("similarity"), (value >= least).alias("passed"))


def level_ratio(voice: DataFrame, music: DataFrame, activity: DataFrame, least_db: float = MIN_RATIO_DB) -> DataFrame:
    """(pos, value) twice and (pos, active): dB between both on active rows; infinite without any."""
    rows = activity.filter("active").join(voice.select("pos", F.col("value").alias("v")), "pos").join(music.select("pos", F.col("value").alias("m")), "pos")
    rms = lambda c: F.sqrt(F.avg(F.col(c) * F.col(c)) + 1e-10)
    ratio = F.coalesce(20 * F.log10(rms("v") / rms("m")), F.lit(float("inf")))
    return rows.agg(ratio.alias("ratio_db")).withColumn("passed", F.col("ratio_db") >= least_db)


def gain_rate(signal: DataFrame, rate_hz: float, window_ms: float = 100.0, most: float = MAX_RATE) -> DataFrame:
    """99th percentile of how fast the level moves, in dB per second."""
    window = max(1, int(window_ms * rate_hz / 1000))
    level = L.sliding_rms(signal, window).select("series_id", "pos", (20 * F.log10(F.sqrt(F.col("env") * F.col("env") + 1e-10))).alias("level"))
    rows = L.blocked(level, 1, 0, lambda w: {"step": F.abs(F.col("level") - F.lag("level").over(w)) * rate_hz})
    return exact_quantile(rows.withColumnRenamed("step", "rate"), "series_id", "rate", 0.99).withColumn("passed", F.col("rate") <= most)


def metrics(signal: DataFrame, rate_hz: float, size: int, warm=WARM, present=PRESENT, band=BAND, weighted: bool = True, quiet: float = L.SILENCE) -> DataFrame:
    """All metrics and their verdicts, one row per series: what report and score are made from.

    Eleven metrics read the series, seven of them the features of its frames; both are written once.
    """
    signal = written(signal)
    features = written(frame_features(signal, rate_hz, size))
    lengths = signal.groupBy("series_id").agg(((F.max("pos") + 1) / rate_hz).alias("duration_sec"))
    tables = {
        "balance": band_balance(features, warm, present), "rolloff": rolloff(features), "onset": onset_strength(features), "clipping": L.clipping(signal), "flatness": flatness(features, band),
        "centroid": centroid_variation(features), "harmony": harmonic_stability(features), "density": onset_density(features, lengths), "dynamics": L.dynamic_range(signal, int(rate_hz)),
        "silence": L.silence_ratio(signal, max(1, int(0.05 * rate_hz)), quiet), "loudness": L.gated_loudness(signal, rate_hz, LOUDNESS, weighted).select("series_id", "lufs", (F.abs(F.col("lufs") - LOUDNESS) <= TOLERANCE).alias("passed")),
    }
    rows = lengths
    for name, t in tables.items():
        rows = rows.join(t.withColumnRenamed("passed", f"{name}_passed"), "series_id", "left")
    return rows


MUSIC_CHECKS = {"onset": "onset_ratio", "flatness": "flatness", "centroid": "variation", "harmony": "stability", "density": "onsets_per_sec", "dynamics": "rms_std"}
CHECKS = {"loudness": ["lufs"], "clipping": ["clipped_ratio"], "balance": ["warmth", "presence"], "silence": ["silence_ratio"], "rolloff": ["rolloff_hz"], **{k: [v] for k, v in MUSIC_CHECKS.items()}}


def qa_report(rows: DataFrame, speech_or_own_music: str = "false") -> DataFrame:
    """(series_id, check, metric map, passed) from `metrics`; six checks are skipped (passed, null) where the condition holds."""
    skip = F.expr(speech_or_own_music)
    entries = []
    for check, names in CHECKS.items():
        value = lambda n, c=check: F.when(skip, F.lit(None)).otherwise(F.col(n)).cast("double") if c in MUSIC_CHECKS else F.col(n).cast("double")
        metric = F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*map(value, names)))
        ok = F.coalesce(F.col(f"{check}_passed"), F.lit(False))
        entries.append(F.struct(F.lit(check).alias("check"), metric.alias("metric"), (skip | ok if check in MUSIC_CHECKS else ok).alias("passed")))
    return rows.select("series_id", F.explode(F.array(*entries)).alias("e")).select("series_id", "e.*")


def composite_score(rows: DataFrame) -> DataFrame:
    """Weighted sum of ten partial scores, each 1 if the check passes, less by how far it is overshot; 4 decimals."""
    def overshot(value: str, limit: float, by: float):
        return F.greatest(F.lit(0.0), 1 - (F.col(value) / limit - 1) / by)

    part = {
        "balance": F.when(F.col("warmth") + F.col("presence") > 0, F.least(F.col("warmth") / (F.col("warmth") + F.col("presence")) / 0.6, F.lit(1.0))).otherwise(0.5),
        "rolloff": F.when(F.col("rolloff_hz") <= MAX_ROLLOFF, 1.0).otherwise(overshot("rolloff_hz", MAX_ROLLOFF, 1.0)),
        "onset": F.when(F.col("onset_passed"), 1.0).otherwise(overshot("onset_ratio", ONSET_RATIO, 2.0)),
        "clipping": F.when(F.col("clipping_passed"), 1.0).otherwise(F.greatest(F.lit(0.0), 1 - F.col("clipped_ratio") * 1000)),
        "loudness": F.greatest(F.lit(0.0), 1 - F.abs(F.col("lufs") - LOUDNESS) / 10),
        "flatness": F.when(F.col("flatness_passed"), 1.0).otherwise(overshot("flatness", MAX_FLATNESS, 2.33)),
        "centroid": F.when(F.col("centroid_passed"), 1.0).otherwise(overshot("variation", MAX_CENTROID, 1.0)),
        "harmony": F.when(F.col("harmony_passed"), 1.0).otherwise(F.greatest(F.lit(0.0), F.col("stability") / MIN_HARMONIC)),
        "density": F.when(F.col("density_passed"), 1.0).otherwise(overshot("onsets_per_sec", ONSET_DENSITY, 2.0)),
        "dynamics": F.when(F.col("dynamics_passed"), 1.0).otherwise(overshot("rms_std", MAX_RMS_STD, 3.0)),
    }
    score = sum((F.coalesce(part[k], F.lit(0.0)) * w for k, w in WEIGHTS.items()), F.lit(0.0))
    return rows.select("series_id", F.round(score, 4).alias("score"))


def best_candidate(attempts: DataFrame, most: int = 3, enough: float = 0.8) -> DataFrame:
    """attempts(job_id, attempt, valid, score): of the first `most`, up to the first score above `enough`, the highest; first on ties. Invalid: 0."""
    order = Window.partitionBy("job_id").orderBy("attempt")
    rows = attempts.withColumn("score", F.when(F.col("valid"), F.col("score")).otherwise(0.0)).withColumn("n", F.row_number().over(order)).filter(F.col("n") <= most)
    before = F.coalesce(F.max("score").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rows = rows.withColumn("before", before).filter(F.col("before") <= enough)
    best = rows.groupBy("job_id").agg(F.max_by(F.struct("attempt", "score"), F.struct("score", -F.col("attempt"))).alias("b"))
    return best.select("job_id", "b.attempt", "b.score")
