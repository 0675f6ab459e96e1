"""Joining and aligning series: overlays, mixes, fits to a length, cross-fades, resampling."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .frames import clamp, onepole_envelope
from .gain import apply_gain, combine_gain, detect_phrases, fades, safety_gain, script_gain


#: Positions that one row of the axis is spread to.
STRETCH = 10_000


def _axis(df: DataFrame, n: Column, name: str) -> DataFrame:
    """df, a row or few, with each position from 0 to n - 1 as `name`: stretches first, dealt over the tasks, then positions."""
    rows = df.withColumn("__n", n.cast("long")).filter("__n > 0")
    rows = rows.withColumn("__s", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("__n") - 1) / STRETCH)))).repartition("__s")
    rows = rows.withColumn(name, F.explode(F.sequence(F.col("__s") * STRETCH, F.least((F.col("__s") + 1) * STRETCH, F.col("__n")) - 1)))
    return rows.drop("__n", "__s")


def length_of(series: DataFrame) -> DataFrame:
    return series.agg((F.max("pos") + 1).alias("n"))


def align_overlay(voice: DataFrame, music: DataFrame, rate_hz: float, pre_roll_sec: float = 4.0, post_roll_sec: float = 8.0) -> DataFrame:
    """(pos, voice, music) over pre-roll + voice + post-roll; what is missing is 0."""
    pre, post = int(pre_roll_sec * rate_hz), int(post_roll_sec * rate_hz)
    rows = _axis(length_of(voice), F.col("n") + pre + post, "pos").select("pos")
    rows = rows.join(voice.select((F.col("pos") + pre).alias("pos"), F.col("value").alias("voice")), "pos", "left")
    rows = rows.join(music.select("pos", F.col("value").alias("music")), "pos", "left")
    return rows.select("pos", F.coalesce("voice", F.lit(0.0)).alias("voice"), F.coalesce("music", F.lit(0.0)).alias("music"))


def mix(voice: DataFrame, music: DataFrame, rate_hz: float, duck_db: float = -15.0, music_db: float = -16.0, pre_roll_sec: float = 8.0, post_roll_sec: float = 15.0, fade_in_sec: float = 3.0, fade_out_sec: float = 8.0) -> DataFrame:
    """(pos, value): aligned, the music lowered and under the combined gain of phrases and level, summed, faded."""
    both = align_overlay(voice, music, rate_hz, pre_roll_sec, post_roll_sec)
    spoken = both.select(F.lit("v").alias("series_id"), "pos", F.col("voice").alias("value"))
    phrases = detect_phrases(onepole_envelope(spoken, rate_hz), rate_hz)
    lengths = both.agg(((F.max("pos") + 1) / rate_hz).alias("duration_sec")).select(F.lit("v").alias("series_id"), "duration_sec")
    gain = combine_gain(script_gain(phrases, lengths, rate_hz, duck_db), safety_gain(spoken, rate_hz, duck_db))
    bed = apply_gain(both.select("pos", (F.col("music") * (10 ** (music_db / 20))).alias("value")), gain)
    mixed = both.join(bed, "pos").select(F.lit("mix").alias("series_id"), "pos", (F.col("voice") + F.col("value")).alias("value"))
    return fades(mixed, rate_hz, fade_in_sec, fade_out_sec).select("pos", "value")


def fit_plan(jobs: DataFrame, crossfade_ms: float = 500.0) -> DataFrame:
    """jobs(job_id, n_source, n_target, rate_hz): mode, loops, seconds and the length of the seams.

    Seams are at most a quarter of the source; below 4 ms there are none and the source is tiled.
    """
    seam = F.least(F.floor(F.col("rate_hz") * (crossfade_ms / 1000)), F.floor(F.col("n_source") / 4))
    seam = F.when(seam < F.floor(F.col("rate_hz") * 0.004), 0).otherwise(seam)
    rows = jobs.withColumn("seam", seam)
    kept = (F.col("n_target") == 0) | (F.col("n_source") == F.col("n_target"))
    mode = F.when(kept, "used_as_is").when(F.col("n_source") > F.col("n_target"), "trimmed").when(F.col("seam") == 0, "tiled_no_xfade").otherwise("looped")
    rows = rows.withColumn("mode", mode)
    loops = F.when(F.col("mode") == "tiled_no_xfade", F.ceil(F.col("n_target") / F.col("n_source"))).when(F.col("mode") == "looped", 1 + F.ceil((F.col("n_target") - F.col("n_source")) / (F.col("n_source") - F.col("seam")))).otherwise(1)
    return rows.withColumn("loops", loops.cast("long")).withColumn("seam", F.when(F.col("mode") == "looped", F.col("seam")).otherwise(0).cast("long"))


def fit_report(jobs: DataFrame, crossfade_ms: float = 500.0) -> DataFrame:
    rows = fit_plan(jobs, crossfade_ms)
    return rows.select("job_id", "mode", "loops", (F.col("n_source") / F.col("rate_hz")).alias("source_sec"), (F.col("n_target") / F.col("rate_hz")).alias("target_sec"), (F.col("seam") * 1000.0 / F.col("rate_hz")).alias("seam_ms"))


def fit_length(source: DataFrame, n_target: int, rate_hz: int, crossfade_ms: float = 500.0) -> DataFrame:
    """source(pos, value) made exactly n_target rows: as is, trimmed, looped with equal-power seams, or tiled.

    Loop k begins at k times the source less the seam. Rows in a seam are read twice: from the end of one loop, fading, and from
    the start of the next, rising; everything is one join by source position and one sum.
    """
    n = length_of(source).select(F.lit(0).alias("job_id"), F.col("n").alias("n_source"), F.lit(n_target).alias("n_target"), F.lit(rate_hz).alias("rate_hz"))
    plan = fit_plan(n, crossfade_ms)
    rows = _axis(plan.select("n_source", "seam", "n_target"), F.col("n_target"), "out")
    stride = F.col("n_source") - F.col("seam")
    loop = F.floor(F.col("out") / stride)
    place = F.col("out") - loop * stride
    seam = (place < F.col("seam")) & (loop > 0)
    t = place / F.col("seam") * (math.pi / 2)
    one = lambda pos, w: F.struct(pos.cast("long").alias("pos"), w.alias("w"))
    reads = F.when(seam, F.array(one(place, F.sin(t)), one(place + stride, F.cos(t)))).otherwise(F.array(one(place, F.lit(1.0))))
    rows = rows.withColumn("r", F.explode(reads)).select("out", F.col("r.pos").alias("pos"), F.col("r.w").alias("w"))
    return rows.join(source.select("pos", "value"), "pos").groupBy("out").agg(F.sum(F.col("value") * F.col("w")).alias("value")).withColumnRenamed("out", "pos")


def crossfade_concat(chunks: DataFrame, overlap: int, curve: str = "cos2") -> DataFrame:
    """chunks(series_id, chunk_no, pos, value) to (series_id, pos, value): neighbours overlap by `overlap` rows, by half of either at most.

    cos2: squared cosines, ends included; equal_power: cosine and sine, the end left out.
    """
    sizes = chunks.groupBy("series_id", "chunk_no").agg((F.max("pos") + 1).alias("n"))
    order = Window.partitionBy("series_id").orderBy("chunk_no")  # a row per chunk
    half = lambda c: F.floor(c / 2)
    with_last = F.when(F.lag("n").over(order).isNull(), 0).otherwise(F.least(F.lit(overlap), half(F.lag("n").over(order)), half(F.col("n"))))
    sizes = sizes.withColumn("head", F.when(with_last < 2, 0).otherwise(with_last)).withColumn("tail", F.coalesce(F.lead("head").over(order), F.lit(0)))
    sizes = sizes.withColumn("start", F.coalesce(F.sum(F.col("n") - F.col("tail")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rows = chunks.join(sizes, ["series_id", "chunk_no"])
    last = 1 if curve == "cos2" else 0
    angle = lambda place, n: place / (n - last) * (math.pi / 2)
    out_place = F.col("pos") - (F.col("n") - F.col("tail"))
    rise, fall = F.sin(angle(F.col("pos"), F.col("head"))), F.cos(angle(out_place, F.col("tail")))
    if curve == "cos2":
        rise, fall = rise * rise, fall * fall
    weight = F.when(F.col("pos") < F.col("head"), rise).otherwise(1.0) * F.when(out_place >= 0, F.when(F.col("tail") > 0, fall).otherwise(1.0)).otherwise(1.0)
    return rows.groupBy("series_id", (F.col("start") + F.col("pos")).alias("out")).agg(F.sum(F.col("value") * weight).alias("value")).withColumnRenamed("out", "pos")


def downmix(signal: DataFrame) -> DataFrame:
    """Mean over channels."""
    return signal.groupBy("series_id", "pos").agg(F.avg("value").alias("value"))


def wet_dry_blend(dry: DataFrame, wet: DataFrame, wet_amount: float) -> DataFrame:
    rows = dry.join(wet.select("pos", F.col("value").alias("wet")), "pos")
    return rows.select("pos", clamp((1.0 - wet_amount) * F.col("value") + wet_amount * F.col("wet")).alias("value"))


def resample_linear(series: DataFrame, rate_from: int, rate_to: int) -> DataFrame:
    """(pos, value) at another rate by linear interpolation; the last value is held. Each target row reads two source rows."""
    target = _axis(length_of(series), F.floor(F.col("n") * rate_to / rate_from), "out")
    exact = F.col("out") * F.lit(rate_from) / F.lit(float(rate_to))
    low = F.least(F.floor(exact), F.col("n") - 1)
    part = F.least(exact, F.col("n") - 1.0) - low
    reads = F.array(F.struct(low.alias("pos"), (1 - part).alias("w")), F.struct(F.least(low + 1, F.col("n") - 1).alias("pos"), part.alias("w")))
    rows = target.withColumn("r", F.explode(reads)).select("out", F.col("r.pos").alias("pos"), F.col("r.w").alias("w"))
    return rows.join(series.select("pos", "value"), "pos").groupBy("out").agg(F.sum(F.col("value") * F.col("w")).alias("value")).withColumnRenamed("out", "pos")


def repeat_upsample(mask: DataFrame, times: int, n_target: int) -> DataFrame:
    """mask(pos, active) with each row `times` times, cut to n_target rows or filled up with false."""
    rows = mask.select("active", F.explode(F.sequence(F.col("pos") * times, F.col("pos") * times + (times - 1))).alias("pos"))
    target = mask.sparkSession.range(n_target).withColumnRenamed("id", "pos")
    return target.join(rows, "pos", "left").select("pos", F.coalesce("active", F.lit(False)).alias("active"))


def dedupe_asset_cache(segments: DataFrame, rate_hz: int) -> DataFrame:
    """Each (subtype, rate) that breath rows ask for, once."""
    return segments.filter("type = 'breath'").select("subtype", F.lit(rate_hz).alias("rate_hz")).dropDuplicates(["subtype", "rate_hz"])
