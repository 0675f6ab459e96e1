"""Timeline planning: gaps, pacing, offsets, seeds, pieces of long jobs, routing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .segments import words

# Fixed values, in seconds unless said otherwise.
ELLIPSIS_PAUSE, SENTENCE_PAUSE = 1.2, 0.8
CHUNK_GAP, CHUNK_GAP_LONG = 0.4, 0.6
BREATH = 1.2
SESSION, REST = 570.0, 0.5
GENESIS, CONTINUATION, OVERLAP, NEAR = 90.0, 60.0, 20.0, 1.0
STAGE_EXTRA, NARRATION_EXTRA = 5.0, 15.0


def _order():
    return Window.partitionBy("script_id").orderBy("seg_no")


def insert_gaps(segments: DataFrame, gap_sec: float = CHUNK_GAP) -> DataFrame:
    """A gap row of `gap_sec` between two speech rows that follow each other; item_no is the new order."""
    follows = (F.col("type") == "speech") & (F.lag("type").over(_order()) == "speech")
    rows = segments.withColumn("kinds", F.when(follows, F.array(F.lit("gap"), F.col("type"))).otherwise(F.array("type")))
    rows = rows.select("script_id", "seg_no", F.posexplode("kinds").alias("k", "item"), "text", "duration_sec", "voice")
    own = F.col("item") != "gap"
    by = Window.partitionBy("script_id").orderBy("seg_no", "k")
    return rows.select(
        "script_id", (F.row_number().over(by) - 1).alias("item_no"), F.col("item").alias("type"), F.when(own, F.col("text")).alias("text"),
        F.when(own, F.col("duration_sec")).otherwise(F.lit(gap_sec)).alias("duration_sec"), F.when(own, F.col("voice")).alias("voice"),
    )


def sentence_gaps(sentences: DataFrame) -> DataFrame:
    """sentences(script_id, seg_no, sent_no, text, next_type): the gap after each, 0 before a written pause and at the very end.

    next_type: the type of the segment behind the sentence's own, null at the end of the script.
    """
    last = F.lead("sent_no").over(Window.partitionBy("script_id", "seg_no").orderBy("sent_no")).isNull()
    none = last & (F.col("next_type").isNull() | (F.col("next_type") == "pause"))
    gap = F.when(none, 0.0).when(F.col("text").rlike(r"(\.\.\.|…)\s*$"), ELLIPSIS_PAUSE).otherwise(SENTENCE_PAUSE)
    return sentences.withColumn("gap_sec", gap)


def wpm_seconds(text: Column, wpm: float = 140.0) -> Column:
    return words(text) / F.lit(float(wpm)) * 60.0


def pace_by_wpm(items: DataFrame, wpm: float = 140.0, reference_sec: float = 0.0, model: Callable[[Column], Column] | None = None) -> DataFrame:
    """duration_sec of speech rows: words / wpm minutes plus the reference clip, or what `model` (a column function) gives; breaths are 1.2 s."""
    speech = model(F.col("text")) if model else wpm_seconds(F.col("text"), wpm) + F.lit(float(reference_sec))
    return items.withColumn("duration_sec", F.when(F.col("type") == "speech", speech).when(F.col("type") == "breath", F.lit(BREATH)).otherwise(F.col("duration_sec")))


def timeline_offsets(items: DataFrame, overlap_sec: float = 0.0) -> DataFrame:
    """start_sec and end_sec by running total, less the overlap of an item with the one before; active marks speech."""
    by = Window.partitionBy("script_id").orderBy("item_no")
    joined = (F.col("type") == "speech") & (F.lag("type").over(by) == "speech")
    rows = items.withColumn("overlap", F.when(joined, F.lit(float(overlap_sec))).otherwise(F.lit(0.0)))
    end = F.sum(F.col("duration_sec") - F.col("overlap")).over(by.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("end_sec", end).withColumn("start_sec", F.col("end_sec") - F.col("duration_sec")).withColumn("active", F.col("type") == "speech").drop("overlap")


def chunk_seeds(segments: DataFrame, seed: int = 42) -> DataFrame:
    """Speech rows with seed + their number among speech rows."""
    n = F.sum((F.col("type") == "speech").cast("long")).over(_order().rowsBetween(Window.unboundedPreceding, 0))
    return segments.withColumn("chunk_seed", F.when(F.col("type") == "speech", F.lit(seed) + n - 1)).filter("type = 'speech'")


def phase_asset_join(segments: DataFrame, assets: DataFrame) -> DataFrame:
    """assets(phase, audio_path, ordinal), one per phase: the asset of the row's voice, else `default`, else the first phase.

    The fallback is one row; the assets are a catalogue, whose size the planner knows.
    """
    fallback = assets.agg(F.coalesce(F.max(F.when(F.col("phase") == "default", F.col("audio_path"))), F.min_by("audio_path", "ordinal")).alias("other"))
    exact = assets.select(F.col("phase").alias("voice"), F.col("audio_path").alias("exact"))
    rows = segments.join(exact, "voice", "left").join(F.broadcast(fallback))
    return rows.withColumn("audio_path", F.coalesce("exact", "other")).drop("exact", "other")


def split_sessions(jobs: DataFrame, seconds: str = "duration_sec") -> DataFrame:
    """Pieces of at most SESSION seconds in order; a rest of REST or less is dropped."""
    n = F.ceil(F.col(seconds) / SESSION).cast("int")
    rows = jobs.select("job_id", seconds, F.explode(F.when(n > 0, F.sequence(F.lit(0), n - 1))).alias("piece"))
    left = F.col(seconds) - F.col("piece") * F.lit(SESSION)
    return rows.withColumn("piece_sec", F.least(left, F.lit(SESSION))).filter(left > REST)


def plan_continuations(jobs: DataFrame, seconds: str = "duration_sec") -> DataFrame:
    """A first piece of at most 90 s, then pieces of at most 60 s, with 20 s of context, until within 1 s of the target."""
    more = F.greatest(F.ceil((F.col(seconds) - (GENESIS + NEAR)) / CONTINUATION), F.lit(0)).cast("int")
    rows = jobs.select("job_id", seconds, F.explode(F.sequence(F.lit(0), more)).alias("piece"))
    start = F.when(F.col("piece") == 0, F.lit(0.0)).otherwise(F.lit(GENESIS) + (F.col("piece") - 1) * CONTINUATION)
    rows = rows.withColumn("start_sec", start)
    length = F.when(F.col("piece") == 0, F.least(F.lit(GENESIS), F.col(seconds))).otherwise(F.least(F.lit(CONTINUATION), F.col(seconds) - F.col("start_sec")))
    return rows.withColumn("piece_sec", length).withColumn("context_sec", F.when(F.col("piece") == 0, 0.0).otherwise(OVERLAP))


def plan_stages(jobs: DataFrame, crossfade_sec: float = 6.0) -> DataFrame:
    """jobs(job_id, stages array<struct<prompt, seconds>>): a row per stage with its start, and the job's total (sum + 5 s)."""
    total = F.aggregate("stages", F.lit(0.0), lambda a, s: a + s["seconds"]) + STAGE_EXTRA
    rows = jobs.select("job_id", total.alias("total_sec"), F.posexplode("stages").alias("stage", "s"))
    before = Window.partitionBy("job_id").orderBy("stage").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.col("s.seconds") - F.lit(crossfade_sec)).over(before), F.lit(0.0))
    return rows.select("job_id", "stage", F.col("s.prompt").alias("prompt"), F.col("s.seconds").alias("seconds"), start.alias("start_sec"), "total_sec")


def route_jobs(jobs: DataFrame) -> DataFrame:
    """jobs(job_id, mode, music, engine): mix and export rate, pre-mix level, denoise share."""
    native = F.col("music").isin("cloud", "local", "upload")
    return jobs.select(
        "job_id", "mode", "music", "engine",
        F.when(native | F.col("engine").isin("second", "third"), 48000).otherwise(44100).alias("mix_rate"),
        F.when(native, 48000).otherwise(44100).alias("export_rate"),
        F.when(F.col("music") == "local", -14.0).otherwise(-16.0).alias("premix_lufs"),
        F.when(F.col("mode") == "Instrumental Only", F.lit(None).cast("double")).when(F.col("engine") == "third", 0.10).when(F.col("engine") == "first", 0.25).otherwise(1.0).alias("denoise_wet"),
    )


def background_length(jobs: DataFrame) -> DataFrame:
    """jobs(job_id, stage_sec, fixed_min, narration_sec): stage sum + 5, else the fixed minutes, else narration + 15."""
    length = F.when(F.col("stage_sec").isNotNull(), F.col("stage_sec") + STAGE_EXTRA).when(F.col("fixed_min").isNotNull(), F.col("fixed_min") * 60.0).otherwise(F.col("narration_sec") + NARRATION_EXTRA)
    return jobs.withColumn("music_sec", length)
