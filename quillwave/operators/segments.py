"""Scripts to segment tables: tags, paragraph breaks, runs of pauses, voices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Tag syntax and pause lengths in seconds.
PAUSE_ALIAS = r"\[(\d+(?:\.\d+)?)\s*(?:second|sec|s)\s*pause\]"
BREATHS = ("breath", "inhale", "exhale")
PAUSE = r"\[pause:\d+(?:\.\d+)?s\]"
PARA = r"\[para-pause:\d+(?:\.\d+)?s\]"
BREATH = r"\[breath:(?:breath|inhale|exhale)\]"
VOICE = r"\[voice:[^\]]+\]"
PARAGRAPH_FIRST, PARAGRAPH_SECOND = 6.5, 3.0

SEGMENTS = ["script_id", "seg_no", "type", "text", "duration_sec", "source", "subtype", "voice"]


def _in_script():
    return Window.partitionBy("script_id").orderBy("seg_no")


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def normalize_tags(scripts: DataFrame) -> DataFrame:
    """`[2 second pause]` and the like become `[pause:2s]`; breath words, in any case, become `[breath:word]`."""
    text = F.regexp_replace("text", f"(?i){PAUSE_ALIAS}", "[pause:$1s]")
    for word in BREATHS:
        text = F.regexp_replace(text, rf"(?i)\[{word}\]", f"[breath:{word}]")
    return scripts.withColumn("text", text)


def tokenize_segments(scripts: DataFrame, voices: bool = True) -> DataFrame:
    """Ordered speech, pause, breath and (with `voices`) voice rows; blank speech and pauses of zero length are dropped.

    A marker gets a control character on either side, so a split gives text and markers in turn: one explode, one window.
    """
    kinds = [PAUSE, PARA, BREATH] + [VOICE] * voices
    parts = F.split(F.regexp_replace("text", f"({'|'.join(kinds)})", "\u0001$1\u0001"), "\u0001")
    rows = scripts.select("script_id", F.posexplode(parts).alias("part", "raw"))
    marker = F.col("part") % 2 == 1
    length = F.regexp_extract("raw", r"^\[(?:para-)?pause:(\d+(?:\.\d+)?)s\]$", 1)
    kind = F.when(~marker, "speech").when(F.col("raw").startswith("[breath:"), "breath").when(F.col("raw").startswith("[voice:"), "voice").otherwise("pause")
    rows = rows.withColumn("type", kind)
    rows = rows.select(
        "script_id", "part", "type",
        F.when(F.col("type") == "speech", strip(F.col("raw"))).alias("text"),
        F.when(F.col("type") == "pause", length.cast("double")).alias("duration_sec"),
        F.when(F.col("type") == "pause", F.when(F.col("raw").startswith("[para-"), "paragraph").otherwise("explicit")).alias("source"),
        F.when(F.col("type") == "breath", F.regexp_extract("raw", r"^\[breath:(.*)\]$", 1)).alias("subtype"),
        F.when(F.col("type") == "voice", strip(F.regexp_extract("raw", r"^\[voice:(.*)\]$", 1))).alias("voice"),
    )
    rows = rows.filter((F.coalesce(F.length("text"), F.lit(1)) > 0) & (F.coalesce("duration_sec", F.lit(1.0)) > 0))
    return _numbered(rows, "part")


def _numbered(rows: DataFrame, order: str) -> DataFrame:
    by = Window.partitionBy("script_id").orderBy(order)
    return rows.withColumn("seg_no", (F.row_number().over(by) - 1).cast("int")).select(*SEGMENTS)


def _merge_pauses(segments: DataFrame, length) -> DataFrame:
    """Each run of pauses becomes its first row, with `length`(window) of the run; a run is told by how many other rows stand before it.

    Every other row is a run of its own, so all rows go through the same windows, once, in one partitioning by script.
    """
    pause = F.col("type") == "pause"
    run = F.sum((~pause).cast("int")).over(_in_script().rowsBetween(Window.unboundedPreceding, 0))
    rows = segments.withColumn("run", run).withColumn("pause", pause)
    whole = Window.partitionBy("script_id", "run", "pause")
    rows = rows.withColumns({"total": length(whole), "from": F.min("source").over(whole), "k": F.row_number().over(whole.orderBy("seg_no"))}).filter("k = 1")
    rows = rows.withColumns({"duration_sec": F.col("total"), "source": F.col("from")})
    return _numbered(rows.withColumnRenamed("seg_no", "at"), "at")


def paragraph_pause_priority(scripts: DataFrame, pause_sec: float = PARAGRAPH_FIRST) -> DataFrame:
    """First policy: blank lines are pauses that give way to written ones in the same run. Voice tags stay in the text."""
    spoken = strip(F.col("text")) != ""
    marked = scripts.withColumn("text", F.when(spoken, F.regexp_replace("text", r"\n\n+", f" [para-pause:{pause_sec}s] ")).otherwise(F.col("text")))
    explicit = F.sum(F.when(F.col("source") == "explicit", F.col("duration_sec")))
    return _merge_pauses(tokenize_segments(normalize_tags(marked), voices=False), lambda w: F.coalesce(explicit.over(w), F.sum("duration_sec").over(w)))


def paragraph_pause_suppress(scripts: DataFrame, pause_sec: float = PARAGRAPH_SECOND) -> DataFrame:
    """Second policy: a blank line becomes a pause tag unless a block next to it is a lone pause tag. Array form, in the row."""
    blocks = F.split("text", r"\n\n+")
    lone = F.transform(blocks, lambda b: strip(b).rlike(rf"^{PAUSE}$"))
    between = lambda i: F.when(i == F.size(blocks) - 1, "").when(F.get(lone, i) | F.get(lone, i + 1), " ").otherwise(f" [pause:{pause_sec}s] ")
    joined = F.array_join(F.transform(blocks, lambda b, i: F.concat(b, between(i))), "")
    return scripts.withColumn("text", F.when(strip(F.col("text")) != "", joined).otherwise(F.col("text")))


def merge_pauses_sum(segments: DataFrame) -> DataFrame:
    """Back-to-back pauses add up."""
    return _merge_pauses(segments, lambda w: F.sum("duration_sec").over(w))


def merge_pauses_max(segments: DataFrame) -> DataFrame:
    """A run of pauses keeps the longest; a voice row between two pauses ends the run."""
    return _merge_pauses(segments, lambda w: F.max("duration_sec").over(w))


def voice_fill_forward(segments: DataFrame) -> DataFrame:
    """Speech gets the last voice named before it, null before the first; voice rows go."""
    voice = F.last("voice", ignorenulls=True).over(_in_script().rowsBetween(Window.unboundedPreceding, 0))
    rows = segments.withColumn("voice", F.when(F.col("type").isin("speech", "voice"), voice)).filter(F.col("type") != "voice")
    return _numbered(rows.withColumnRenamed("seg_no", "at"), "at")


def parse(scripts: DataFrame) -> DataFrame:
    """The second policy in full: tags, paragraphs, longest pauses, voices."""
    return voice_fill_forward(merge_pauses_max(tokenize_segments(paragraph_pause_suppress(normalize_tags(scripts)))))


def words(text: Column) -> Column:
    """Number of words between white space; 0 for null."""
    t = strip(F.coalesce(text, F.lit("")))
    return F.when(t == "", 0).otherwise(F.size(F.split(t, r"\s+"))).cast("long")


def segment_stats(segments: DataFrame) -> DataFrame:
    """Per script: segments, speech, pause and breath rows, seconds of pause, words of speech."""
    count = lambda kind: F.count_if(F.col("type") == kind)
    return segments.groupBy("script_id").agg(
        F.count(F.lit(1)).alias("n_segments"), count("speech").alias("n_speech"), count("pause").alias("n_pause"), count("breath").alias("n_breath"),
        F.coalesce(F.sum("duration_sec"), F.lit(0.0)).alias("pause_sec"), F.sum(words(F.col("text"))).alias("n_words"),
    )


def reject_empty_scripts(scripts: DataFrame, segments: DataFrame) -> DataFrame:
    """Scripts of which no segment is left."""
    return scripts.join(segments.select("script_id"), "script_id", "left_anti")
