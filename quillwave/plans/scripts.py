"""Queries on scripts and timelines, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import segments as S
from ..operators import timeline as T
from ..session import shared_folder, table
from ..sources import assets, media
from ..sources.fixtures import SCRIPTS_SQL, scripts
from . import sql

PARSED_ITEMS = f"""WITH {sql.PARSED},
kinds AS (SELECT *, CASE WHEN type = 'speech' AND lag(type) OVER (PARTITION BY script_id ORDER BY seg_no) = 'speech' THEN 1 ELSE 0 END AS follows FROM filled),
both_ AS (SELECT script_id, seg_no, 0 AS k, 'gap' AS type, NULL AS text, 0.4 AS duration_sec, NULL AS voice FROM kinds WHERE follows = 1 UNION ALL SELECT script_id, seg_no, 1, type, text, duration_sec, voice FROM kinds),
items AS (SELECT script_id, CAST(row_number() OVER (PARTITION BY script_id ORDER BY seg_no, k) - 1 AS INT) AS item_no, type, text, CAST(duration_sec AS DOUBLE) AS duration_sec, voice FROM both_),
paced AS (SELECT script_id, item_no, type, text, voice, CASE WHEN type = 'speech' THEN ({sql.words("text")}) / 140.0 * 60.0 WHEN type = 'breath' THEN 1.2 ELSE duration_sec END AS duration_sec FROM items),
timed AS (SELECT *, sum(duration_sec) OVER (PARTITION BY script_id ORDER BY item_no) AS end_sec FROM paced)"""


def _some_empty(spark: SparkSession, d: str) -> DataFrame:
    return scripts(spark, d).withColumn("text", F.when(F.col("script_id") % 10 == 0, F.lit(" \n\n [pause:0s] ")).otherwise(F.col("text")))


def _parsed(spark: SparkSession, d: str) -> DataFrame:
    return S.parse(scripts(spark, d))


def _timeline(spark: SparkSession, d: str) -> DataFrame:
    return T.timeline_offsets(T.pace_by_wpm(T.insert_gaps(_parsed(spark, d))))


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Parse, pace and place every script: seconds in all, share of speech."""
    rows = _timeline(spark, d)
    return rows.groupBy("script_id").agg(F.count(F.lit(1)).alias("n_items"), F.round(F.sum("duration_sec"), 6).alias("total_sec"), F.round(F.sum(F.when(F.col("active"), F.col("duration_sec")).otherwise(0.0)) / F.sum("duration_sec"), 6).alias("speech_share"))


def _assets(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "supplier").select("s_suppkey", "s_name", "s_nationkey").filter("s_nationkey = 3")
    phase = F.when(F.col("s_suppkey") % 2 == 0, "user").otherwise("default")
    return rows.groupBy(phase.alias("phase")).agg(F.min("s_name").alias("audio_path"), F.min("s_suppkey").alias("ordinal"))


def _orders(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("job_id"), (F.col("o_totalprice") / 100.0).alias("duration_sec"))


def _stages(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "conversations").select("conv_id", "turn", "role", F.length("text").alias("n"))
    return rows.groupBy(F.col("conv_id").alias("job_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "n"))), lambda t: F.struct(t["role"].alias("prompt"), (t["n"] / 10.0).alias("seconds"))).alias("stages"))


def _routes(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("job_id"))
    pick = lambda values, by: F.element_at(F.array(*map(F.lit, values)), (by % len(values) + 1).cast("int"))
    k = F.col("job_id")
    return T.route_jobs(rows.select("job_id", pick(["Full", "Vocals Only", "Instrumental Only"], k).alias("mode"), pick(["cloud", "local", "upload", "none"], k).alias("music"), pick(["first", "second", "third"], F.floor(k / 3)).alias("engine")))


def _backgrounds(spark: SparkSession, d: str) -> DataFrame:
    total = flagship(spark, d).select(F.col("script_id").alias("job_id"), F.col("total_sec").alias("narration_sec"))
    rows = total.select("job_id", F.when(F.col("job_id") % 3 == 0, F.col("narration_sec") * 2).alias("stage_sec"), F.when(F.col("job_id") % 3 == 1, F.lit(10.0)).alias("fixed_min"), "narration_sec")
    return T.background_length(rows).select("job_id", F.round("music_sec", 6).alias("music_sec"))


def _scan(spark: SparkSession, d: str) -> DataFrame:
    path = shared_folder(spark)
    # a file per script, written by the tasks into one folder: no folder per script to make, move and list
    media.write_files(scripts(spark, d), F.concat(F.col("script_id").cast("string"), F.lit(".txt")), F.col("text").cast("binary"), path)
    found = assets.scan_scripts(spark, path)
    number = F.regexp_extract("path", r"(\d+)\.txt$", 1).cast("long")
    return found.select(number.alias("script_id"), F.length("text").alias("n_chars_read"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


def _gaps_of_sentences(spark: SparkSession, d: str) -> DataFrame:
    rows = _parsed(spark, d).withColumn("next_type", F.lead("type").over(Window.partitionBy("script_id").orderBy("seg_no"))).filter("type = 'speech'")
    rows = rows.select("script_id", "seg_no", "next_type", F.posexplode(F.split(S.strip(F.col("text")), r"(?<=[.!?])\s+")).alias("sent_no", "text"))
    return T.sentence_gaps(rows).select("script_id", "seg_no", "sent_no", "gap_sec")


QUERIES = {
    "flagship_timeline": (flagship, PARSED_ITEMS + " SELECT script_id, count(*) AS n_items, round(sum(duration_sec), 6) AS total_sec, round(sum(CASE WHEN type = 'speech' THEN duration_sec ELSE 0 END) / sum(duration_sec), 6) AS speech_share FROM timed GROUP BY script_id"),
    "scan_scripts": (_scan, f"WITH {SCRIPTS_SQL} SELECT script_id, len(text) AS n_chars_read, md5(text) AS text_md5 FROM scripts"),
    "normalize_tags": (lambda s, d: S.normalize_tags(scripts(s, d)), f"WITH {sql.NORMALIZED} SELECT * FROM normalized"),
    "tokenize_segments": (lambda s, d: S.tokenize_segments(S.normalize_tags(scripts(s, d))), f"WITH {sql.NORMALIZED}, {sql.tokens('normalized', True)} SELECT * FROM segs"),
    "paragraph_pause_priority": (
        lambda s, d: S.paragraph_pause_priority(scripts(s, d)),
        f"WITH {sql.NORMALIZED}, para AS (SELECT script_id, regexp_replace(text, '\\n\\n+', ' [para-pause:6.5s] ', 'g') AS text FROM normalized), {sql.tokens('para', False)}, "
        + sql.merged("segs", "done", "coalesce(sum(duration_sec) FILTER (WHERE source = 'explicit'), sum(duration_sec))") + " SELECT * FROM done",
    ),
    "paragraph_pause_suppress": (lambda s, d: S.paragraph_pause_suppress(S.normalize_tags(scripts(s, d))), f"WITH {sql.NORMALIZED}, {sql.SUPPRESSED} SELECT * FROM suppressed"),
    "merge_pauses_sum": (lambda s, d: S.merge_pauses_sum(S.tokenize_segments(S.paragraph_pause_suppress(S.normalize_tags(scripts(s, d))))), ",\n".join([f"WITH {sql.NORMALIZED}", sql.SUPPRESSED, sql.tokens("suppressed", True), sql.merged("segs", "done", "sum(duration_sec)")]) + " SELECT * FROM done"),
    "merge_pauses_max": (lambda s, d: S.merge_pauses_max(S.tokenize_segments(S.paragraph_pause_suppress(S.normalize_tags(scripts(s, d))))), ",\n".join([f"WITH {sql.NORMALIZED}", sql.SUPPRESSED, sql.tokens("suppressed", True), sql.merged("segs", "done", "max(duration_sec)")]) + " SELECT * FROM done"),
    "voice_fill_forward": (_parsed, f"WITH {sql.PARSED} SELECT * FROM filled"),
    "segment_stats": (
        lambda s, d: S.segment_stats(_parsed(s, d)),
        f"WITH {sql.PARSED} SELECT script_id, count(*) AS n_segments, count(*) FILTER (WHERE type = 'speech') AS n_speech, count(*) FILTER (WHERE type = 'pause') AS n_pause, count(*) FILTER (WHERE type = 'breath') AS n_breath, coalesce(sum(duration_sec), 0) AS pause_sec, CAST(sum({sql.words('text')}) AS BIGINT) AS n_words FROM filled GROUP BY script_id",
    ),
    "reject_empty_scripts": (
        lambda s, d: S.reject_empty_scripts(x := _some_empty(s, d), S.tokenize_segments(S.normalize_tags(x))).select("script_id"),
        f"WITH {SCRIPTS_SQL} SELECT script_id FROM scripts WHERE script_id % 10 = 0",
    ),
    "insert_gaps": (lambda s, d: T.insert_gaps(_parsed(s, d)), PARSED_ITEMS + " SELECT * FROM items"),
    "sentence_gaps": (
        _gaps_of_sentences,
        f"WITH {sql.PARSED}, n AS (SELECT *, lead(type) OVER (PARTITION BY script_id ORDER BY seg_no) AS next_type FROM filled),"
        r""" s AS (SELECT script_id, seg_no, next_type, unnest(range(0, len(a))) AS sent_no, unnest(a) AS text, len(a) AS n FROM (SELECT *, string_split(regexp_replace(regexp_replace(text, '^\s+|\s+$', '', 'g'), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS a FROM n WHERE type = 'speech'))
 SELECT script_id, seg_no, CAST(sent_no AS INT) AS sent_no, CASE WHEN sent_no = n - 1 AND (next_type IS NULL OR next_type = 'pause') THEN 0.0 WHEN regexp_matches(text, '(\.\.\.|…)\s*$') THEN 1.2 ELSE 0.8 END AS gap_sec FROM s""",
    ),
    "pace_by_wpm": (lambda s, d: T.pace_by_wpm(T.insert_gaps(_parsed(s, d))), PARSED_ITEMS + " SELECT * FROM paced"),
    "timeline_offsets": (lambda s, d: _timeline(s, d).select("script_id", "item_no", "type", F.round("start_sec", 6).alias("start_sec"), F.round("end_sec", 6).alias("end_sec"), "active"), PARSED_ITEMS + " SELECT script_id, item_no, type, round(end_sec - duration_sec, 6) AS start_sec, round(end_sec, 6) AS end_sec, type = 'speech' AS active FROM timed"),
    "chunk_seeds": (lambda s, d: T.chunk_seeds(_parsed(s, d)).select("script_id", "seg_no", "chunk_seed"), f"WITH {sql.PARSED} SELECT script_id, seg_no, 42 + row_number() OVER (PARTITION BY script_id ORDER BY seg_no) - 1 AS chunk_seed FROM filled WHERE type = 'speech'"),
    "phase_asset_join": (
        lambda s, d: T.phase_asset_join(_parsed(s, d).filter("type = 'speech'"), _assets(s, d)).select("script_id", "seg_no", "voice", "audio_path"),
        f"WITH {sql.PARSED}, a AS (SELECT CASE WHEN s_suppkey % 2 = 0 THEN 'user' ELSE 'default' END AS phase, min(s_name) AS audio_path, min(s_suppkey) AS o FROM supplier WHERE s_nationkey = 3 GROUP BY 1), f AS (SELECT coalesce(max(CASE WHEN phase = 'default' THEN audio_path END), arg_min(audio_path, o)) AS other FROM a) SELECT script_id, seg_no, voice, coalesce(audio_path, other) AS audio_path FROM filled LEFT JOIN a ON voice = phase, f WHERE type = 'speech'",
    ),
    "split_sessions": (lambda s, d: T.split_sessions(_orders(s, d)), "WITH o AS (SELECT o_orderkey AS job_id, o_totalprice / 100.0 AS duration_sec FROM orders), p AS (SELECT *, unnest(range(0, CAST(ceil(duration_sec / 570.0) AS BIGINT))) AS piece FROM o) SELECT job_id, duration_sec, CAST(piece AS INT) AS piece, least(duration_sec - piece * 570.0, 570.0) AS piece_sec FROM p WHERE duration_sec - piece * 570.0 > 0.5"),
    "plan_continuations": (lambda s, d: T.plan_continuations(_orders(s, d)), "WITH o AS (SELECT o_orderkey AS job_id, o_totalprice / 100.0 AS duration_sec FROM orders), p AS (SELECT *, unnest(range(0, CAST(greatest(ceil((duration_sec - 91.0) / 60.0), 0) AS BIGINT) + 1)) AS piece FROM o), q AS (SELECT *, CASE WHEN piece = 0 THEN 0.0 ELSE 90.0 + (piece - 1) * 60.0 END AS start_sec FROM p) SELECT job_id, duration_sec, CAST(piece AS INT) AS piece, start_sec, CASE WHEN piece = 0 THEN least(90.0, duration_sec) ELSE least(60.0, duration_sec - start_sec) END AS piece_sec, CASE WHEN piece = 0 THEN 0.0 ELSE 20.0 END AS context_sec FROM q"),
    "plan_stages": (lambda s, d: T.plan_stages(_stages(s, d)), "WITH c AS (SELECT conv_id AS job_id, row_number() OVER w - 1 AS stage, role AS prompt, len(text) / 10.0 AS seconds, coalesce(sum(len(text) / 10.0 - 6.0) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start_sec, sum(len(text) / 10.0) OVER (PARTITION BY conv_id) + 5.0 AS total_sec FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, len(text))) SELECT job_id, CAST(stage AS INT) AS stage, prompt, seconds, start_sec, total_sec FROM c"),
    "route_jobs": (_routes, "WITH o AS (SELECT o_orderkey AS job_id, ['Full', 'Vocals Only', 'Instrumental Only'][o_orderkey % 3 + 1] AS mode, ['cloud', 'local', 'upload', 'none'][o_orderkey % 4 + 1] AS music, ['first', 'second', 'third'][o_orderkey // 3 % 3 + 1] AS engine FROM orders) SELECT job_id, mode, music, engine, CASE WHEN music <> 'none' OR engine IN ('second', 'third') THEN 48000 ELSE 44100 END AS mix_rate, CASE WHEN music <> 'none' THEN 48000 ELSE 44100 END AS export_rate, CASE WHEN music = 'local' THEN -14.0 ELSE -16.0 END AS premix_lufs, CASE WHEN mode = 'Instrumental Only' THEN NULL WHEN engine = 'third' THEN 0.10 WHEN engine = 'first' THEN 0.25 ELSE 1.0 END AS denoise_wet FROM o"),
    "background_length": (_backgrounds, PARSED_ITEMS + ", f AS (SELECT script_id AS job_id, round(sum(duration_sec), 6) AS n FROM timed GROUP BY script_id) SELECT job_id, round(CASE job_id % 3 WHEN 0 THEN n * 2 + 5 WHEN 1 THEN 600.0 ELSE n + 15 END, 6) AS music_sec FROM f"),
}
