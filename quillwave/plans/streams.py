"""Streaming queries: the given tables are read as file streams to their end; what comes out is a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.duration import words_per_minute
from ..functions.recursion import alpha_of, asymmetric_ema
from ..operators import segments as S
from ..operators import timeline as T
from ..session import shared_folder, table
from ..sources.fixtures import RATE, SIGNAL_SQL, scripts, signal
from ..streaming import operators as O
from .scripts import PARSED_ITEMS


def _stream(spark: SparkSession, d: str, name: str) -> DataFrame:
    spark.conf.set(*O.STATE_STORE)
    reader = spark.readStream.schema(table(spark, d, name).schema)
    path = f"{d}/{name}.parquet"
    return reader.parquet(path) if _is_folder(spark, path) else reader.option("pathGlobFilter", f"{name}.parquet").parquet(d)


def _is_folder(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


def _done(stream: DataFrame) -> DataFrame:
    spark = stream.sparkSession
    folder = shared_folder(spark)
    stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def _events(spark: SparkSession, d: str) -> DataFrame:
    rows = _stream(spark, d, "events")
    sign = F.when(F.col("event_id") % 2 == 0, 1).otherwise(-1)
    return rows.select(F.col("event_type").alias("series_id"), F.col("ts").cast("timestamp").alias("ts"), "event_id", (sign * F.least(F.col("value") / 500.0, F.lit(1.0))).alias("value"))


def _progress(spark: SparkSession, d: str) -> DataFrame:
    rows = _stream(spark, d, "events").select(F.col("user_id").alias("job_id"), (F.col("event_id") / 1e6).alias("fraction"), F.concat("event_type", F.lit(":"), "event_id").alias("message"))
    folder = shared_folder(spark)
    query = O.stream_progress(rows).writeStream.outputMode("update").foreachBatch(O.upsert_latest(f"{folder}/out")).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return O.latest(spark, f"{folder}/out")


def _budget(spark: SparkSession, d: str) -> DataFrame:
    rows = _stream(spark, d, "events").select(F.col("user_id").alias("session"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"), (F.length("props") * 7).cast("long").alias("bytes"))
    return _done(O.stream_byte_budget(rows, 1003, late="0 seconds", idle_sec=400 * 86400.0))  # the table comes in one batch


def _scripts(spark: SparkSession, d: str) -> DataFrame:
    rows = _stream(spark, d, "documents").select(F.col("doc_id").alias("script_id"), F.timestamp_seconds(F.col("doc_id") + 1).alias("ts"), F.concat(F.col("text"), F.lit("\n\n[2 second pause]\n\n[Inhale] on")).alias("text"))
    return _done(O.stream_scripts(rows, "400 days"))


def _pace(spark: SparkSession, d: str) -> DataFrame:
    model = lambda text: words_per_minute(text)
    rows = T.timeline_offsets(T.pace_by_wpm(T.insert_gaps(S.parse(scripts(spark, d))), model=model))
    return rows.groupBy("script_id").agg(F.round(F.max("end_sec"), 6).alias("total_sec"))


def _ema(spark: SparkSession, d: str) -> DataFrame:
    rows = signal(spark, d).select("series_id", "pos", F.abs("value").alias("value"))
    return asymmetric_ema(rows, alpha_of(80.0, RATE), alpha_of(1000.0, RATE), 1.0).withColumn("smooth", F.round("smooth", 6))


_E = "e AS (SELECT event_type AS series_id, ts, event_id, CASE WHEN event_id % 2 = 0 THEN 1 ELSE -1 END * least(value / 500.0, 1.0) AS value, max(ts) OVER () AS newest FROM events)"
QUERIES = {
    "stream_frames": (
        lambda s, d: _done(O.stream_frames(_events(s, d))).select("series_id", F.unix_seconds("start").alias("start"), F.round("rms", 6).alias("rms"), "n"),
        f"WITH {_E} SELECT series_id, CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS start, round(sqrt(avg(value * value)), 6) AS rms, count(*) AS n FROM e GROUP BY series_id, date_trunc('hour', ts), newest HAVING date_trunc('hour', ts) + INTERVAL 1 HOUR <= newest - INTERVAL 10 MINUTE",
    ),
    "stream_phrases": (
        lambda s, d: _done(O.stream_phrases(_events(s, d), 0.1)).select("series_id", F.unix_micros("start").alias("start"), F.unix_micros("end").alias("end"), "n"),
        f"WITH {_E}, l AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM e WHERE abs(value) > 0.1 WINDOW w AS (PARTITION BY series_id ORDER BY ts)), r AS (SELECT *, sum(new) OVER (PARTITION BY series_id ORDER BY ts) AS run FROM l) SELECT series_id, epoch_us(min(ts)) AS start, epoch_us(max(ts)) AS \"end\", count(*) AS n FROM r GROUP BY series_id, run, newest HAVING max(ts) + INTERVAL 30 MINUTE <= newest - INTERVAL 10 MINUTE AND max(ts) - min(ts) >= INTERVAL 60 SECOND",
    ),
    "stream_envelope": (
        lambda s, d: _done(O.stream_envelope(_events(s, d), alpha_of(300.0, RATE))).withColumn("env", F.round("env", 6)),
        "WITH RECURSIVE e AS MATERIALIZED (SELECT event_type AS series_id, event_id, least(value / 500.0, 1.0) AS value, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS pos FROM events), r AS (SELECT series_id, event_id, pos, (1 - exp(-1 / 30.0)) * value * value AS m FROM e WHERE pos = 1 UNION ALL SELECT e.series_id, e.event_id, e.pos, exp(-1 / 30.0) * m + (1 - exp(-1 / 30.0)) * e.value * e.value FROM r JOIN e ON e.series_id = r.series_id AND e.pos = r.pos + 1) SELECT series_id, event_id, round(sqrt(greatest(m, 1e-12)), 6) AS env FROM r",
    ),
    "stream_silence_alert": (
        lambda s, d: _done(O.stream_silence_alert(_events(s, d), 0.3, 3600.0)).select("series_id", F.unix_millis("quiet_since").alias("quiet_since")),
        f"WITH {_E}, l AS (SELECT series_id, epoch_us(ts) // 1000 AS t, lead(epoch_us(ts) // 1000) OVER (PARTITION BY series_id ORDER BY ts) AS n, epoch_us(newest) // 1000 AS newest FROM e WHERE abs(value) > 0.3) SELECT series_id, t AS quiet_since FROM l WHERE n - t > 3600000 OR n IS NULL AND t + 3600000 <= newest - 600000",
    ),
    "stream_byte_budget": (_budget, "WITH e AS (SELECT user_id AS session, event_id AS seq, len(props) * 7 AS bytes, coalesce(sum(len(props) * 7) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM events) SELECT session, seq, CAST(greatest(least(bytes, 1000 - before), 0) AS BIGINT) AS kept FROM e WHERE before < 1003"),
    "stream_progress": (_progress, "SELECT user_id AS job_id, max(event_id) / 1e6 AS fraction, arg_max(event_type || ':' || event_id, event_id) AS message FROM events GROUP BY 1"),
    "stream_scripts": (lambda s, d: _scripts(s, d).select("script_id", F.md5(F.col("text").cast("binary")).alias("text_md5")), "SELECT doc_id AS script_id, md5(text || ' [pause:2s] [breath:inhale] on') AS text_md5 FROM documents"),
    "duration_model": (_pace, PARSED_ITEMS + " SELECT script_id, round(max(end_sec), 6) AS total_sec FROM timed GROUP BY script_id"),
    "asymmetric_ema": (
        _ema,
        f"WITH RECURSIVE {SIGNAL_SQL.replace('signal AS', 'signal AS MATERIALIZED', 1)}, k AS (SELECT exp(-1 / 8.0) AS a, exp(-1 / 100.0) AS b), r AS (SELECT series_id, pos, CASE WHEN abs(value) < 1 THEN a ELSE b END * 1.0 + (1 - CASE WHEN abs(value) < 1 THEN a ELSE b END) * abs(value) AS m FROM signal, k WHERE pos = 0 UNION ALL SELECT s.series_id, s.pos, CASE WHEN abs(s.value) < m THEN a * m + (1 - a) * abs(s.value) ELSE b * m + (1 - b) * abs(s.value) END FROM r JOIN signal s ON s.series_id = r.series_id AND s.pos = r.pos + 1, k) SELECT series_id, pos, round(m, 6) AS smooth FROM r",
    ),
}
