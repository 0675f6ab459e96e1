"""Views that the queries are run on, derived from the given tables: marked-up scripts and sampled series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import table

#: Rows per second of the series view.
RATE = 100


def scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """scripts(script_id, text): every conversation as a script with pause, breath and voice tags."""
    turn = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    marked = F.concat(
        F.lit("[voice:"), "role", F.lit("] "),
        F.when(F.col("role") == "assistant", "[inhale] ").otherwise(""), "text",
        F.when(F.col("turn") % 3 == 0, F.concat(F.lit(" [pause:"), (F.col("turn") % 4 + 1).cast("string"), F.lit("s]")))
        .when(F.col("turn") % 3 == 1, F.concat(F.lit(" ["), (F.col("turn") % 4 + 2).cast("string"), F.lit(" second pause]")))
        .otherwise(""),
        F.when(F.col("turn") % 5 == 4, "\n\n[pause:7s]").otherwise(""),
    )
    turns = turn.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", marked.alias("x")))).alias("turns"))
    return turns.select(F.col("conv_id").alias("script_id"), F.array_join(F.col("turns.x"), "\n\n").alias("text"))


SCRIPTS_SQL = """scripts AS (SELECT conv_id AS script_id, string_agg('[voice:' || role || '] ' || CASE WHEN role = 'assistant' THEN '[inhale] ' ELSE '' END || text
 || CASE turn % 3 WHEN 0 THEN ' [pause:' || (turn % 4 + 1) || 's]' WHEN 1 THEN ' [' || (turn % 4 + 2) || ' second pause]' ELSE '' END
 || CASE WHEN turn % 5 = 4 THEN chr(10) || chr(10) || '[pause:7s]' ELSE '' END, chr(10) || chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id)"""


def signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """signal(series_id, channel, pos, value): one series per event type, values within [-1, 1].

    Rows are numbered within their day, from the number of rows on the days before, so a series is as many tasks as it has days.
    """
    events = table(spark, sf_dir, "events").select("event_type", "ts", "event_id", "value", F.to_date("ts").alias("day"))
    days = events.groupBy("event_type", "day").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("event_type").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    days = days.select(F.col("event_type").alias("of"), F.col("day").alias("on"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    order = Window.partitionBy("event_type", "day").orderBy("ts", "event_id")
    sign = F.when(F.col("event_id") % 2 == 0, 1).otherwise(-1)
    rows = events.withColumn("place", F.row_number().over(order) - 1).join(days, (F.col("event_type") == F.col("of")) & (F.col("day") == F.col("on")))
    return rows.select(
        F.col("event_type").alias("series_id"), F.lit(0).alias("channel"),
        (F.col("before") + F.col("place")).cast("long").alias("pos"), (sign * F.least(F.col("value") / 500.0, F.lit(1.0))).alias("value"),
    )


SIGNAL_SQL = """signal AS (SELECT event_type AS series_id, 0 AS channel, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS pos,
 CASE WHEN event_id % 2 = 0 THEN 1 ELSE -1 END * least(value / 500.0, 1.0) AS value FROM events)"""


def two_signals(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(voice, music): the series of clicks and of views, as (pos, value) each."""
    rows = signal(spark, sf_dir)
    one = lambda name: rows.filter(F.col("series_id") == name).select("pos", "value")
    return one("click"), one("view")


TWO_SQL = SIGNAL_SQL + """, voice AS (SELECT pos, value FROM signal WHERE series_id = 'click'), music AS (SELECT pos, value FROM signal WHERE series_id = 'view')"""
