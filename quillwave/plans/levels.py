"""Queries on levels and silences of series, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.resampling import taps
from ..operators import frames as L
from ..sources.fixtures import RATE, SIGNAL_SQL, signal

W = f"WITH {SIGNAL_SQL}"
FRAMES = W + ", n AS (SELECT series_id, max(pos) + 1 AS n FROM signal GROUP BY 1), f AS (SELECT series_id, pos // {0} AS frame, sqrt(avg(value * value)) AS rms FROM signal GROUP BY 1, 2), i AS (SELECT f.*, n FROM f JOIN n USING (series_id) WHERE frame * {0} < n - {0})"
QUIET = 0.15  # quiet for this view


def _round(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


def _series(spark: SparkSession, d: str) -> DataFrame:
    return signal(spark, d).select("series_id").distinct()


def _sql(values: str, middle: str = "") -> str:
    return f"{W}{middle} SELECT series_id, pos, {values} FROM signal"


def _rows(df: DataFrame) -> DataFrame:
    return df.select("series_id", "pos", F.round("value", 6).alias("value"))


def _sanity(spark: SparkSession, d: str) -> DataFrame:
    rows = signal(spark, d)
    series = rows.select("series_id").distinct().unionByName(spark.range(1).select(F.lit("none").alias("series_id")))
    return L.signal_sanity(series, rows.withColumn("value", F.when(F.col("series_id") == "error", F.col("value") * 0.0).when(F.col("series_id") == "view", F.abs("value")).otherwise(F.col("value"))))


def _candidates(spark: SparkSession, d: str) -> DataFrame:
    rows = signal(spark, d)
    wanted = rows.groupBy("series_id").agg((F.count(F.lit(1)) * F.when(F.col("series_id") == "click", 3).otherwise(1)).alias("wanted_rows"))
    return L.validate_candidates(wanted, rows.withColumn("value", F.when(F.col("series_id") == "view", F.col("value") / 1000).when(F.col("series_id") == "signup", F.col("value") * 8).otherwise(F.col("value"))))


def _hygiene(spark: SparkSession, d: str) -> DataFrame:
    rows = signal(spark, d)
    series = rows.select("series_id").distinct().withColumn("rate_hz", F.when(F.col("series_id") == "click", 22050).otherwise(RATE)).withColumn("channels", F.when(F.col("series_id") == "view", 2).otherwise(1))
    return L.reference_hygiene(series, rows)


#: Low, so that short series have blocks of 400 ms too.
WEIGHTED_RATE = 4_000.0


def _weighted() -> str:
    """Two recursions in one: y1 behind the shelf, y2 behind the high pass; then blocks of 1,600 rows, every 400."""
    (b, a), (c, d) = ([list(map(float, x)) for x in stage] for stage in L._biquads(WEIGHTED_RATE))
    rows = lambda x, z: f"SELECT series_id, pos, y2, {b[1]} * x - {a[1]} * y1 + z2 AS z1, {b[2]} * x - {a[2]} * y1 AS z2, {c[1]} * y1 - {d[1]} * y2 + z4 AS z3, {c[2]} * y1 - {d[2]} * y2 AS z4 FROM (SELECT *, {c[0]} * y1 + z3 AS y2 FROM (SELECT s.series_id, s.pos, CAST(s.value AS DOUBLE) AS x, {b[0]} * s.value + {z[0]} AS y1, {z[1]} AS z2, {z[2]} AS z3, {z[3]} AS z4 FROM {x}))"
    start, on = rows("signal s WHERE s.pos = 0", ["0.0::DOUBLE"] * 4), rows("r JOIN signal s ON s.series_id = r.series_id AND s.pos = r.pos + 1", ["r.z1", "r.z2", "r.z3", "r.z4"])
    return f"WITH RECURSIVE {SIGNAL_SQL.replace('signal AS', 'signal AS MATERIALIZED', 1)}, r AS ({start} UNION ALL {on})" + """, n AS (SELECT series_id, max(pos) + 1 AS n FROM signal GROUP BY 1), b AS (SELECT series_id, n, unnest(range(0, (n - 1600) // 400 + 1)) AS b FROM n WHERE n >= 1600),
 z AS (SELECT b.series_id, b.b, sum(y2 * y2) / 1600 AS z FROM b JOIN r ON r.series_id = b.series_id AND r.pos BETWEEN b.b * 400 AND b.b * 400 + 1599 GROUP BY 1, 2), h AS (SELECT *, -0.691 + 10 * log10(z) AS l FROM z WHERE z > 0 AND -0.691 + 10 * log10(z) > -70),
 q AS (SELECT series_id, -0.691 + 10 * log10(avg(z)) - 10 AS gate FROM h GROUP BY 1), g AS (SELECT series_id, -0.691 + 10 * log10(avg(z)) AS lufs FROM h JOIN q USING (series_id) WHERE l > gate GROUP BY 1)
 SELECT series_id, round(lufs, 6) AS lufs, round(CASE WHEN lufs IS NULL OR abs(-21 - lufs) > 40 THEN 1 ELSE pow(10, (-21 - lufs) / 20) END, 6) AS gain FROM n LEFT JOIN g USING (series_id)"""


def _taps(up: int, down: int) -> str:
    h = taps(up, down)
    return f"(SELECT unnest(range({-(len(h) // 2)}, {len(h) // 2 + 1})) AS k, unnest([{', '.join(repr(float(x)) for x in h)}]) AS h)"


#: Four times the rate (a row of the series reaches 40 rows on either side), the gains there, and back.
_TRUE_PEAKS = W + f""", u AS (SELECT series_id, pos * 4 + k AS pos, sum(value * h) AS value FROM signal, {_taps(4, 1)} GROUP BY 1, 2), n AS (SELECT series_id, max(pos) + 1 AS n FROM signal GROUP BY 1),
 x AS (SELECT u.* FROM u JOIN n USING (series_id) WHERE pos >= 0 AND pos < 4 * n), g AS (SELECT *, min(least(1, pow(10, -9.3 / 20) / greatest(abs(value), 1e-12))) OVER (PARTITION BY series_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING) AS gain FROM x),
 y AS (SELECT series_id, pos, greatest(least(value * gain, pow(10, -9.3 / 20)), -pow(10, -9.3 / 20)) AS value FROM g), d AS (SELECT series_id, (pos + k) // 4 AS pos, sum(value * h) AS value FROM y, {_taps(1, 4)} WHERE (pos + k) % 4 = 0 AND pos + k >= 0 GROUP BY 1, 2)
 SELECT d.series_id, pos, round(greatest(least(value, pow(10, -9.3 / 20)), -pow(10, -9.3 / 20)), 6) AS value FROM d JOIN n USING (series_id) WHERE pos < n"""


_ENV = "sqrt(sum(value * value) OVER (PARTITION BY series_id ORDER BY pos ROWS BETWEEN 5 PRECEDING AND 4 FOLLOWING) / 10)"
QUERIES = {
    "frame_rms": (lambda s, d: _round(L.frame_rms(signal(s, d), 10), "rms", "dbfs"), FRAMES.format(10) + " SELECT series_id, frame, round(rms, 6) AS rms, round(20 * log10(greatest(rms, 1e-10)), 6) AS dbfs FROM f"),
    "sliding_rms": (lambda s, d: L.sliding_rms(signal(s, d), 10).select("series_id", "pos", F.round("env", 6).alias("env")), _sql(f"round({_ENV}, 6) AS env")),
    "onepole_envelope": (
        lambda s, d: L.onepole_envelope(signal(s, d), RATE, 300.0).select("series_id", "pos", F.round("env", 6).alias("env")),
        f"WITH RECURSIVE {SIGNAL_SQL.replace('signal AS', 'signal AS MATERIALIZED', 1)}, r AS (SELECT series_id, pos, (1 - exp(-1 / 30.0)) * value * value AS m FROM signal WHERE pos = 0 UNION ALL SELECT s.series_id, s.pos, exp(-1 / 30.0) * r.m + (1 - exp(-1 / 30.0)) * s.value * s.value FROM r JOIN signal s ON s.series_id = r.series_id AND s.pos = r.pos + 1) SELECT series_id, pos, round(sqrt(greatest(m, 1e-12)), 6) AS env FROM r",
    ),
    "silence_gaps": (
        lambda s, d: L.silence_gaps(signal(s, d), RATE, 10, QUIET, 0.2),
        FRAMES.format(10) + f", q AS (SELECT *, rms < {QUIET} AS quiet, sum(CASE WHEN rms < {QUIET} THEN 0 ELSE 1 END) OVER (PARTITION BY series_id ORDER BY frame) AS run, max(frame) OVER (PARTITION BY series_id) AS last FROM i), r AS (SELECT series_id, run, min(frame) AS a, max(frame) AS b, any_value(n) AS n, any_value(last) AS last FROM q WHERE quiet GROUP BY 1, 2), e AS (SELECT *, (CASE WHEN b = last THEN n ELSE (b + 1) * 10 END - a * 10) / 100.0 AS len FROM r) SELECT series_id, round(a * 10 / 100.0, 1) AS start_sec, round(len, 1) AS duration_sec FROM e WHERE len > 0.2",
    ),
    "silence_ratio": (lambda s, d: L.silence_ratio(signal(s, d), 5, QUIET), FRAMES.format(5) + f", g AS (SELECT series_id, count(*) FILTER (WHERE rms < {QUIET}) / greatest(any_value(n) // 5, 1) AS r FROM i GROUP BY 1) SELECT series_id, round(r, 3) AS silence_ratio, r BETWEEN 0.15 AND 0.75 AS passed FROM g"),
    "clipping": (lambda s, d: L.clipping(signal(s, d), 0.5), W + " SELECT series_id, count(*) FILTER (WHERE abs(value) >= 0.5) AS clipped, round(count(*) FILTER (WHERE abs(value) >= 0.5) / count(*), 6) AS clipped_ratio, count(*) FILTER (WHERE abs(value) >= 0.5) / count(*) < 0.001 AS passed FROM signal GROUP BY 1"),
    "dynamic_range": (lambda s, d: L.dynamic_range(signal(s, d), RATE), FRAMES.format(100) + ", g AS (SELECT series_id, stddev_pop(rms) AS s FROM f JOIN n USING (series_id) WHERE (frame + 1) * 100 <= n GROUP BY 1) SELECT series_id, round(s, 5) AS rms_std, s <= 0.01 AS passed FROM g"),
    "zero_crossing": (lambda s, d: _round(L.zero_crossing(signal(s, d)), "zcr"), W + ", l AS (SELECT series_id, abs(sign(value) - lag(sign(value)) OVER (PARTITION BY series_id ORDER BY pos)) AS st FROM signal), z AS (SELECT series_id, sum(st) / (2.0 * count(*)) AS zcr FROM l GROUP BY 1) SELECT series_id, round(zcr, 6) AS zcr, zcr > 0.4 AS noise FROM z"),
    "signal_sanity": (_sanity, W + ", x AS (SELECT series_id, pos, CASE series_id WHEN 'error' THEN 0.0 WHEN 'view' THEN abs(value) ELSE value END AS value FROM signal), l AS (SELECT *, abs(sign(value) - lag(sign(value)) OVER (PARTITION BY series_id ORDER BY pos)) AS st FROM x), z AS (SELECT series_id, CASE WHEN max(abs(value)) < 1e-6 THEN 'silent' WHEN sum(st) / (2.0 * count(*)) > 0.4 THEN 'noise' ELSE 'ok' END AS status FROM l GROUP BY 1) SELECT * FROM z UNION ALL SELECT 'none', 'empty'"),
    "validate_candidates": (_candidates, W + ", x AS (SELECT series_id, CASE series_id WHEN 'view' THEN value / 1000 WHEN 'signup' THEN value * 8 ELSE value END AS value FROM signal), g AS (SELECT series_id, CASE WHEN series_id = 'click' THEN 'Output too short' WHEN 20 * log10(greatest(sqrt(avg(value * value)), 1e-10)) < -50 THEN 'Near-silent output' WHEN count(*) FILTER (WHERE abs(value) >= 0.99) / count(*) > 0.05 THEN 'Excessive clipping' ELSE 'OK' END AS reason FROM x GROUP BY 1) SELECT series_id, reason = 'OK' AS valid, reason FROM g"),
    "reference_hygiene": (
        _hygiene,
        W + ", g AS (SELECT series_id, CASE series_id WHEN 'click' THEN 22050 ELSE 100 END AS rate, max(pos) + 1 AS n, max(abs(value)) AS peak, sqrt(avg(value * value)) AS rms FROM signal GROUP BY 1) SELECT series_id, list_filter([CASE WHEN rate < 16000 THEN 'low rate' END, CASE WHEN n / rate < 4 THEN 'too short' WHEN n / rate > 15 THEN 'too long' END, CASE WHEN series_id = 'view' THEN 'not mono' END, CASE WHEN peak >= pow(10, -1 / 20.0) THEN 'peak too high' END, CASE WHEN 20 * log10(greatest(rms, 1e-9)) < -45 THEN 'silent' END], lambda x : x IS NOT NULL) AS flags FROM g",
    ),
    "activity_mask": (lambda s, d: L.activity_mask(signal(s, d), 200).select("series_id", "pos", "active"), _sql("abs(value) > 0.15 * avg(abs(value)) OVER (PARTITION BY series_id, pos // 200) AS active")),
    "trim_tail": (lambda s, d: _rows(L.trim_tail(signal(s, d).withColumn("value", F.when(F.col("pos") > 1500, F.col("value") / 1000).otherwise(F.col("value"))), RATE)), W + ", x AS (SELECT series_id, pos, CASE WHEN pos > 1500 THEN value / 1000 ELSE value END AS value FROM signal), l AS (SELECT series_id, max(pos) FILTER (WHERE abs(value) > pow(10, -45 / 20.0)) AS last FROM x GROUP BY 1) SELECT series_id, pos, round(value, 6) AS value FROM x JOIN l USING (series_id) WHERE last IS NULL OR pos <= last + 5"),
    "trim_tail_windows": (lambda s, d: L.trim_tail_windows(signal(s, d).withColumn("value", F.when(F.col("pos") > 1500, F.lit(0.0)).otherwise(F.col("value"))), RATE).groupBy("series_id").agg(F.count(F.lit(1)).alias("kept")), None),
    "remove_offset": (lambda s, d: _rows(L.remove_offset(signal(s, d))), _sql("round(greatest(least(value - avg(value) OVER (PARTITION BY series_id), 1), -1), 6) AS value")),
    "normalize_rms": (lambda s, d: _rows(L.normalize_rms(signal(s, d))), W + ", g AS (SELECT series_id, CASE WHEN sqrt(avg(value * value)) >= pow(10, -3) THEN greatest(least(pow(10, -23 / 20.0) / sqrt(avg(value * value)), pow(10, 0.6)), pow(10, -0.6)) END AS gain FROM signal GROUP BY 1) SELECT series_id, pos, round(CASE WHEN gain IS NULL THEN value ELSE greatest(least(value * gain, 1), -1) END, 6) AS value FROM signal JOIN g USING (series_id)"),
    "normalize_peak": (lambda s, d: _rows(L.normalize_peak(signal(s, d))), _sql("round(greatest(least(value * pow(10, -1 / 20.0) / max(abs(value)) OVER (PARTITION BY series_id), 1), -1), 6) AS value")),
    "gated_loudness": (
        lambda s, d: _round(L.gated_loudness(signal(s, d), RATE, weighted=False), "lufs", "gain"),
        W + ", n AS (SELECT series_id, max(pos) + 1 AS n FROM signal GROUP BY 1), b AS (SELECT series_id, n, unnest(range(0, (n - 40) // 10 + 1)) AS b FROM n), z AS (SELECT b.series_id, b.b, sum(value * value) / 40 AS z FROM b JOIN signal s ON s.series_id = b.series_id AND s.pos BETWEEN b.b * 10 AND b.b * 10 + 39 GROUP BY 1, 2), h AS (SELECT *, -0.691 + 10 * log10(z) AS l FROM z WHERE z > 0 AND -0.691 + 10 * log10(z) > -70), r AS (SELECT series_id, -0.691 + 10 * log10(avg(z)) - 10 AS gate FROM h GROUP BY 1), g AS (SELECT series_id, -0.691 + 10 * log10(avg(z)) AS lufs FROM h JOIN r USING (series_id) WHERE l > gate GROUP BY 1) SELECT series_id, round(lufs, 6) AS lufs, round(CASE WHEN lufs IS NULL OR abs(-21 - lufs) > 40 THEN 1 ELSE pow(10, (-21 - lufs) / 20) END, 6) AS gain FROM n LEFT JOIN g USING (series_id)",
    ),
    "gated_loudness_weighted": (lambda s, d: _round(L.gated_loudness(signal(s, d), WEIGHTED_RATE), "lufs", "gain"), _weighted()),
    "lookahead_limit": (lambda s, d: _rows(L.lookahead_limit(signal(s, d), RATE, -9.0, 0.3, 50.0, smooth_hz=0, oversample=1)), W + ", g AS (SELECT *, min(least(1, pow(10, -9.3 / 20) / greatest(abs(value), 1e-12))) OVER (PARTITION BY series_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS gain FROM signal) SELECT series_id, pos, round(greatest(least(value * gain, pow(10, -9.3 / 20)), -pow(10, -9.3 / 20)), 6) AS value FROM g"),
    "true_peak_limit": (lambda s, d: _rows(L.lookahead_limit(signal(s, d), RATE, -9.0, 0.3, 50.0, smooth_hz=0)), _TRUE_PEAKS),
}
