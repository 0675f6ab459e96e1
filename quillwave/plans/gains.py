"""Queries on phrases, gains and alignment, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import align as A
from ..operators import frames as L
from ..operators import gain as G
from ..operators import segments as S
from ..session import table
from ..sources.fixtures import RATE, SIGNAL_SQL, TWO_SQL, scripts, signal, two_signals
from . import sql

LEVEL = -14.5  # dB: loud for this view


def _env(s: SparkSession, d: str) -> DataFrame:
    return L.sliding_rms(signal(s, d), 10).select("series_id", "pos", "env")


def _phrases(s: SparkSession, d: str) -> DataFrame:
    return G.detect_phrases(_env(s, d), RATE, LEVEL)


def _lengths(s: SparkSession, d: str) -> DataFrame:
    return signal(s, d).groupBy("series_id").agg((F.count(F.lit(1)) / RATE).alias("duration_sec"))


def _r(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


def _reactive(s: SparkSession, d: str) -> DataFrame:
    return G.reactive_gain(_env(s, d), -15.0, -16.0)


def _stepped(s: SparkSession, d: str) -> DataFrame:
    return signal(s, d).select("series_id", "pos", F.when(F.floor(F.col("pos") / 50) % 3 == 0, 1.5).otherwise(-4.0).alias("gain_db"))


def _banded(s: SparkSession, d: str) -> DataFrame:
    rows = signal(s, d).filter("series_id IN ('click', 'view', 'error')")
    return rows.select("pos", F.when(F.col("series_id") == "click", "low").when(F.col("series_id") == "view", "mid").otherwise("high").alias("band"), "value")


def _gain_curve(s: SparkSession, d: str) -> DataFrame:
    return signal(s, d).filter("series_id = 'signup'").select("pos", F.abs("value").alias("gain"))


def _chunks(s: SparkSession, d: str) -> DataFrame:
    return signal(s, d).select("series_id", F.floor(F.col("pos") / 300).alias("chunk_no"), (F.col("pos") % 300).alias("pos"), "value")


def _jobs(s: SparkSession, d: str) -> DataFrame:
    o = table(s, d, "orders")
    return o.select(F.col("o_orderkey").alias("job_id"), (F.col("o_orderkey") % 900 + 1).alias("n_source"), F.floor(F.col("o_totalprice") / 300).alias("n_target"), F.lit(RATE).alias("rate_hz"))


def _fit(s: SparkSession, d: str) -> DataFrame:
    voice, _ = two_signals(s, d)
    n = voice.count()
    return _r(A.fit_length(voice, n * 2 + 777, RATE), "value")


ENV = f"WITH {SIGNAL_SQL}, env AS (SELECT series_id, pos, sqrt(sum(value * value) OVER (PARTITION BY series_id ORDER BY pos ROWS BETWEEN 5 PRECEDING AND 4 FOLLOWING) / 10) AS env FROM signal)"
PHRASES = ENV + f""", loud AS (SELECT series_id, pos, CASE WHEN pos - lag(pos) OVER w - 1 >= 25 OR lag(pos) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM env WHERE 20 * log10(env + 1e-9) > {LEVEL} WINDOW w AS (PARTITION BY series_id ORDER BY pos)),
runs AS (SELECT series_id, pos, sum(new) OVER (PARTITION BY series_id ORDER BY pos) AS run FROM loud), spans AS (SELECT series_id, run, min(pos) AS a, max(pos) + 1 AS b FROM runs GROUP BY 1, 2 HAVING max(pos) + 1 - min(pos) >= 15),
phrases AS (SELECT series_id, CAST(row_number() OVER (PARTITION BY series_id ORDER BY a) - 1 AS INT) AS phrase_no, a / 100.0 AS start_sec, b / 100.0 AS end_sec, a, b FROM spans),
lengths AS (SELECT series_id, count(*) / 100.0 AS duration_sec FROM signal GROUP BY 1)"""
TWO = f"WITH {TWO_SQL}"
_REACT = "greatest(least(greatest(20 * log10(env + 1e-9) + 16.0, 0) * (-15.0 / 9.0), 0), -15.0)"
_FADE = "((exp(4 * ({0})) - 1) / (exp(4.0) - 1))"

# recursions along frames, and along rows: the factor depends on whether the target falls
_LOOKAHEAD = f"""WITH RECURSIVE {TWO_SQL}, l AS (SELECT pos // 5 AS f, sqrt(avg(value * value)) AS rms FROM voice GROUP BY 1), t0 AS (SELECT f, CASE WHEN rms > 0.15 THEN -5.0 ELSE 0.0 END AS t FROM (SELECT DISTINCT pos // 5 AS f FROM music) LEFT JOIN l USING (f)),
 t AS MATERIALIZED (SELECT f, lead(t, 2, 0.0) OVER (ORDER BY f) AS t FROM t0), r AS (SELECT f, CAST((1 - CASE WHEN t < 0 THEN exp(-1.0) ELSE exp(-0.1) END) * t AS DOUBLE) AS s FROM t WHERE f = 0 UNION ALL SELECT t.f, CASE WHEN t.t < s THEN exp(-1.0) * s + (1 - exp(-1.0)) * t.t ELSE exp(-0.1) * s + (1 - exp(-0.1)) * t.t END FROM r JOIN t ON t.f = r.f + 1),
 c AS (SELECT f, s, coalesce(lead(s) OVER (ORDER BY f), s) AS after, coalesce(lag(s) OVER (ORDER BY f), s) AS before FROM r), g AS (SELECT m.pos, m.value, s, after, before, (m.pos - f * 5 - 2.5) / 5 AS part FROM music m JOIN c ON f = m.pos // 5)
 SELECT pos, round(value * pow(10, (s + part * CASE WHEN part >= 0 THEN after - s ELSE s - before END) / 20), 6) AS value FROM g"""
_HELD = f"""WITH RECURSIVE {TWO_SQL}, l0 AS (SELECT m.pos, coalesce(v.value, 0) AS v FROM music m LEFT JOIN voice v ON v.pos = m.pos), l1 AS (SELECT pos, 20 * log10(greatest(sqrt(greatest(sum(v * v) OVER (ORDER BY pos ROWS BETWEEN 5 PRECEDING AND 4 FOLLOWING), 0) / 10), 1e-5)) AS level FROM l0),
 l2 AS (SELECT pos, CASE WHEN max(level) OVER (ORDER BY pos ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) > -15 THEN greatest(level, -14) ELSE level END AS level FROM l1), t AS MATERIALIZED (SELECT pos, pow(10, greatest(least(-15 - level, 0), -10) / 20) AS t FROM l2),
 r AS (SELECT pos, CASE WHEN t < 1 THEN exp(-1 / 8.0) + (1 - exp(-1 / 8.0)) * t ELSE exp(-1 / 100.0) + (1 - exp(-1 / 100.0)) * t END AS s FROM t WHERE pos = 0 UNION ALL SELECT t.pos, CASE WHEN t.t < s THEN exp(-1 / 8.0) * s + (1 - exp(-1 / 8.0)) * t.t ELSE exp(-1 / 100.0) * s + (1 - exp(-1 / 100.0)) * t.t END FROM r JOIN t ON t.pos = r.pos + 1),
 g AS (SELECT pos, coalesce(lead(s, 2) OVER (ORDER BY pos), 1.0) AS gain FROM r) SELECT m.pos, round(m.value * gain, 6) AS value FROM music m JOIN g ON g.pos = m.pos"""

QUERIES = {
    "detect_phrases": (_phrases, PHRASES + " SELECT series_id, phrase_no, start_sec, end_sec FROM phrases"),
    "long_pauses": (lambda s, d: _r(G.long_pauses(_phrases(s, d), _lengths(s, d), 0.5, 100.0, 50.0), "plateau_start", "plateau_end"), PHRASES + ", g AS (SELECT series_id, coalesce(lag(end_sec) OVER (PARTITION BY series_id ORDER BY phrase_no), 0) AS gap_start, start_sec AS gap_end FROM phrases UNION ALL SELECT p.series_id, max(end_sec), any_value(duration_sec) FROM phrases p JOIN lengths l ON p.series_id = l.series_id GROUP BY 1) SELECT series_id, CAST(gap_start AS DOUBLE) AS gap_start, gap_end, round(gap_start + 0.1, 6) AS plateau_start, round(gap_end - 0.05, 6) AS plateau_end FROM g WHERE gap_end - gap_start >= 0.5"),
    "script_gain": (lambda s, d: _r(G.script_gain(_phrases(s, d), _lengths(s, d), RATE), "gain_db"), None),
    "reactive_gain": (lambda s, d: _r(_reactive(s, d), "gain_db"), ENV + f" SELECT series_id, pos, round({_REACT}, 6) AS gain_db FROM env"),
    "combine_gain": (lambda s, d: _r(G.combine_gain(_stepped(s, d), _reactive(s, d)), "gain_db"), ENV + f" SELECT series_id, pos, round(CASE WHEN pos // 50 % 3 = 0 THEN 1.5 ELSE least(-4.0, {_REACT}) END, 6) AS gain_db FROM env"),
    "apply_gain": (lambda s, d: _r(G.apply_gain(two_signals(s, d)[1], _stepped(s, d).filter("series_id = 'view'")), "value"), TWO + " SELECT pos, round(value * pow(10, CASE WHEN pos // 50 % 3 = 0 THEN 1.5 ELSE -4.0 END / 20), 6) AS value FROM music"),
    "duck_lookahead": (lambda s, d: _r(G.duck_lookahead(*two_signals(s, d), RATE, frame_ms=50.0, threshold_rms=0.15), "value"), _LOOKAHEAD),
    "duck_hold": (lambda s, d: _r(G.duck_hold(*two_signals(s, d), RATE, threshold_db=-15.0, hold_ms=100.0, window_ms=100.0), "value"), _HELD),
    "duck_bands": (lambda s, d: _r(G.duck_bands(_banded(s, d), _gain_curve(s, d)), "value"), f"WITH {SIGNAL_SQL} SELECT b.pos, round(sum(b.value * (1 - (1 - abs(g.value)) * CASE b.series_id WHEN 'click' THEN 0.25 WHEN 'view' THEN 1.0 ELSE 0.5 END)), 6) AS value FROM signal b JOIN signal g ON b.pos = g.pos AND g.series_id = 'signup' WHERE b.series_id IN ('click', 'view', 'error') GROUP BY b.pos"),
    "vad_gain": (
        lambda s, d: _r(G.vad_gain(signal(s, d).select("series_id", "pos", "value"), _phrases(s, d), RATE), "value"),
        PHRASES + ", l AS (SELECT series_id, max(b) + 10 AS stop FROM phrases GROUP BY 1), i AS (SELECT DISTINCT s.series_id, s.pos FROM signal s JOIN phrases p ON s.series_id = p.series_id AND s.pos >= p.a - 5 AND s.pos < p.b + 5) SELECT s.series_id, s.pos, round(s.value * CASE WHEN i.pos IS NOT NULL OR l.stop IS NULL THEN 1.0 ELSE 0.15 END, 6) AS value FROM signal s LEFT JOIN l ON s.series_id = l.series_id LEFT JOIN i ON s.series_id = i.series_id AND s.pos = i.pos WHERE l.stop IS NULL OR s.pos < l.stop",
    ),
    "fades": (lambda s, d: _r(G.fades(signal(s, d), RATE).select("series_id", "pos", "value"), "value"), f"WITH {SIGNAL_SQL}, n AS (SELECT *, max(pos) OVER (PARTITION BY series_id) + 1 AS n FROM signal) SELECT series_id, pos, round(value * CASE WHEN n > 300 AND pos < 300 THEN {_FADE.format('pos / 299.0')} ELSE 1 END * CASE WHEN n > 500 AND pos >= n - 500 THEN {_FADE.format('1 - (pos - (n - 500)) / 499.0')} ELSE 1 END, 6) AS value FROM n"),
    "segment_fades": (lambda s, d: _r(G.segment_fades(signal(s, d), RATE).select("series_id", "pos", "value"), "value"), f"WITH {SIGNAL_SQL}, x AS (SELECT series_id, pos + 2 AS pos, value FROM signal UNION ALL SELECT DISTINCT series_id, unnest([0, 1]), 0.0 FROM signal), n AS (SELECT *, max(pos) OVER (PARTITION BY series_id) + 1 AS n FROM x) SELECT series_id, pos, round(value * CASE WHEN pos < 10 THEN (1 - cos(pi() * pos / 9.0)) / 2 ELSE 1 END * CASE WHEN pos >= n - 5 THEN (1 - cos(pi() * (1 - (pos - (n - 5)) / 4.0))) / 2 ELSE 1 END, 6) AS value FROM n"),
    "align_overlay": (lambda s, d: _r(A.align_overlay(*two_signals(s, d), RATE), "voice", "music"), TWO + ", p AS (SELECT unnest(range(0, (SELECT max(pos) + 1 + 1200 FROM voice))) AS pos) SELECT p.pos, round(coalesce(v.value, 0), 6) AS voice, round(coalesce(m.value, 0), 6) AS music FROM p LEFT JOIN voice v ON v.pos + 400 = p.pos LEFT JOIN music m ON m.pos = p.pos"),
    "mix": (lambda s, d: _r(A.mix(*two_signals(s, d), RATE), "value"), None),
    "fit_length": (
        _fit,
        TWO + ", c AS (SELECT n, least(50, n // 4) AS seam, n - least(50, n // 4) AS stride, 2 * n + 777 AS t FROM (SELECT count(*) AS n FROM voice)), o AS (SELECT *, unnest(range(0, t)) AS pos FROM c), p AS (SELECT pos, seam, stride, pos % stride AS place, pos % stride < seam AND pos >= stride AS soft FROM o) SELECT p.pos, round(CASE WHEN soft THEN a.value * sin(place / seam * pi() / 2) + b.value * cos(place / seam * pi() / 2) ELSE a.value END, 6) AS value FROM p JOIN voice a ON a.pos = place LEFT JOIN voice b ON soft AND b.pos = place + stride",
    ),
    "fit_report": (
        lambda s, d: _r(A.fit_report(_jobs(s, d)), "source_sec", "target_sec", "seam_ms"),
        "WITH j AS (SELECT o_orderkey AS job_id, o_orderkey % 900 + 1 AS n, CAST(floor(o_totalprice / 300) AS BIGINT) AS t FROM orders), k AS (SELECT *, least(50, n // 4) AS seam FROM j), m AS (SELECT *, CASE WHEN t = 0 OR n = t THEN 'used_as_is' WHEN n > t THEN 'trimmed' WHEN seam = 0 THEN 'tiled_no_xfade' ELSE 'looped' END AS mode FROM k) SELECT job_id, mode, CAST(CASE mode WHEN 'tiled_no_xfade' THEN ceil(t / n) WHEN 'looped' THEN 1 + ceil((t - n) / (n - seam)) ELSE 1 END AS BIGINT) AS loops, round(n / 100.0, 6) AS source_sec, round(t / 100.0, 6) AS target_sec, round(CASE WHEN mode = 'looped' THEN seam ELSE 0 END * 10.0, 6) AS seam_ms FROM m",
    ),
    "crossfade_concat": (
        lambda s, d: _r(A.crossfade_concat(_chunks(s, d), 30), "value"),
        f"WITH {SIGNAL_SQL}, c AS (SELECT series_id, pos // 300 AS c, pos % 300 AS p, value FROM signal), z AS (SELECT series_id, c, count(*) AS n FROM c GROUP BY 1, 2), y AS (SELECT *, CASE WHEN lag(n) OVER k IS NULL OR least(30, lag(n) OVER k // 2, n // 2) < 2 THEN 0 ELSE least(30, lag(n) OVER k // 2, n // 2) END AS head FROM z WINDOW k AS (PARTITION BY series_id ORDER BY c)), x AS (SELECT *, coalesce(lead(head) OVER (PARTITION BY series_id ORDER BY c), 0) AS tail FROM y), w AS (SELECT *, coalesce(sum(n - tail) OVER (PARTITION BY series_id ORDER BY c ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM x) SELECT series_id, CAST(start + p AS BIGINT) AS pos, round(sum(value * CASE WHEN p < head THEN pow(sin(p / (head - 1) * pi() / 2), 2) ELSE 1 END * CASE WHEN tail > 0 AND p >= n - tail THEN pow(cos((p - (n - tail)) / (tail - 1) * pi() / 2), 2) ELSE 1 END), 6) AS value FROM c JOIN w USING (series_id, c) GROUP BY 1, 2",
    ),
    "downmix": (lambda s, d: _r(A.downmix(signal(s, d).unionByName(signal(s, d).withColumn("channel", F.lit(1)).withColumn("value", F.col("value") / 3))), "value"), f"WITH {SIGNAL_SQL} SELECT series_id, pos, round((value + value / 3) / 2, 6) AS value FROM signal"),
    "wet_dry_blend": (lambda s, d: _r(A.wet_dry_blend(*two_signals(s, d), 0.25), "value"), TWO + " SELECT v.pos, round(greatest(least(0.75 * v.value + 0.25 * m.value, 1), -1), 6) AS value FROM voice v JOIN music m ON v.pos = m.pos"),
    "resample_linear": (lambda s, d: A.resample_linear(two_signals(s, d)[0], 100, 160), TWO + ", n AS (SELECT max(pos) + 1 AS n FROM voice), t AS (SELECT unnest(range(0, n * 160 // 100)) AS pos, n FROM n), x AS (SELECT pos, n, least(floor(pos * 100 / 160.0), n - 1) AS lo, least(pos * 100 / 160.0, n - 1.0) AS e FROM t) SELECT x.pos, a.value * (1 - (e - lo)) + b.value * (e - lo) AS value FROM x JOIN voice a ON a.pos = lo JOIN voice b ON b.pos = least(lo + 1, n - 1)"),
    "repeat_upsample": (lambda s, d: A.repeat_upsample(two_signals(s, d)[0].select("pos", (F.abs("value") > 0.1).alias("active")), 3, two_signals(s, d)[0].count() * 3 + 5), TWO + ", n AS (SELECT count(*) * 3 + 5 AS n FROM voice), p AS (SELECT unnest(range(0, n)) AS pos FROM n) SELECT p.pos, coalesce(abs(v.value) > 0.1, false) AS active FROM p LEFT JOIN voice v ON v.pos = p.pos // 3"),
    "dedupe_asset_cache": (lambda s, d: A.dedupe_asset_cache(S.parse(scripts(s, d)), 24000), f"WITH {sql.PARSED} SELECT DISTINCT subtype, 24000 AS rate_hz FROM filled WHERE type = 'breath'"),
}
