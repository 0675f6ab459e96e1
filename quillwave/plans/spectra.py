"""Queries on spectra, metrics and scores, with their SQL. Bands are scaled to the view's rate of 100 rows a second."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import spectrum as P
from ..session import table
from ..sources.fixtures import RATE, SIGNAL_SQL, TWO_SQL, signal, two_signals
from . import levels

SIZE = 64
BANDS = {"warm": (1.0, 3.0), "present": (20.0, 50.0), "band": (10.0, 40.0)}


def _spectrum(s: SparkSession, d: str) -> DataFrame:
    return P.dft_frames(signal(s, d), RATE, SIZE)


def _features(s: SparkSession, d: str) -> DataFrame:
    return P.frame_features(signal(s, d), RATE, SIZE)


def _r(df: DataFrame, digits: int, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


def _lengths(s: SparkSession, d: str) -> DataFrame:
    return signal(s, d).groupBy("series_id").agg((F.count(F.lit(1)) / RATE).alias("duration_sec"))


def _metrics(s: SparkSession, d: str) -> DataFrame:
    return P.metrics(signal(s, d), RATE, SIZE, BANDS["warm"], BANDS["present"], BANDS["band"], weighted=False, quiet=0.15)


def _chunks(s: SparkSession, d: str) -> DataFrame:
    return signal(s, d).select("series_id", F.floor(F.col("pos") / 400).alias("chunk_no"), (F.col("pos") % 400).alias("pos"), "value")


def _attempts(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events")
    return e.select(F.col("user_id").alias("job_id"), F.col("event_id").alias("attempt"), (F.col("event_type") != "error").alias("valid"), F.least(F.col("value") / 120.0, F.lit(1.0)).alias("score"))


SPECTRUM = f"""WITH {SIGNAL_SQL}, n AS (SELECT series_id, max(pos) + 1 AS n FROM signal GROUP BY 1), fr AS (SELECT series_id, unnest(range(0, (n - 64) // 32 + 1)) AS frame FROM n),
x AS (SELECT fr.series_id, fr.frame, pos - frame * 32 AS k, value - avg(value) OVER (PARTITION BY fr.series_id, fr.frame) AS v FROM fr JOIN signal s ON s.series_id = fr.series_id AND s.pos BETWEEN frame * 32 AND frame * 32 + 63),
w AS (SELECT series_id, frame, k, v * (0.5 - 0.5 * cos(2 * pi() * k / 64)) AS v FROM x), b AS (SELECT unnest(range(0, 33)) AS bin),
f AS (SELECT series_id, frame, bin, sum(v * cos(2 * pi() * bin * k / 64)) AS re, sum(v * sin(2 * pi() * bin * k / 64)) AS im FROM w, b GROUP BY 1, 2, 3),
spectrum AS (SELECT series_id, frame, bin, bin * 100.0 / 64 AS hz, (re * re + im * im) / (100.0 * 24) * CASE WHEN bin IN (0, 32) THEN 1 ELSE 2 END AS power, sqrt(re * re + im * im) AS magnitude FROM f),
psd AS (SELECT series_id, bin, hz, avg(power) AS psd FROM spectrum GROUP BY 1, 2, 3)"""
ONSETS = SPECTRUM + ", l AS (SELECT series_id, frame, magnitude - lag(magnitude) OVER (PARTITION BY series_id, bin ORDER BY frame) AS d FROM spectrum), ons AS (SELECT series_id, frame, avg(greatest(d, 0)) AS strength FROM l WHERE d IS NOT NULL GROUP BY 1, 2)"

def _bare(query: str) -> str:
    """A metric's SQL as a table, its value not rounded but where the operator itself rounds."""
    return f"({query})" if "rms_std" in query or "silence_ratio" in query else "(" + re.sub(r"round\((\w+), \d+\) AS", r"\1 AS", query) + ")"


QUERIES = {
    "dft_frames": (lambda s, d: _r(_spectrum(s, d), 4, "power", "magnitude"), SPECTRUM + " SELECT series_id, frame, bin, hz, round(power, 4) AS power, round(magnitude, 4) AS magnitude FROM spectrum"),
    "band_balance": (lambda s, d: _r(P.band_balance(_features(s, d), BANDS["warm"], BANDS["present"]), 6, "warmth", "presence"), SPECTRUM + ", g AS (SELECT series_id, coalesce(sum(psd) FILTER (WHERE hz BETWEEN 1 AND 3), 0) AS a, coalesce(sum(psd) FILTER (WHERE hz BETWEEN 20 AND 50), 0) AS b FROM psd GROUP BY 1) SELECT series_id, round(a, 6) AS warmth, round(b, 6) AS presence, a >= b AS passed FROM g"),
    "rolloff": (lambda s, d: P.rolloff(_features(s, d)), SPECTRUM + ", c AS (SELECT series_id, frame, hz, sum(magnitude) OVER (PARTITION BY series_id, frame ORDER BY bin) AS b, sum(magnitude) OVER (PARTITION BY series_id, frame) AS t FROM spectrum), r AS (SELECT series_id, frame, min(hz) AS hz FROM c WHERE b >= 0.85 * t GROUP BY 1, 2) SELECT series_id, quantile_cont(hz, 0.5) AS rolloff_hz, quantile_cont(hz, 0.5) <= 8000 AS passed FROM r GROUP BY 1"),
    "flatness": (lambda s, d: _r(P.flatness(_features(s, d), BANDS["band"]), 4, "flatness"), SPECTRUM + ", g AS (SELECT series_id, exp(avg(ln(greatest(psd, 1e-20)))) / avg(greatest(psd, 1e-20)) AS x FROM psd WHERE hz BETWEEN 10 AND 40 GROUP BY 1) SELECT series_id, round(x, 4) AS flatness, x <= 0.3 AS passed FROM g"),
    "centroid_variation": (lambda s, d: _r(P.centroid_variation(_features(s, d)), 4, "variation"), SPECTRUM + ", c AS (SELECT series_id, frame, sum(hz * magnitude) / sum(magnitude) AS c FROM spectrum GROUP BY 1, 2), g AS (SELECT series_id, stddev_pop(c) / greatest(avg(c), 1) * 100 AS x FROM c GROUP BY 1) SELECT series_id, round(x, 4) AS variation, x <= 50 AS passed FROM g"),
    "harmonic_stability": (lambda s, d: _r(P.harmonic_stability(_features(s, d)), 4, "stability"), SPECTRUM + ", p0 AS (SELECT series_id, frame, ((round(12 * log2(hz / 440.0)) % 12) + 12) % 12 AS pitch, sum(power) AS p FROM spectrum WHERE hz > 0 GROUP BY 1, 2, 3), p1 AS (SELECT series_id, frame, pitch, p / greatest(max(p) OVER (PARTITION BY series_id, frame), 1e-20) AS p FROM p0), p2 AS (SELECT *, lag(p) OVER (PARTITION BY series_id, pitch ORDER BY frame) AS q FROM p1), g AS (SELECT series_id, pitch, CASE WHEN stddev_pop(p) < 1e-8 OR count(*) < 2 THEN 1.0 ELSE corr(q, p) END AS c FROM p2 GROUP BY 1, 2) SELECT series_id, round(avg(c), 4) AS stability, avg(c) >= 0.85 AS passed FROM g GROUP BY 1"),
    "onset_strength": (lambda s, d: _r(P.onset_strength(_features(s, d)), 4, "onset_ratio"), ONSETS + ", g AS (SELECT series_id, max(strength) / quantile_cont(strength, 0.5) AS r FROM ons GROUP BY 1) SELECT series_id, round(r, 4) AS onset_ratio, r < 5 AS passed FROM g"),
    "onset_density": (lambda s, d: _r(P.onset_density(_features(s, d), _lengths(s, d)), 6, "onsets_per_sec"), ONSETS + ", m AS (SELECT *, avg(strength) OVER (PARTITION BY series_id ORDER BY frame ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS mean, lag(strength) OVER w AS a, lead(strength) OVER w AS b FROM ons WINDOW w AS (PARTITION BY series_id ORDER BY frame)), g AS (SELECT m.series_id, count(*) FILTER (WHERE strength >= coalesce(a, strength) AND strength > coalesce(b, -1) AND strength > 1.5 * mean) / (any_value(n.n) / 100.0) AS r FROM m JOIN n ON m.series_id = n.series_id GROUP BY 1) SELECT series_id, round(r, 6) AS onsets_per_sec, r <= 0.5 AS passed FROM g"),
    "boundary_similarity": (
        lambda s, d: _r(P.boundary_similarity(_chunks(s, d), 128, RATE, SIZE, least_rows=100, bands=12), 4, "similarity"),
        f"""WITH {SIGNAL_SQL}, c AS (SELECT series_id AS s, pos // 400 AS c, pos % 400 AS p, value, count(*) OVER (PARTITION BY series_id, pos // 400) AS n FROM signal), e AS (SELECT s, 't' AS side, c, n, p - greatest(n - 128, 0) AS p, value FROM c WHERE p >= n - 128 UNION ALL SELECT s, 'h', c, n, p, value FROM c WHERE p < 128),
 fr AS (SELECT s, side, c, unnest(range(0, (least(max(n), 128) - 64) // 32 + 1)) AS frame FROM e GROUP BY 1, 2, 3), x AS (SELECT fr.s, fr.side, fr.c, frame, p - frame * 32 AS k, value - avg(value) OVER (PARTITION BY fr.s, fr.side, fr.c, frame) AS v FROM fr JOIN e ON e.s = fr.s AND e.side = fr.side AND e.c = fr.c AND p BETWEEN frame * 32 AND frame * 32 + 63),
 f AS (SELECT s, side, c, frame, bin, sum(v * (0.5 - 0.5 * cos(2 * pi() * k / 64)) * cos(2 * pi() * bin * k / 64)) AS re, sum(v * (0.5 - 0.5 * cos(2 * pi() * k / 64)) * sin(2 * pi() * bin * k / 64)) AS im FROM x, (SELECT unnest(range(0, 33)) AS bin) GROUP BY 1, 2, 3, 4, 5),
 m AS (SELECT s, side, c, bin, avg((re * re + im * im) * CASE WHEN bin IN (0, 32) THEN 1 ELSE 2 END / 2400.0) AS p FROM f GROUP BY 1, 2, 3, 4),
 e3 AS (SELECT band, band * 50.0 / 13 AS lo, (band + 1) * 50.0 / 13 AS mi, (band + 2) * 50.0 / 13 AS hi FROM (SELECT unnest(range(0, 12)) AS band)), w AS (SELECT band, bin, greatest(0, least((bin * 100.0 / 64 - lo) / (mi - lo), (hi - bin * 100.0 / 64) / (hi - mi))) * 2 / (hi - lo) AS w FROM e3, (SELECT unnest(range(0, 33)) AS bin)),
 l AS (SELECT s, side, c, band, sum(p * w) AS p FROM m JOIN w USING (bin) GROUP BY 1, 2, 3, 4), g AS (SELECT a.s, a.c AS boundary, sum(a.p * b.p) / greatest(sqrt(sum(a.p * a.p)) * sqrt(sum(b.p * b.p)), 1e-8) AS cos FROM l a JOIN l b ON a.s = b.s AND a.side = 't' AND b.side = 'h' AND b.c = a.c + 1 AND a.band = b.band GROUP BY 1, 2),
 y AS (SELECT DISTINCT s, c, n FROM c), z AS (SELECT a.s, a.c AS boundary, least(a.n, b.n, 128) AS r FROM y a JOIN y b ON a.s = b.s AND b.c = a.c + 1) SELECT z.s AS series_id, z.boundary, round(CASE WHEN r < 100 THEN 1.0 ELSE coalesce(cos, 1.0) END, 4) AS similarity, CASE WHEN r < 100 THEN 1.0 ELSE coalesce(cos, 1.0) END >= 0.85 AS passed FROM z LEFT JOIN g USING (s, boundary)""",
    ),
    "level_ratio": (lambda s, d: _r(P.level_ratio(*two_signals(s, d), two_signals(s, d)[0].select("pos", (F.abs("value") > 0.1).alias("active"))), 6, "ratio_db"), f"WITH {TWO_SQL}, g AS (SELECT 20 * log10(sqrt(avg(v.value * v.value) + 1e-10) / sqrt(avg(m.value * m.value) + 1e-10)) AS r FROM voice v JOIN music m ON v.pos = m.pos WHERE abs(v.value) > 0.1) SELECT round(r, 6) AS ratio_db, r >= 15 AS passed FROM g"),
    "gain_rate": (lambda s, d: _r(P.gain_rate(signal(s, d), RATE), 6, "rate"), f"WITH {SIGNAL_SQL}, e AS (SELECT series_id, pos, 20 * log10(sqrt(sum(value * value) OVER (PARTITION BY series_id ORDER BY pos ROWS BETWEEN 5 PRECEDING AND 4 FOLLOWING) / 10 + 1e-10)) AS l FROM signal), x AS (SELECT series_id, abs(l - lag(l) OVER (PARTITION BY series_id ORDER BY pos)) * 100 AS st FROM e), g AS (SELECT series_id, quantile_cont(st, 0.99) AS r FROM x WHERE st IS NOT NULL GROUP BY 1) SELECT series_id, round(r, 6) AS rate, r <= 30 AS passed FROM g"),
    "best_candidate": (lambda s, d: P.best_candidate(_attempts(s, d)), "WITH a AS (SELECT user_id AS job_id, event_id AS attempt, CASE WHEN event_type <> 'error' THEN least(value / 120.0, 1.0) ELSE 0.0 END AS score, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events), b AS (SELECT *, coalesce(max(score) OVER (PARTITION BY job_id ORDER BY attempt ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM a WHERE n <= 3), c AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY score DESC, attempt) AS r FROM b WHERE before <= 0.8) SELECT job_id, attempt, score FROM c WHERE r = 1"),
}

_TABLES = {
    "balance": QUERIES["band_balance"][1], "rolloff": QUERIES["rolloff"][1], "onset": QUERIES["onset_strength"][1], "clipping": levels.QUERIES["clipping"][1].replace("0.5", "0.99"),
    "flatness": QUERIES["flatness"][1], "centroid": QUERIES["centroid_variation"][1], "harmony": QUERIES["harmonic_stability"][1], "density": QUERIES["onset_density"][1],
    "dynamics": levels.QUERIES["dynamic_range"][1], "silence": levels.QUERIES["silence_ratio"][1], "loudness": levels.QUERIES["gated_loudness"][1],
}
_METRICS = "WITH m AS (SELECT s.series_id, " + ", ".join(
    f"{t}.{v}" for t, names in P.CHECKS.items() for v in names
) + ", " + ", ".join("coalesce(abs(loudness.lufs + 16) <= 6, false) AS loudness_passed" if t == "loudness" else f"coalesce({t}.passed, false) AS {t}_passed" for t in _TABLES) + " FROM (SELECT DISTINCT event_type AS series_id FROM events) s " + " ".join(
    f"LEFT JOIN {_bare(q)} {t} ON s.series_id = {t}.series_id" for t, q in _TABLES.items()
) + ")"


def _report(s: SparkSession, d: str) -> DataFrame:
    rows = P.qa_report(_metrics(s, d), "series_id = 'click'")
    return rows.select("series_id", "check", F.explode("metric").alias("name", "value"), "passed").withColumn("value", F.round("value", 4))


def _entry(check: str, name: str) -> str:
    if check not in P.MUSIC_CHECKS:
        return f"SELECT series_id, '{check}' AS \"check\", '{name}' AS name, round({name}, 4) AS value, {check}_passed AS passed FROM m"
    return f"SELECT series_id, '{check}', '{name}', CASE WHEN series_id <> 'click' THEN round({name}, 4) END, series_id = 'click' OR {check}_passed FROM m"


def _over(check: str, value: str, limit: float, by: float) -> str:
    return f"CASE WHEN {check}_passed THEN 1.0 ELSE greatest(0.0, 1 - ({value} / {limit} - 1) / {by}) END"


_PARTS = {
    "balance": "CASE WHEN warmth + presence > 0 THEN least(warmth / (warmth + presence) / 0.6, 1.0) ELSE 0.5 END", "rolloff": _over("rolloff", "rolloff_hz", P.MAX_ROLLOFF, 1.0),
    "onset": _over("onset", "onset_ratio", P.ONSET_RATIO, 2.0), "clipping": "CASE WHEN clipping_passed THEN 1.0 ELSE greatest(0.0, 1 - clipped_ratio * 1000) END",
    "loudness": "greatest(0.0, 1 - abs(lufs + 16) / 10)", "flatness": _over("flatness", "flatness", P.MAX_FLATNESS, 2.33), "centroid": _over("centroid", "variation", P.MAX_CENTROID, 1.0),
    "harmony": f"CASE WHEN harmony_passed THEN 1.0 ELSE greatest(0.0, stability / {P.MIN_HARMONIC}) END", "density": _over("density", "onsets_per_sec", P.ONSET_DENSITY, 2.0), "dynamics": _over("dynamics", "rms_std", P.MAX_RMS_STD, 3.0),
}
QUERIES |= {
    "qa_report": (_report, _METRICS + " " + " UNION ALL ".join(_entry(c, n) for c, names in P.CHECKS.items() for n in names)),
    "composite_score": (lambda s, d: P.composite_score(_metrics(s, d)), _METRICS + " SELECT series_id, round(" + " + ".join(f"coalesce({_PARTS[k]}, 0.0) * {w}" for k, w in P.WEIGHTS.items()) + ", 4) AS score FROM m"),
}
