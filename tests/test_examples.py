"""Small cases worked out by hand."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillwave.functions import filters as Z
from quillwave.functions import recursion as R
from quillwave.functions import text as X
from quillwave.operators import align as A
from quillwave.operators import catalogue as C
from quillwave.operators import frames as L
from quillwave.operators import gain as G
from quillwave.operators import prompts as P
from quillwave.operators import segments as S
from quillwave.operators import sentences as N
from quillwave.operators import spectrum as Q
from quillwave.operators import timeline as T
from quillwave.operators import vectors as V
from quillwave.sources import assets


def of(spark, change, *texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    out = [r[0] for r in rows.orderBy("i").select(change(F.col("text"))).collect()]
    return out[0] if len(texts) == 1 else out


def script(spark, text):
    return spark.createDataFrame([(1, text)], "script_id long, text string")


def series(spark, *values):
    return spark.createDataFrame([(name, 0, i, float(x)) for name, v in values for i, x in enumerate(v)], "series_id string, channel int, pos long, value double")


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_pauses_of_both_policies(spark):
    first = S.paragraph_pause_priority(script(spark, "Line one.\n\nLine two. [pause:2s] [pause:3s]\n\nEnd. [0s pause]"))
    assert [(r.type, r.duration_sec, r.source) for r in first.orderBy("seg_no").collect()] == [("speech", None, None), ("pause", 6.5, "paragraph"), ("speech", None, None), ("pause", 5.0, "explicit"), ("speech", None, None)]
    lone = S.parse(script(spark, "Relax now.\n\n[pause:5s]\n\nBreathe deeply.\n\nMore. [pause:1s] [pause:4s]"))
    assert [(r.type, r.duration_sec) for r in lone.orderBy("seg_no").collect()] == [("speech", None), ("pause", 5.0), ("speech", None), ("pause", 3.0), ("speech", None), ("pause", 4.0)]


def test_breaths_and_voices(spark):
    out = S.parse(script(spark, "One [INHALE] two [voice:closing] three [2.5 sec pause]")).orderBy("seg_no").collect()
    assert [(r.type, r.text, r.voice) for r in out] == [("speech", "One", None), ("breath", None, None), ("speech", "two", None), ("speech", "three", "closing"), ("pause", None, None)]
    assert out[1].subtype == "inhale" and out[4].duration_sec == 2.5
    assert S.reject_empty_scripts(script(spark, " \n\n "), S.parse(script(spark, " \n\n "))).count() == 1


def test_numbers(spark):
    got = of(spark, X.expand_integers, "432", "0", "1000", "120045", "007", "1234567", "21 and 100")
    assert got == ["four hundred and thirty-two", "zero", "one thousand", "one hundred and twenty thousand forty-five", "seven", "1234567", "twenty-one and one hundred"]
    assert of(spark, X.expand_number_ranges, "4-7-8 then 10-20") == "four, seven, eight then ten, twenty"
    assert of(spark, X.expand_text, "Target is 432 Hz.") == "Target is four hundred and thirty-two hertz."


def test_punctuation_and_words(spark):
    assert of(spark, X.normalize_punctuation, "a: b -- c... well-being 3-4") == "a, b , c. wellbeing 3-4"
    assert of(spark, X.respell, "OM and Chakra") == "ohm and chah-kra"
    assert of(spark, X.mark_sounds, "om") == "[om](/oʊm/)"
    assert of(spark, X.contract_phrases, "You are here and cannot go") == "you're here and can't go"
    assert of(spark, X.tag_stress_words, "Peace [calm] fear") == "[Peace](+1) [calm] [fear](-1)"
    assert of(spark, X.sensory_ellipsis, "feel the warmth, the glow") == "feel the... warmth, the... glow"
    assert of(spark, X.normalize_case_space, " NASA  said\nOK ") == "nasa said ok"


def test_prosody(spark):
    assert of(spark, X.punctuate, "Now breathe. With each breath allow it as you exhale letting go") == "Now, breathe., With each breath, allow it, as you exhale, letting go."
    assert of(spark, X.break_long_clauses, "one two three four five six seven eight and then") == "one two three four five six seven eight, and then"
    assert of(spark, X.break_long_clauses, "one two and then") == "one two and then"
    assert of(spark, X.break_breath_groups, "a b c d e f g h i j k l m and n") == "a b c d e f g h i j k l m , and n"
    assert of(spark, X.vary_sentence_length, "a b c d e f g h i j, and then, as it") == "a b c d e f g h i j. And then, as it"
    assert of(spark, X.vary_sentence_length, "a b, and then") == "a b, and then"


def test_breath_groups_by_worked_cases(spark):
    twelve = " ".join(["go"] * 12)
    cases = {
        f"{twelve} and go": f"{twelve} , and go",  # the thirteenth word joins on: a comma before it
        f"{twelve} go and go": f"{twelve} go , and go",
        f"{twelve[:-3]} and go as go": f"{twelve[:-3]} and go , as go",  # eleven words, then a joining one that is the twelfth
        f"go, {twelve} while go": f"go, {twelve} , while go",  # a mark begins a new count
        f"{twelve} (no) so": f"{twelve} (no) so",
        f"{twelve}, and go": f"{twelve}, and go",
        f"{twelve} and {twelve} or x-y": f"{twelve} , and {twelve[:-3]} go , or x-y",
    }
    assert of(spark, X.break_breath_groups, *cases) == list(cases.values())


def test_preprocess_runs_all_steps(spark):
    assert of(spark, X.preprocess_text, "You are calm for 5 min [pause:2s]") == "you're [calm](+1) for five minutes... [pause:2s]"


def test_sentences(spark):
    merge = lambda t: N.merge_short_sentences(N.sentence_array(t))
    assert of(spark, merge, "Be still. Now let your breath slow all the way down. Yes. Good.") == ["Be still. Now let your breath slow all the way down. Yes. Good."]
    assert of(spark, merge, "Yes.") == ["Yes."]
    assert of(spark, merge, "This one is long enough. Short.") == ["This one is long enough.", "Short."]
    assert of(spark, merge, "A b. C d. E.") == ["A b. C d.", "E."]
    assert of(spark, N.estimate_tokens, "one two three") == 3


def test_merging_by_worked_cases(spark):
    cases = {
        "A b c d. E f g h.": ["A b c d.", "E f g h."],
        "A. B. C. D e.": ["A. B. C. D e."],  # short ones gather until there are four words
        "A b c d. E. F.": ["A b c d. E. F."],  # a short rest goes to the sentence before
        "A. B c d e. F.": ["A. B c d e.", "F."],
        "A b c. D e f g h. I j k l. M.": ["A b c. D e f g h.", "I j k l.", "M."],
        "A b. C.": ["A b. C."],
    }
    assert of(spark, lambda t: N.merge_short_sentences(N.sentence_array(t)), *cases) == list(cases.values())


def test_chunks(spark):
    long = " ".join(["word"] * 700) + "."
    chunks = of(spark, lambda t: N.chunk_by_tokens(N.sentence_array(t)), f"Short one here. {long} Last one.")
    assert [len(c.split()) for c in chunks] == [3, 307, 307, 86, 2]
    got = of(spark, N.chunk_by_chars, ("a" * 200 + ". " + "b" * 100 + "! " + "c" * 100))
    assert [len(c) for c in got] == [201, 203]
    assert of(spark, lambda t: N.chunk_by_chars(t, 360, False), "no end") == ["no end"]


def test_speed(spark):
    got = of(spark, N.annotate_speed, "Be still.", "Is this a question that is long enough?", "This trails off for a long while...", "This is a plain sentence of some length.")
    assert [round(x, 4) for x in got] == [0.792, 0.855, 0.828, 0.9]


def test_timeline(spark):
    items = T.timeline_offsets(T.pace_by_wpm(T.insert_gaps(S.parse(script(spark, "one two [voice:x] three four [pause:2s] five")))))
    got = [(r.type, round(r.start_sec, 4), round(r.end_sec, 4)) for r in items.orderBy("item_no").collect()]
    w = 60 / 140
    assert got == [("speech", 0.0, round(2 * w, 4)), ("gap", round(2 * w, 4), round(2 * w + 0.4, 4)), ("speech", round(2 * w + 0.4, 4), round(4 * w + 0.4, 4)), ("pause", round(4 * w + 0.4, 4), round(4 * w + 2.4, 4)), ("speech", round(4 * w + 2.4, 4), round(5 * w + 2.4, 4))]
    jobs = spark.createDataFrame([(1, 1200.3), (2, 40.0)], "job_id long, duration_sec double")
    assert rows(T.split_sessions(jobs).select("job_id", F.round("piece_sec", 3)), "job_id", "piece") == [(1, 570.0), (1, 570.0), (1, 60.3), (2, 40.0)]
    assert rows(T.plan_continuations(jobs).filter("job_id = 2").select("piece", "piece_sec"), "piece") == [(0, 40.0)]


def test_levels(spark):
    s = series(spark, ("a", [0.1, 1.0, -1.0, 0.8]), ("b", [0.0] * 48))
    assert rows(L.clipping(s).select("series_id", "clipped"), "series_id") == [("a", 2), ("b", 0)]
    quiet = L.silence_gaps(series(spark, ("q", [0.0] * 200)), 100, 10, max_silence_sec=1.0)
    assert rows(quiet, "series_id") == [("q", 0.0, 2.0)]
    assert rows(L.signal_sanity(spark.createDataFrame([("a",), ("b",), ("c",)], "series_id string"), s), "series_id") == [("a", "noise"), ("b", "silent"), ("c", "empty")]
    bad = series(spark, ("n", [math.nan, 1.0]), ("s", [1e-9] * 8), ("t", [0.5]), ("o", [0.5, 0.4] * 4))
    wanted = spark.createDataFrame([("n", 2), ("s", 8), ("t", 4), ("o", 8)], "series_id string, wanted_rows long")
    assert dict(rows(L.validate_candidates(wanted, bad).select("series_id", "reason"), "series_id")) == {"n": "NaN/Inf detected", "s": "Near-silent output", "t": "Output too short", "o": "OK"}


def test_trimmed_tail(spark):
    s = series(spark, ("a", [0.5, -0.5] * 50 + [0.0] * 100))
    assert L.trim_tail(s, 1000).count() == 150
    kept = L.trim_tail_windows(s, 1000).count()
    assert 100 <= kept <= 120


@pytest.mark.parametrize("block", [7, 100_000])
def test_linear_recursion_across_blocks(spark, block):
    x = np.random.default_rng(2).normal(size=50)
    got = [r.smooth for r in R.linear_ema(series(spark, ("a", x)), 0.9, block=block).orderBy("pos").collect()]
    now, want = 0.0, []
    for v in x:
        now = 0.9 * now + 0.1 * v
        want.append(now)
    assert np.allclose(got, want)


@pytest.mark.parametrize("block", [1, 100_000])
def test_asymmetric_recursion_across_blocks(spark, block):
    x = np.random.default_rng(3).random(3_000)
    now, want = 1.0, []
    for v in x:
        now += (v - now) * (1 - (0.5 if v < now else 0.9))
        want.append(now)
    got = [r.smooth for r in R.asymmetric_ema(series(spark, ("a", x), ("b", x[::-1])), 0.5, 0.9, 1.0, block=block).filter("series_id = 'a'").orderBy("pos").collect()]
    assert np.allclose(got, want, rtol=0, atol=1e-13)


def slow_filter(x, b, a, settled=False):
    """The difference equation; settled: as if the first value had always been there."""
    pad = len(a) - 1
    past = x[0] * sum(b) / sum(a) if settled else 0.0
    xs, ys = [x[0] if settled else 0.0] * pad + list(x), [past] * pad
    for i in range(pad, len(xs)):
        ys.append(sum(b[k] * xs[i - k] for k in range(len(b))) - sum(a[k] * ys[i - k] for k in range(1, len(a))))
    return np.array(ys[pad:])


def coefficients(system):
    """b and a of a state space: the response to one impulse, and the characteristic polynomial."""
    step, into, out, direct = system
    a = np.poly(step).real
    h = np.r_[direct, [out @ np.linalg.matrix_power(step, k) @ into for k in range(len(a) - 1)]]
    return np.convolve(h, a)[: len(a)], a


@pytest.mark.parametrize("block", [7, 100_000])
def test_filters_across_blocks(spark, block):
    x = np.random.default_rng(4).normal(size=60)
    s = series(spark, ("a", x), ("b", x * 2))
    for system in (Z.low_pass(6, 100), Z.low_pass(20, 100, True), Z.band_pass(5, 30, 100), Z.chained(Z.low_pass(30, 100), Z.low_pass(5, 100, True))):
        b, a = coefficients(system)
        for settled in (False, True):
            got = [r.value for r in Z.filtered(s, system, settled, block).filter("series_id = 'a'").orderBy("pos").collect()]
            assert np.allclose(got, slow_filter(x, b, a, settled), atol=1e-9)


def test_responses_of_the_filters():
    gain = lambda system, hz: abs(np.polyval(coefficients(system)[0], z := np.exp(2j * np.pi * hz / 100)) / np.polyval(coefficients(system)[1], z))
    half = np.sqrt(0.5)
    assert np.allclose([gain(Z.low_pass(6, 100), f) for f in (1e-9, 6, 50)], [1, half, 0], atol=1e-6)
    assert np.allclose([gain(Z.low_pass(6, 100, True), f) for f in (1e-9, 6, 50)], [0, half, 1], atol=1e-6)
    assert np.allclose([gain(Z.band_pass(5, 30, 100), f) for f in (1e-9, 5, 30, 50)], [0, half, half, 0], atol=1e-6)


def test_zero_phase(spark):
    x = np.sin(np.arange(80) / 9.0) + 0.2
    system = Z.low_pass(6, 100)
    b, a = coefficients(system)
    wide = np.r_[2 * x[0] - x[9:0:-1], x, 2 * x[-1] - x[-2:-11:-1]]
    want = slow_filter(slow_filter(wide, b, a, True)[::-1], b, a, True)[::-1][9:-9]
    got = {k: [r.value for r in Z.zero_phase(series(spark, ("a", x), ("s", x[:12])), system).filter(f"series_id = '{k}'").orderBy("pos").collect()] for k in "as"}
    assert np.allclose(got["a"], want, atol=1e-9) and np.allclose(got["s"], x[:12])
    bands = G.split_bands(series(spark, ("a", x)), 100.0, (10.0, 30.0)).groupBy("pos").agg(F.sum("value").alias("v"), F.count(F.lit(1)).alias("n")).orderBy("pos").collect()
    assert all(r.n == 3 for r in bands) and np.allclose([r.v for r in bands], x)


def shown(pieces, row, below=10**9):
    """What the highest piece under a rank draws on a row: the definition of the gain curve, row by row."""
    over = [p for p in pieces if p.a <= row < p.b and p["rank"] < below]
    if not over:
        return 0.0
    p = max(over, key=lambda p: p["rank"])
    t = min(1.0, max(0.0, (row - p["at"]) / {"fall": 70, "rise": 150}.get(p["kind"], 1)))
    curve = t * t * (3 - 2 * t)
    if p["kind"] == "fall":
        begin = shown(pieces, p.a, p["rank"])
        return begin + (-15 - begin) * curve
    return {"lift": 1.5, "hold": -15.0}.get(p["kind"], -15 + (p["aim"] + 15) * curve)


def test_gain_curve_against_its_definition(spark):
    r = np.random.default_rng(5)
    spans, at = [], 0.3
    for _ in range(25):  # dense speech and long pauses, so that falls begin in falls, rises, lifts and silence
        at += float(r.choice([0.26, 0.3, 0.5, 1.2, 1.6, 4.0]))
        spans.append((round(at, 2), round(at + float(r.choice([0.15, 0.2, 0.4, 3.0])), 2)))
        at = spans[-1][1]
    phrases = spark.createDataFrame([("a", i, a, b) for i, (a, b) in enumerate(spans)], "series_id string, phrase_no int, start_sec double, end_sec double")
    n = int(at * 100) + 90
    lengths = spark.createDataFrame([("a", n / 100.0), ("still", 3.0), ("none", 0.0)], "series_id string, duration_sec double")
    pieces = G._gain_pieces(phrases, lengths, 100, -15.0, 1.5, 1.5, 600.0, 700.0, 1500.0).collect()
    got = G.script_gain(phrases, lengths, 100, smooth_hz=0).orderBy("pos").collect()
    assert [x.gain_db for x in got if x.series_id == "still"] == [0.0] * 300
    assert np.allclose([x.gain_db for x in got if x.series_id == "a"], [shown(pieces, row) for row in range(n)], atol=1e-9)
    assert {p["kind"] for p in pieces} == {"lift", "fall", "hold", "rise"}


def test_phrases_and_gain(spark):
    env = spark.createDataFrame([("a", i, 0.5 if 200 <= i < 500 or 1100 <= i < 1400 else 1e-6) for i in range(1600)], "series_id string, pos long, env double")
    phrases = G.detect_phrases(env, 100)
    assert rows(phrases.select("start_sec", "end_sec"), "start_sec") == [(2.0, 5.0), (11.0, 14.0)]
    lengths = spark.createDataFrame([("a", 16.0)], "series_id string, duration_sec double")
    g = np.array([r.gain_db for r in G.script_gain(phrases, lengths, 100).orderBy("pos").collect()])
    assert len(g) == 1600 and np.allclose(g[220:480], -15, atol=0.2) and np.allclose(g[1120:1380], -15, atol=0.2) and abs(g[800] - 1.5) < 0.1 and g[100] <= 1.6
    held = G.duck_hold(*(spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "pos long, value double") for x in ([0.5] * 100 + [0.0] * 50 + [0.5] * 100, [1.0] * 250)), 100, release_ms=10.0, attack_ms=10.0)
    bed = np.array([r.value for r in held.orderBy("pos").collect()])
    assert bed[90] < 0.95 and bed[125] < 0.95


def test_gains_move_ahead_of_the_voice(spark):
    voice = spark.createDataFrame([(i, 0.5 if i >= 100 else 0.0) for i in range(200)], "pos long, value double")
    music = spark.createDataFrame([(i, 1.0) for i in range(200)], "pos long, value double")
    bed = np.array([r.value for r in G.duck_lookahead(voice, music, 100, lookahead_ms=200.0).orderBy("pos").collect()])
    assert bed[50] == 1.0 and bed[95] < 1.0 and bed[170] < 0.6


def test_fit_modes(spark):
    jobs = spark.createDataFrame([(1, 48, 48, 24), (2, 120, 72, 24), (3, 31200, 120000, 24000), (4, 48, 1200, 24000)], "job_id long, n_source long, n_target long, rate_hz long")
    assert [r[1] for r in rows(A.fit_report(jobs).select("job_id", "mode"), "job_id")] == ["used_as_is", "trimmed", "looped", "tiled_no_xfade"]
    source = spark.createDataFrame([(i, 1.0) for i in range(100)], "pos long, value double")
    out = A.fit_length(source, 330, 1000, 20.0).orderBy("pos").collect()
    assert len(out) == 330 and all(0.99 <= r.value <= 1.4143 for r in out) and out[90].value > 1.2


def test_crossfade_length_and_mix(spark):
    chunks = spark.createDataFrame([(s, 0, i, 1.0) for s in "ab" for i in range(2400)] + [(s, 1, i, 0.5) for s in "ab" for i in range(2400)], "series_id string, chunk_no long, pos long, value double")
    assert A.crossfade_concat(chunks, 100).count() == 2 * 4700
    out = A.crossfade_concat(chunks, 100).filter("series_id = 'a'").orderBy("pos").collect()
    assert len(out) == 4700 and out[0].value == 1.0 and out[-1].value == 0.5 and 0.5 < out[2350].value < 1.0
    tone = [(i, math.sin(i / 3)) for i in range(3000)]
    mixed = A.mix(spark.createDataFrame(tone, "pos long, value double"), spark.createDataFrame([(i, 0.5) for i in range(9000)], "pos long, value double"), 100)
    assert mixed.count() == 3000 + 2300


def test_loudness(spark):
    t = np.arange(48000) / 48000.0
    got = L.gated_loudness(series(spark, ("sine", np.sin(2 * np.pi * 997 * t))), 48000.0).first()
    assert abs(got.lufs + 3.01) < 0.05  # a full-scale sine near 1 kHz
    assert L.gated_loudness(series(spark, ("short", [0.1] * 10)), 100.0, weighted=False).first().gain == 1.0


def test_spectrum_finds_a_tone(spark):
    x = np.sin(2 * np.pi * 10 * np.arange(640) / 100.0)
    top = Q.dft_frames(series(spark, ("a", x)), 100.0, 100).groupBy("hz").agg(F.avg("power").alias("p")).orderBy(F.col("p").desc()).first()
    assert top.hz == 10.0
    report = Q.qa_report(Q.metrics(series(spark, ("a", x)), 100.0, 64, weighted=False), "true")
    assert report.count() == 11 and report.filter("check = 'flatness'").first().passed
    assert 0 <= Q.composite_score(Q.metrics(series(spark, ("a", x)), 100.0, 64, weighted=False)).first().score <= 1


def test_best_candidate(spark):
    a = spark.createDataFrame([(1, 1, True, 0.5), (1, 2, True, 0.9), (1, 3, True, 0.95), (2, 1, False, 0.9), (2, 2, True, 0.3), (2, 3, True, 0.3)], "job_id long, attempt long, valid boolean, score double")
    assert rows(Q.best_candidate(a), "job_id") == [(1, 2, 0.9), (2, 2, 0.3)]


def test_vectors(spark):
    e = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 0.0])], "vec_id long, embedding array<float>")
    b = spark.createDataFrame([("x", 0, 1, 0.5), ("x", 1, 2, 0.5), ("y", 0, 1, 0.5), ("y", 1, 3, 0.5)], "blend string, ordinal int, vec_id long, weight double")
    got = {r.blend: r.vector for r in V.slerp_blend(b, e).collect()}
    assert np.allclose(got["x"], [math.sqrt(0.5)] * 2) and np.allclose(got["y"], [1, 0])
    assert {r.blend: r.vector for r in V.blend_vectors(b, e).collect()}["x"] == [0.5, 0.5]
    scaled = {r.blend: r.vector for r in V.extrapolate_blend(b, e).collect()}["x"]
    assert np.isclose(np.linalg.norm(scaled), 1.0)
    one, two = (sorted(map(tuple, ((r.vec_id, *r.embedding) for r in V.jitter_vectors(e).collect()))) for _ in range(2))
    assert one == two and all(abs(r[1] - w) < 0.01 for r, w in zip(one, (1.0, 0.0, 1.0)))


def test_catalogue(spark):
    got = of(spark, C.asset_label, "light_music-healing-forest-187590", "solo", "a-12", "x_y")
    assert got == ["Healing Forest", "Solo", "A 12", "X Y"]
    assert of(spark, lambda t: C.minutes_label(t.cast("double")), "1152.0", "59.6") == ["19:12", "1:00"]
    p = spark.createDataFrame([(1, "soft piano: 1.5, warm pads, x: y, a: b: 2,, Ambient")], "prompt_id long, text string")
    assert [(r.term, r.weight) for r in P.parse_weighted_prompts(p).orderBy("ordinal").collect()] == [("soft piano", 1.5), ("warm pads", 1.0), ("x", 1.0), ("a: b", 2.0), ("Ambient", 1.0)]
    assert P.merge_base_tags(p).filter("term = 'Ambient'").count() == 1


def test_blocks_and_sinks(spark, tmp_path):
    pcm = np.array([16384, 0, -32768, -32768, 5], "<i2").tobytes()
    got = assets.pcm_block_ingest(spark.createDataFrame([(1, bytearray(pcm)), (2, bytearray(b""))], "block_id long, pcm binary"))
    assert rows(got.filter("block_id = 1").select("pos", "value"), "pos") == [(0, 0.25), (1, -1.0)] and got.filter("block_id = 2").count() == 48000
    s = series(spark, ("a", range(50)))
    assets.write_chunks(s, str(tmp_path / "c"), 1)
    back = spark.read.parquet(str(tmp_path / "c"))
    assert back.count() == 50 and back.select("chunk_id").distinct().count() == 3
    assets.write_stems(s.select(F.lit(1).alias("job_id"), F.lit("voice").alias("stem"), "pos", "value"), str(tmp_path / "s"))
    assert (tmp_path / "s" / "job_id=1" / "stem=voice").is_dir()
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "one.txt").write_text("a\nb")
    assert assets.scan_scripts(spark, str(tmp_path / "t")).first().text == "a\nb"
    assert assets.list_assets(spark, str(tmp_path / "none")).count() == 0
    (tmp_path / "t" / "x.WAV").write_bytes(b"12")
    assert [r.stem for r in assets.list_assets(spark, str(tmp_path / "t")).collect()] == ["x"]
