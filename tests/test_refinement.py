"""Quantiles, runs and text rules against plain Python, with blocks and limits so small that every level is used."""

import random
import re
import time

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quillwave.functions import quantiles, runs
from quillwave.functions import rules as R
from quillwave.functions import text as X
from quillwave.plans import texts as texts_plan


def groups():
    r = np.random.default_rng(5)
    return {
        "normal": r.normal(0, 1, 3000), "ties": r.integers(0, 3, 2000).astype(float), "one": np.array([7.5]), "two": np.array([-1e300, 1e300]), "wide": np.exp(r.normal(0, 200, 1500)) * r.choice([-1, 1], 1500),
        "tight": 1 + r.integers(0, 50, 2000) * 2.0**-52, "zeros": np.zeros(100), "tiny": r.normal(0, 1e-300, 300), None: r.normal(5, 1, 40),
    }


@pytest.mark.parametrize("ranked", [3, 10_000])
def test_quantiles_are_exact(spark, monkeypatch, ranked):
    monkeypatch.setattr(quantiles, "CELLS", 64)
    rows = [(k, float(v)) for k, values in groups().items() for v in values] + [("normal", None), ("ties", float("nan")), ("empty", None)]
    df = spark.createDataFrame(rows, "k string, x double").repartition(4)
    for share in (0.0, 0.5, 0.99, 1.0):
        got = {r["k"]: r["x"] for r in quantiles.exact_quantile(df, "k", "x", share, ranked).collect()}
        assert set(got) == set(groups())
        for k, values in groups().items():
            s = np.sort(values)
            place = share * (len(s) - 1)
            low, high = s[int(place)], s[min(len(s) - 1, int(place) + 1)]
            assert got[k] == pytest.approx(low if place == int(place) else low * (1 - place % 1) + high * (place % 1), rel=1e-12, abs=0)


def test_quantiles_of_nothing(spark):
    assert quantiles.exact_quantile(spark.createDataFrame([], "k string, x double"), "k", "x", 0.5).count() == 0


@pytest.mark.parametrize("block", [2, 3, 16, 10_000])
@pytest.mark.parametrize("gap", [0, 1, 4])
def test_runs_over_many_blocks(spark, block, gap):
    r = random.Random(block * 10 + gap)
    at = {"long": list(range(5, 400)), "odd": list(range(1, 300, 2)), "some": sorted(r.sample(range(500), 200)), "edge": [15, 16, 31, 32, 47, 48], "one": [0], None: [3, 4]}
    want = set()
    for k, places in at.items():
        a = b = places[0]
        for p in [*places[1:], None]:
            if p is None or p - b - 1 > gap:
                want.add((k, a, b))
                a = p
            b = p
    rows = [(k, p) for k, places in at.items() for p in places]
    r.shuffle(rows)
    df = spark.createDataFrame(rows + rows[:20], "k string, pos long").repartition(3)
    found = [tuple(x) for x in runs.merged_runs(df, "k", "pos", gap, block).collect()]
    assert set(found) == want and len(found) == len(want)


def test_runs_of_nothing(spark):
    assert runs.merged_runs(spark.createDataFrame([], "k string, pos long"), "k", "pos").count() == 0


# text rules


def varied(text):
    """The first comma before a listed conjunction, looked for place by place."""
    for i in range(1, len(text)):
        m = re.match(rf", ({'|'.join(R.VARIED_CONJUNCTIONS)}) \w", text[i:])
        if m and text[i - 1] != "\n":
            words = re.split(r"[.!?\n]", text[:i])[-1].split()
            return f"{text[:i]}. {m[1].capitalize()}{text[i + 2 + len(m[1]) :]}" if len(words) >= R.VARIED_WORDS else text
    return text


def claused(text):
    """From each letter on to the next conjunction of the same clause, one after the other."""
    out, at = "", 0
    while at < len(text):
        stop = next((j for j in range(at, len(text)) if text[j] in ",.\n"), len(text)) if text[at].isascii() and text[at].isalpha() else at
        joint = next((j for j in range(at + 2, stop) if re.match(rf" ({'|'.join(R.CLAUSE_CONJUNCTIONS)}) [a-z]", text[j:])), None)
        if joint is None:
            out, at = out + text[at], at + 1
            continue
        m = re.match(r" (\w+) .", text[joint:])
        words = re.split("[!?]", text[at:joint])[-1].split()
        out += text[at:joint] + ("," if len(words) >= R.CLAUSE_WORDS else "") + m[0]
        at = joint + len(m[0])
    return out


def breathed(text):
    words, out = 0, ""
    for token in re.findall(r"\s+|\S+", text):
        if re.search(r"[,.!?\n]", token):
            words = 0
        elif re.fullmatch(r"\w[\w'-]*", token):
            if words >= R.BREATH_WORDS and token.lower() in R.BREATH_CONJUNCTIONS:
                out, words = out + ", ", 0
            words += 1
        out += token
    return out


def samples():
    r = random.Random(9)
    tokens = ["word", "x", "and", "And", "but", "while", "as", "letting", "or", ",", ".", "!", "\n", "  ", "étude", "don't", "-dash", "_u", "[calm](+1)", "you", " ", "3"]
    weights = [30, 8, 12, 2, 5, 4, 5, 3, 3, 3, 1, 1, 1, 2, 3, 2, 1, 1, 1, 3, 1, 1]
    return ["", None, "a", ", and x", "\n, and b, and c"] + ["".join(t if t in ",.!\n" and r.random() < 0.5 else " " + t for t in r.choices(tokens, weights, k=r.randint(1, 80)))[r.randint(0, 1) :] for _ in range(400)]


@pytest.mark.parametrize("rule, plain", [(X.vary_sentence_length, varied), (X.break_long_clauses, claused), (X.break_breath_groups, breathed)])
def test_rules_equal_slow_ones(spark, rule, plain):
    df = spark.createDataFrame([(t,) for t in samples()], "t string").repartition(4)
    got = {r["t"]: r["new"] for r in df.select("t", rule(F.col("t")).alias("new")).collect()}
    assert [(t, got[t]) for t in samples() if got[t] != (None if t is None else plain(t))] == []


def test_sql_of_clauses_sees_each_of_a_run_of_conjunctions():
    texts = ["! and and but b c d e f g h andy but and and x", ", and and but but b c d e f g h and k", "\n and and but b c d e f g h and andy", "one two three four five six seven eight and and and and x"]
    db = duckdb.connect()
    db.execute("CREATE TABLE documents AS SELECT unnest(range(0, len(t))) AS doc_id, unnest(t) AS text FROM (SELECT ?::VARCHAR[] AS t)", [texts])
    told = dict(db.execute(texts_plan.QUERIES["break_long_clauses"][1].replace(texts_plan.DOCS, "WITH docs AS (SELECT * FROM documents)")).fetchall())
    assert told == {i: claused(t) for i, t in enumerate(texts)}


def test_rules_are_linear(spark):
    """Texts of 200,000 characters that hold no boundary, only conjunctions, only spaces or only commas."""
    long = ["word stream " * 17_000, "a and b " * 25_000, " " * 200_000, "x, " * 66_000, "and " * 50_000, "1-2" * 60_000]
    df = spark.createDataFrame([(t,) for t in long], "t string").repartition(6).cache()
    df.select(X.preprocess_text(F.col("t")).alias("x")).write.format("noop").mode("overwrite").save()
    began = time.time()
    df.select(X.preprocess_text(F.col("t")).alias("x")).write.format("noop").mode("overwrite").save()
    assert time.time() - began < 60  # minutes and more with a rule that is quadratic


def test_word_rules_equal_column_patterns(spark):
    """The word rules in Arrow batches against one column pattern each, on letters that fold, marks, digits and signs beyond ASCII."""
    r = random.Random(5)
    tokens = ["sec", "ſec", "MIN", "mİn", "mın", "i.e", "iXe", "kHz", "Khz", "om", "chakras", "you are", "YOU ARE", "cannot", "stress", "[calm", "calm", "ſtill", "the", "a", "your", "warmth", "glow", "é", "́", "𝐀", "𝟎", "Ⓐ", "‍", "_", "5", "-", ",", "—", " ", "  ", " ", "\x1c", "\n", "."]
    texts = [""] + ["".join(t if r.random() < 0.4 else t + " " for t in r.choices(tokens, k=r.randint(1, 30))) for _ in range(1_500)]
    df = spark.createDataFrame([(t,) for t in [*texts, None]], "t string").repartition(3)
    words = lambda pairs: lambda t: X._each_match(t, rf"(?iU)\b(?:{'|'.join(w for w, _ in pairs)})\b(?-iU)", lambda m: F.coalesce(F.element_at(F.create_map(*[F.lit(x) for w, new in pairs for x in (w.replace("\\.", ".").lower(), new)]), F.lower(m)), m))
    tags = lambda t: X._fold(t, [(rf"(?iU)(?<!\[)\b({'|'.join(w)})\b", f"[$1]({n})") for w, n in ((R.LESS_STRESS, "-1"), (R.MORE_STRESS, "+1"))])
    dots = lambda t: F.regexp_replace(t, rf"(?iU)(?<![,.!?—])\b({'|'.join(R.DETERMINERS)})\s+({'|'.join(sorted(R.SENSORY))})\b", "$1... $2")
    sounds = [(w, f"[{w}](/{s}/)") for w, s in R.SOUNDS]
    rules = [(X.expand_abbreviations, words(R.ABBREVIATIONS)), (X.contract_phrases, words(R.CONTRACTIONS)), (X.mark_sounds, words(sounds)), (X.tag_stress_words, tags), (X.sensory_ellipsis, dots)]
    t = F.col("t")
    got = df.select("t", *[F.struct(new(t).alias("new"), old(t).alias("old")).alias(new.__name__) for new, old in rules]).collect()
    assert [(new.__name__, row["t"], row[new.__name__]) for row in got for new, _ in rules if row[new.__name__]["new"] != row[new.__name__]["old"]] == []
    assert all(any(row[new.__name__]["new"] != row["t"] for row in got) for new, _ in rules)
