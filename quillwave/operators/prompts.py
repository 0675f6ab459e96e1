"""Prompt tables: weighted terms, base tags, captions, section lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values.
BASE_TAGS, BASE_WEIGHT = ["Ambient", "Ethereal Ambience", "Minimalist Drone", "Deep Soundscape", "Static Texture", "Low-Frequency Wash"], 0.6
CAPTION_TAGS = [
    "ambient", "meditation", "calm", "peaceful", "warm", "spacious", "soft dynamics", "gentle", "soothing", "smooth texture", "slow tempo", "drone pads",
    "harmonic layers", "ethereal", "no percussion", "no drums", "no beat", "slow harmonic evolution", "sustained pads", "sine wave layers", "breathing space",
    "no lead instrument", "high fidelity", "deep warmth", "Tuned to 432 Hz for natural resonance",
]
SUFFIX = "no vocals, instrumental"
SHORT = ["Instrumental", "Intro", "Instrumental", "Outro"]
MEDIUM = ["Instrumental", "Intro", "Verse", "Instrumental", "Chorus", "Instrumental", "Outro"]
LONG = ["Instrumental", "Intro", "Verse", "Instrumental", "Chorus", "Bridge", "Instrumental", "Verse", "Chorus", "Outro"]


def parse_weighted_prompts(prompts: DataFrame) -> DataFrame:
    """prompts(prompt_id, text): `A: 1.5, B` to (A, 1.5), (B, 1.0); a weight that is no number is 1.0, blank parts go."""
    parts = F.filter(F.transform(F.split("text", ","), lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")), lambda p: p != "")
    rows = prompts.select("prompt_id", F.posexplode(parts).alias("ordinal", "part"))
    has = F.col("part").contains(":")
    name, weight = F.regexp_extract("part", r"(?s)^(.*):(.*)$", 1), F.regexp_extract("part", r"(?s)^(.*):(.*)$", 2)
    number = F.when(F.trim(weight).rlike(r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"), F.trim(weight).try_cast("double"))
    return rows.select("prompt_id", "ordinal", F.when(has, F.trim(name)).otherwise(F.col("part")).alias("term"), F.when(has, F.coalesce(number, F.lit(1.0))).otherwise(1.0).alias("weight"))


def merge_base_tags(prompts: DataFrame) -> DataFrame:
    """The base tags that the prompt does not name, at 0.6, then the prompt's own terms, in order."""
    tags = F.filter(F.array(*map(F.lit, BASE_TAGS)), lambda t: ~F.contains(F.lower("text"), F.lower(t)))
    base = prompts.select("prompt_id", F.posexplode(tags).alias("ordinal", "term")).withColumn("weight", F.lit(BASE_WEIGHT))
    return base.unionByName(parse_weighted_prompts(prompts).withColumn("ordinal", F.col("ordinal") + len(BASE_TAGS)))


def build_caption(text: Column) -> Column:
    """Base tags of which no word over three letters occurs in the prompt, the prompt, and the suffix unless it is said."""
    own = F.regexp_replace(text, r"^\s+|(?<!\s)\s++$", "")
    words = F.array(*[F.struct(F.lit(t).alias("tag"), F.array(*[F.lit(w) for w in t.split() if len(w) > 3] or [F.lit("\u0000")]).alias("words")) for t in CAPTION_TAGS])

    def made(p: Column) -> Column:
        """`p`: the prompt as it is and in lower case, worked out once; a tag's test reads it some forty times."""
        low = p["low"]
        kept = F.transform(F.filter(words, lambda t: ~F.exists(t["words"], lambda w: F.contains(low, w))), lambda t: t["tag"])
        end = F.when(F.contains(low, F.lit("no vocal")) | F.contains(low, F.lit("instrumental")), F.array().cast("array<string>")).otherwise(F.array(F.lit(SUFFIX)))
        return F.array_join(F.filter(F.concat(kept, F.array(p["own"]), end), lambda x: x != ""), ", ")

    told = F.transform(F.array(own), lambda o: F.struct(o.alias("own"), F.lower(o).alias("low")))
    return F.regexp_replace(F.get(F.transform(told, made), F.lit(0)), r"^\s+|\s*,*$", "")


def section_template(jobs: DataFrame, seconds: str = "duration_sec") -> DataFrame:
    """jobs(job_id, seconds): the sections in order; lists for up to 90 s, up to 300 s, longer."""
    array = lambda names: F.array(*map(F.lit, names))
    sections = F.when(F.col(seconds) <= 90.0, array(SHORT)).when(F.col(seconds) <= 300.0, array(MEDIUM)).otherwise(array(LONG))
    return jobs.select("job_id", F.posexplode(sections).alias("ordinal", "section"))
