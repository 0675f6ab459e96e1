"""Catalogue queries: pairs, defaults, missing entries, labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pair_assets(audio: DataFrame, transcripts: DataFrame) -> DataFrame:
    """audio(stem, path) with a transcript(stem, text) of the same stem that is not empty."""
    return audio.join(transcripts.filter(F.length("text") > 0).select("stem", "text"), "stem")


def unpaired_assets(audio: DataFrame, transcripts: DataFrame) -> DataFrame:
    return audio.join(transcripts.filter(F.length("text") > 0).select("stem"), "stem", "left_anti")


def default_asset(assets: DataFrame, slug: str = "slug") -> DataFrame:
    """The first slug in order."""
    return assets.agg(F.min(slug).alias("slug"))


def missing_requests(requests: DataFrame, catalogue: DataFrame) -> DataFrame:
    """requests(slug) that catalogue(slug, kind) lacks, and, as one small row, how many entries there are and the first of them."""
    known = catalogue.agg(F.count(F.lit(1)).alias("n_available"), F.min("slug").alias("first_available"))
    return requests.join(catalogue.select("slug"), "slug", "left_anti").crossJoin(known)


def asset_label(stem: Column) -> Column:
    """Readable name: the first part (author) and a numeric last part dropped, words capitalised."""
    parts = F.filter(F.split(stem, "-"), lambda t: t != "")
    n = F.size(parts)
    core = F.when(n > 1, F.slice(parts, 2, F.greatest(n - 1, F.lit(0)))).otherwise(parts)
    last = F.when(F.size(core) > 0, F.element_at(core, -1))
    core = F.when(last.rlike("^[0-9]+$"), F.slice(core, 1, F.greatest(F.size(core) - 1, F.lit(0)))).otherwise(core)
    core = F.when(F.size(core) > 0, core).when(n > 0, parts).otherwise(F.array(stem))
    return F.initcap(F.trim(F.replace(F.array_join(core, " "), F.lit("_"), F.lit(" "))))


def minutes_label(seconds: Column) -> Column:
    """M:SS of rounded seconds, halves to the even one."""
    total = F.bround(seconds, 0).cast("long")
    return F.concat(F.floor(total / 60).cast("string"), F.lit(":"), F.lpad((total % 60).cast("string"), 2, "0"))


def sorted_catalogue(assets: DataFrame, label: str = "label") -> DataFrame:
    """By label without case; equal labels by what stands in the other columns."""
    return assets.orderBy(F.lower(label), *[c for c in assets.columns if c != label])
