"""Blends of vectors: blends(blend, ordinal, vec_id, weight), embeddings(vec_id, embedding)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import NEAR


def _long(blends: DataFrame, embeddings: DataFrame) -> DataFrame:
    rows = blends.join(embeddings.select("vec_id", "embedding"), "vec_id")
    return rows.select("blend", "ordinal", "weight", F.posexplode("embedding").alias("dim", "x"))


def _gather(rows: DataFrame) -> DataFrame:
    return rows.groupBy("blend").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "x"))), lambda p: p["x"]).alias("vector"))


def blend_vectors(blends: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Weighted sum per blend."""
    rows = _long(blends, embeddings).groupBy("blend", "dim").agg(F.sum(F.col("weight") * F.col("x").cast("double")).alias("x"))
    return _gather(rows)


def extrapolate_blend(blends: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Weighted sum, negative weights allowed, scaled to the length of the blend's first vector."""
    rows = _long(blends, embeddings)
    first = Window.partitionBy("blend")
    rows = rows.withColumn("x", F.col("x").cast("double")).withColumn("top", F.min("ordinal").over(first))
    sums = rows.groupBy("blend", "dim").agg(F.sum(F.col("weight") * F.col("x")).alias("x"), F.sum(F.when(F.col("ordinal") == F.col("top"), F.col("x") * F.col("x"))).alias("own"))
    norms = sums.groupBy("blend").agg(F.sqrt(F.sum("own")).alias("primary"), F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("now"))
    scale = F.when((F.col("primary") > NEAR) & (F.col("now") > NEAR), F.col("primary") / F.col("now")).otherwise(1.0)
    return _gather(sums.join(norms, "blend").select("blend", "dim", (F.col("x") * scale).alias("x")))


def slerp_blend(blends: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Weights scaled to 1, then pair by pair in order with t = w / (sum so far + w); many blends go through one task's arrays."""
    rows = blends.join(embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")), "vec_id")
    items = rows.groupBy("blend").agg(F.array_sort(F.collect_list(F.struct("ordinal", "weight", "embedding"))).alias("items"))

    def run(batches):
        for p in batches:
            out = []
            for items_ in p["items"]:
                v, so_far = np.asarray(items_[0]["embedding"]), items_[0]["weight"]
                for item in items_[1:]:
                    w, o = item["weight"], np.asarray(item["embedding"])
                    t = w / (so_far + w)
                    omega = np.arccos(np.clip(v @ o / (np.linalg.norm(v) * np.linalg.norm(o)), -1, 1))
                    s = np.sin(omega)
                    v = (1 - t) * v + t * o if abs(s) < NEAR else np.sin((1 - t) * omega) / s * v + np.sin(t * omega) / s * o
                    so_far += w
                out.append(v)
            yield pd.DataFrame({"blend": p.blend, "vector": out})

    return items.select("blend", "items").mapInPandas(run, "blend string, vector array<double>")


def jitter_vectors(embeddings: DataFrame, amount: float = 0.001, seed: int = 42) -> DataFrame:
    """Seeded normal noise on every component; rows are numbered first, so a rerun gives the same."""
    rows = embeddings.select("vec_id", F.posexplode("embedding").alias("dim", "x"))
    # two uniform hashes of (seed, vec_id, dim) make one normal value
    uniform = lambda k: (F.pmod(F.xxhash64(F.lit(seed + k), "vec_id", "dim"), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    noise = F.sqrt(-2 * F.ln(uniform(0))) * F.cos(2 * np.pi * uniform(1))
    rows = rows.withColumn("x", F.col("x").cast("double") + F.lit(amount) * noise)
    return rows.groupBy("vec_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "x"))), lambda p: p["x"]).alias("embedding"))


def resolve_spec(specs: DataFrame, presets: DataFrame) -> DataFrame:
    """specs(spec), presets(preset, ordinal, id, weight, method): a row per (spec, id, weight, method).

    A spec is a preset's name, a comma list with equal weights, or one id.
    """
    named = specs.join(presets, F.col("spec") == F.col("preset")).select("spec", "ordinal", "id", "weight", "method")
    others = specs.join(presets.select("preset").distinct(), F.col("spec") == F.col("preset"), "left_anti")
    ids = F.split("spec", ",")
    listed = others.select("spec", F.size(ids).alias("n"), F.posexplode(ids).alias("ordinal", "id"))
    listed = listed.select("spec", "ordinal", F.trim("id").alias("id"), (1.0 / F.col("n")).alias("weight"), F.when(F.col("n") > 1, "slerp").otherwise("single").alias("method"))
    return named.unionByName(listed)


def any_member(resolved: DataFrame, members: DataFrame) -> DataFrame:
    """(spec, member): whether any id of the spec is among members(id)."""
    rows = resolved.join(members.select("id").distinct().withColumn("m", F.lit(True)), "id", "left")
    return rows.groupBy("spec").agg(F.coalesce(F.max("m"), F.lit(False)).alias("member"))
