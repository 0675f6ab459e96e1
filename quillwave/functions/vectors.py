"""Arithmetic on vector columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NEAR = 1e-6


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def slerp(a: Column, b: Column, t: Column) -> Column:
    """Along the great circle from a (t = 0) to b (t = 1), lengths kept; nearly parallel vectors are mixed linearly."""
    cos = F.greatest(F.least(dot(a, b) / (norm(a) * norm(b)), F.lit(1.0)), F.lit(-1.0))
    omega = F.acos(cos)
    flat = F.abs(F.sin(omega)) < NEAR
    wa = F.when(flat, 1.0 - t).otherwise(F.sin((1.0 - t) * omega) / F.sin(omega))
    wb = F.when(flat, t).otherwise(F.sin(t * omega) / F.sin(omega))
    # the weights are put into the array's elements, so they are computed once per vector
    pair = F.array(F.struct(a.cast("array<double>").alias("v"), wa.alias("w")), F.struct(b.cast("array<double>").alias("v"), wb.alias("w")))
    scaled = F.transform(pair, lambda p: F.transform(p["v"], lambda x: x * p["w"]))
    return F.zip_with(F.get(scaled, 0), F.get(scaled, 1), lambda x, y: x + y)
