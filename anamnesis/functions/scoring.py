"""Decay, activation, importance and distance as Column expressions. Times are seconds; now is an argument."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Constants of the forgetting curve: retention is 0.9 after one stability period.
FORGETTING_FACTOR, FORGETTING_POWER = 19.0 / 81.0, -0.5


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def half_life(weight: Column, age: Column, half_life_secs: float) -> Column:
    return weight * F.exp(age * F.lit(-math.log(2) / half_life_secs))


def power_law(age: Column, stability_days: Column) -> Column:
    kept = F.pow(F.lit(1.0) + F.lit(FORGETTING_FACTOR) * age / 86400.0 / F.nullif(stability_days, F.lit(0.0)), F.lit(FORGETTING_POWER))
    return F.when(stability_days <= 0, 0.0).otherwise(clamp(kept, 0.0, 1.0))


def exponential(age: Column, half_life_days: Column) -> Column:
    return F.exp(-F.lit(math.log(2)) * age / 86400.0 / half_life_days)


def activation(count: Column, lifetime: Column, since_echo: Column, d: Column) -> Column:
    """Base-level activation from the number of retrievals, within [-6, 4]."""
    life, since = F.greatest(lifetime, F.lit(1.0)), F.greatest(since_echo, F.lit(1.0))
    base = F.ln((count + 1.0) / ((1.0 - d) * F.pow(life, 1.0 - d)))
    return clamp(base + F.coalesce(-d * F.ln(since), F.lit(0.0)) * 0.3, -6.0, 4.0)


def velocity(count: Column, age: Column) -> Column:
    rate = count / (F.greatest(age, F.lit(1.0)) / 86400.0)
    return F.lit(2.0) / (F.lit(1.0) + F.exp(-rate)) - 1.0


def importance(novelty: Column, category_weight: Column, veloc: Column, source: Column, surprise: Column | None = None) -> Column:
    if surprise is None:
        return clamp(0.41 * novelty + 0.29 * category_weight + 0.24 * veloc + 0.06 * source, 0.0, 1.0)
    return clamp(0.35 * novelty + 0.25 * category_weight + 0.20 * veloc + 0.15 * surprise + 0.05 * source, 0.0, 1.0)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    """0 for a zero vector."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.coalesce(dot(a, b) / F.nullif(norms, F.lit(0.0)), F.lit(0.0))


def surprise(v: Column, mean: Column) -> Column:
    away = F.sqrt(F.aggregate(F.zip_with(v, mean, lambda x, y: F.pow(x.cast("double") - y, F.lit(2.0))), F.lit(0.0), lambda s, x: s + x))
    return F.when((F.size(v) != F.size(mean)) | (F.size(v) == 0), 0.0).otherwise(F.least(away / 2.0, F.lit(1.0)))


def l2_normalize(v: Column) -> Column:
    norm = F.sqrt(dot(v, v))
    return F.when(norm <= 1e-10, F.transform(v, lambda x: x.cast("double"))).otherwise(F.transform(v, lambda x: x.cast("double") / norm))
