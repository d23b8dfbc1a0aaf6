"""Scalar expressions of memory decay, metrics and identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The least positive normal double: a decayed weight never reaches zero.
TINY = 2.2250738585072014e-308
DECAY_RATE = 0.01


def age_days(now: Column, then: Column) -> Column:
    """Days with fractions between two timestamps."""
    return (F.unix_micros(now) - F.unix_micros(then)) / F.lit(86_400_000_000.0)


def decay(age: Column, rate: float | Column = DECAY_RATE) -> Column:
    """exp(-rate * age), floored at TINY; a null rate means no decay."""
    rate = rate if isinstance(rate, Column) else F.lit(rate)
    return F.when(rate.isNull(), F.lit(1.0)).otherwise(F.greatest(F.exp(-rate * age), F.lit(TINY)))


def unit_clip(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def reciprocal_rank(rank: Column) -> Column:
    """1 / rank; 0 for null, which stands for no hit."""
    return F.coalesce(F.lit(1.0) / rank, F.lit(0.0))


def log2_gain(rank: Column) -> Column:
    return F.lit(1.0) / F.log2(rank + F.lit(1.0))


def memory_id(event_id: Column) -> Column:
    return F.concat(F.lit("memory::"), event_id)


def observed_id(latent_id: Column, tier: Column) -> Column:
    return F.concat_ws("::", latent_id, tier)


def latent_id(event_id: Column) -> Column:
    return F.concat(F.lit("latent-"), event_id)


def contrast_name(lower: Column, higher: Column) -> Column:
    return F.concat(lower, F.lit("_minus_"), higher)


def hash_order(seed: int, *keys: Column) -> Column:
    """A sort key that looks random and depends on the seed and the keys alone."""
    return F.sha2(F.concat_ws(":", F.lit(str(seed)), *(k.cast("string") for k in keys)), 256)


def missing_names(fields: dict[str, Column]) -> Column:
    """Names of the null fields in the given order, joined by a comma and a space."""
    return F.concat_ws(", ", F.array_compact(F.array(*(F.when(c.isNull(), F.lit(n)) for n, c in fields.items()))))
