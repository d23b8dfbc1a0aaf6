"""Group-held-out split plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sextant.functions import scalars as S
from sextant.operators.ranks import numbered
from sextant.sources.scratch import keep


def held_out_count(n: Column, fraction: float) -> Column:
    """round(n * fraction), halves to even, kept in 1 to n - 1."""
    return F.greatest(F.lit(1), F.least(n - 1, F.bround(n * F.lit(fraction)).cast("long")))


def check_fractions(*fractions: float) -> None:
    if any(not 0 < f < 1 for f in fractions) or sum(fractions) >= 1:
        raise ValueError(f"fractions {fractions} lie in (0, 1) and sum to less than 1")


def pools(groups: DataFrame, group: str, seed: int, cuts: list[tuple[str, float]], rest: str) -> DataFrame:
    """(group, pool): the distinct groups in hash order; each cut takes its share of all groups.

    Groups are numbered by ranges with offsets, not in one task.
    """
    check_fractions(*(f for _, f in cuts))
    place = keep(numbered(groups.select(group).distinct(), [], [S.hash_order(seed, F.col(group)), group], name="_k"), "group_places")
    place = place.withColumn("_n", F.lit(place.count()).cast("long"))
    pool, start = None, F.lit(0).cast("long")
    for name, fraction in cuts:
        stop = start + held_out_count(F.col("_n"), fraction)
        test = (F.col("_k") > start) & (F.col("_k") <= stop)
        pool = F.when(test, name) if pool is None else pool.when(test, name)
        start = stop
    return place.select(group, pool.otherwise(rest).alias("pool"))


def family_pools(families: DataFrame, seed: int, ood: float = 0.30) -> DataFrame:
    return pools(families, "family_id", seed, [("ood", ood)], "development")


def template_pools(templates: DataFrame, seed: int, ood: float = 0.20, validation: float = 0.10) -> DataFrame:
    return pools(templates, "template_id", seed, [("ood_test", ood), ("validation", validation)], "train")


def assign(events: DataFrame, families: DataFrame, templates: DataFrame) -> DataFrame:
    """Events with the split that their family's and template's pools allow, null for other pairs."""
    f = families.select(F.col("family_id").alias("target_family_id"), F.col("pool").alias("_f"))
    t = templates.select("template_id", F.col("pool").alias("_t"))
    split = F.when((F.col("_f") == "ood") & (F.col("_t") == "ood_test"), "ood_test").when((F.col("_f") == "development") & (F.col("_t") != "ood_test"), F.col("_t"))
    return events.join(f, "target_family_id", "left").join(t, "template_id", "left").withColumn("split", split).drop("_f", "_t")


def split_sizes(n: Column, validation: float, test: float) -> dict[str, Column]:
    """Sizes from fractions: validation and test are rounded half to even, train is the rest."""
    v, t = F.bround(n * F.lit(validation)).cast("long"), F.bround(n * F.lit(test)).cast("long")
    return {"train": n - v - t, "validation": v, "ood_test": t}
