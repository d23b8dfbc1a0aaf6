"""Row and table checks. Row checks return ``errors array<string>``; table checks return the
violating keys, so that a large table gives a small report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sextant.functions import vectors as V

SPLITS = ("train", "validation", "ood_test")


def _errors(tests: list[tuple[Column, str]]) -> Column:
    return F.array_compact(F.array(*(F.when(F.coalesce(bad, F.lit(True)), F.lit(name)) for bad, name in tests)))


def blank(c: Column) -> Column:
    return c.isNull() | (F.length(F.trim(c)) == 0)


def context_errors(*modalities: Column) -> Column:
    """A context has a modality, each one there is finite, and all have one dimension."""
    sizes = F.array_distinct(F.array_compact(F.array(*(F.when(m.isNotNull(), F.size(m)) for m in modalities))))
    return _errors([
        (F.size(sizes) == 0, "no modality"),
        (F.size(sizes) > 1, "dimensions differ"),
        (~F.forall(F.array_compact(F.array(*modalities)), V.is_finite), "not finite"),
    ])


def event_errors(event_id: Column, split: Column, template: Column, target: Column, family: Column) -> Column:
    return _errors([
        (blank(event_id), "blank event_id"),
        (~split.isin(*SPLITS), "unknown split"),
        (template < 0, "negative template"),
        (blank(target), "blank target"),
        (family < 0, "negative family"),
    ])


def memory_errors(memory_id: Column, item_id: Column, created: Column, updated: Column, strength: Column, corrections: Column) -> Column:
    return _errors([
        (blank(memory_id), "blank memory_id"),
        (blank(item_id), "blank item_id"),
        (updated < created, "updated before created"),
        (~((strength > 0) & (strength <= 1)) | F.isnan(strength), "strength outside (0, 1]"),
        (corrections < 0, "negative correction count"),
    ])


def request_errors(request_id: Column, item_id: Column, *numbers: Column) -> Column:
    """Ids are there; each number is null or finite and not negative."""
    bad = [x.isNotNull() & (F.isnan(x) | (x < 0) | (F.abs(x) == float("inf"))) for x in numbers]
    return _errors([(blank(request_id), "blank request_id"), (blank(item_id), "blank item_id"), *((F.coalesce(b, F.lit(False)), f"number {k + 1}") for k, b in enumerate(bad))])


def strict(checked: DataFrame, errors: str = "errors", show: int = 5) -> DataFrame:
    """The rows, if none has an error; else ValueError with a few of them."""
    bad = checked.where(F.size(errors) > 0).limit(show).collect()
    if bad:
        raise ValueError(f"rows with errors, for example {bad}")
    return checked.drop(errors)


def duplicates(table: DataFrame, *keys: str) -> DataFrame:
    """Keys that occur more than once, with their number of rows."""
    return table.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def unknown_targets(events: DataFrame, items: DataFrame) -> DataFrame:
    """(event_id, problem) of events whose target is unknown or of another family."""
    known = items.select(F.col("item_id").alias("target_item_id"), F.col("family_id").alias("item_family"))
    joined = events.join(known, "target_item_id", "left")
    problem = F.when(F.col("item_family").isNull(), "unknown target").when(F.col("item_family") != F.col("target_family_id"), "family differs")
    return joined.select("event_id", problem.alias("problem")).where("problem is not null")


def ranking_problems(rankings: DataFrame, relevance: DataFrame, k: int) -> DataFrame:
    """(query_id, problem) of rank lists that can't be evaluated."""
    if k < 1:
        raise ValueError("k is 1 at least")
    per = rankings.groupBy("query_id").agg(
        F.count("*").alias("n"), F.countDistinct("item_id").alias("items"), F.countDistinct("rank").alias("ranks"), F.min("rank").alias("low"), F.max("rank").alias("high"), F.count(F.when(blank(F.col("item_id")), 1)).alias("blank")
    )
    problem = F.array_compact(F.array(
        F.when(F.col("items") < F.col("n") - F.col("blank"), "duplicate item"),
        F.when((F.col("low") != 1) | (F.col("high") != F.col("n")) | (F.col("ranks") != F.col("n")), "ranks not consecutive"),
        F.when(F.col("n") > k, "longer than k"),
        F.when(F.col("blank") > 0, "blank item"),
    ))
    listed = per.select("query_id", F.explode(problem).alias("problem"))
    without = rankings.select("query_id").distinct().join(relevance, "query_id", "left_anti").select("query_id", F.lit("no relevant item").alias("problem"))
    unranked = relevance.select("query_id").distinct().join(rankings, "query_id", "left_anti").select("query_id", F.lit("empty ranking").alias("problem"))
    return listed.unionByName(without).unionByName(unranked)


def one_cell(table: DataFrame, **key: object) -> DataFrame:
    """The rows of one evaluation cell; KeyError when there is none."""
    cell = table.where(F.lit(True))
    for name, value in key.items():
        cell = cell.where(F.col(name) == F.lit(value))
    if cell.isEmpty():
        raise KeyError(f"no cell {key}")
    return cell
