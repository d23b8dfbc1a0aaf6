"""Leakage audit of a split dataset: violation tables, and a report in one row.

The tables and the lists of the report hold every violation. A badly broken dataset makes a huge
row; ``summary`` (counts alone) and ``pages`` (lists of bounded length) are the forms for one whose
ids don't fit into a row.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sextant.functions import vectors as V
from sextant.operators import ranks, validation
from sextant.sources.scratch import keep

SPLITS = validation.SPLITS


def split_counts(events: DataFrame, labels: tuple[str, ...] = SPLITS, column: str = "split") -> DataFrame:
    """(split, n) of each label, 0 for those without rows."""
    names = events.sparkSession.createDataFrame([(x,) for x in labels], f"{column} string")
    counts = events.where(F.col(column).isin(*labels)).groupBy(column).agg(F.count("*").alias("n"))  # a row a label at most
    return names.join(F.broadcast(counts), column, "left").select(column, F.coalesce("n", F.lit(0)).alias("n"))


def missing_splits(events: DataFrame) -> DataFrame:
    return split_counts(events).where("n = 0").select("split")


def feature_key(*vectors: str) -> Column:
    """Fingerprint of an event's features: template and vectors, no label."""
    return V.fingerprint(F.col("template_id"), *(F.col(v) for v in vectors))


def shared_features(events: DataFrame, vectors: tuple[str, ...] = ("text_vector", "image_vector", "audio_vector")) -> DataFrame:
    """(fingerprint, splits) of features that occur in several splits.

    64-bit hashes of the raw features are counted first, with their least and greatest split. Only rows whose hash
    several splits have are suspects: these alone are fingerprinted and confirmed, so what is
    shuffled beyond the hashes follows the suspects and not the events.
    """
    raw = events.select("template_id", *vectors, "split", F.xxhash64("template_id", *vectors).alias("h"))
    split = raw.groupBy("h").agg(F.min("split").alias("low"), F.max("split").alias("high")).where("low <> high").select("h")
    suspects = raw.join(keep(split, "suspected_features"), "h", "left_semi")
    keys = suspects.select(feature_key(*vectors).alias("fingerprint"), "split")
    return keys.groupBy("fingerprint").agg(F.countDistinct("split").alias("splits")).where("splits > 1")


def family_overlap(events: DataFrame) -> DataFrame:
    """Families of development events that out-of-distribution events have too."""
    held = F.col("split") == "ood_test"
    return events.where(~held).select("target_family_id").intersect(events.where(held).select("target_family_id"))


def template_overlap(events: DataFrame) -> DataFrame:
    return events.groupBy("template_id").agg(F.countDistinct("split").alias("splits")).where("splits > 1").select("template_id")


def shared_ids(events: DataFrame, first: str, second: str) -> DataFrame:
    """Event ids that two splits share."""
    return events.where(F.col("split") == first).select("event_id").intersect(events.where(F.col("split") == second).select("event_id"))


def _listed(table: DataFrame, column: str, name: str) -> DataFrame:
    """One row: count and all ids in order."""
    return table.agg(F.count("*").alias(f"n_{name}"), F.sort_array(F.collect_list(column)).alias(name))


def _checks(events: DataFrame, items: DataFrame) -> dict[str, tuple[DataFrame, str]]:
    """The violation table of each check, and its column of ids."""
    return {
        "duplicate_event_ids": (validation.duplicates(events, "event_id"), "event_id"),
        "duplicate_item_ids": (validation.duplicates(items, "item_id"), "item_id"),
        "cross_split_features": (shared_features(events), "fingerprint"),
        "ood_family_overlap": (family_overlap(events), "target_family_id"),
        "template_overlap": (template_overlap(events), "template_id"),
        "inconsistent_targets": (validation.unknown_targets(events, items), "event_id"),
        "missing_splits": (missing_splits(events), "split"),
    }


def _sizes(events: DataFrame, items: DataFrame) -> DataFrame:
    """One row: numbers of events and items, and of events in each split."""
    counts = split_counts(events).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("split", "n")))).alias("split_counts"))
    return events.agg(F.count("*").alias("event_count")).join(items.agg(F.count("*").alias("target_count"))).join(counts)


def _passed(names: Iterable[str]) -> Column:
    return reduce(lambda a, b: a & b, (F.col(f"n_{name}") == 0 for name in names))


def report(events: DataFrame, items: DataFrame) -> DataFrame:
    """One row of counts, lists of violations and ``passed``."""
    out, checks = _sizes(events, items), _checks(events, items)
    for name, (table, column) in checks.items():
        out = out.join(_listed(table, column, name))
    return out.withColumn("passed", _passed(checks))


def summary(events: DataFrame, items: DataFrame) -> DataFrame:
    """The row of ``report`` without its lists, whose size doesn't follow the violations."""
    out, checks = _sizes(events, items), _checks(events, items)
    for name, (table, _) in checks.items():
        out = out.join(table.agg(F.count("*").alias(f"n_{name}")))
    return out.withColumn("passed", _passed(checks))


def violations(events: DataFrame, items: DataFrame) -> DataFrame:
    """(check, id) of every violation, ids as text."""
    tables = (table.select(F.lit(name).alias("check"), F.col(column).cast("string").alias("id")) for name, (table, column) in _checks(events, items).items())
    return reduce(DataFrame.unionByName, tables)


def pages(found: DataFrame, size: int = 1000) -> DataFrame:
    """(check, page, ids): the ids of each check in order, ``size`` on a page; pages from 1.

    Ids are numbered in ranges, so no task and no row holds more than its share of a check.
    """
    placed = ranks.numbered(found, ["check"], ["id"]).withColumn("page", F.ceil(F.col("n") / size))
    ids = F.transform(F.sort_array(F.collect_list(F.struct("n", "id"))), lambda x: x["id"])
    return placed.groupBy("check", "page").agg(ids.alias("ids"))
