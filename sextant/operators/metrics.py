"""Ranking metrics. Averages start from the queries, so a query without a hit counts as 0."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sextant.functions import scalars as S


def per_query(rankings: DataFrame, relevance: DataFrame, k: int = 10, groups: tuple[str, ...] = (), cells: DataFrame | None = None) -> DataFrame:
    """(groups, query_id, n_relevant, recall_1, recall_k, rr, ndcg_k) of each query with relevant items.

    relevance: (query_id, item_id), and those groups that belong to the query, such as its split;
    rankings: (the other groups, such as rankers, query_id, rank, item_id) with ranks from 1. Each query
    counts in all values of the other groups: those of ``cells``, a small table, or those that occur in
    the rankings. So a query without ranking rows counts as 0 there. The relevant items meet the
    rankings by query and item, so only hits are aggregated.
    """
    own = [g for g in groups if g in relevance.columns]
    others = [g for g in groups if g not in own]
    wanted = relevance.select("query_id", "item_id").distinct()
    sizes = relevance.select(*own, "query_id", "item_id").distinct().groupBy(*own, "query_id").agg(F.count("*").alias("n_relevant"))
    if others:
        values = rankings.select(*others).distinct() if cells is None else cells.select(*others)
        sizes = sizes.crossJoin(F.broadcast(values))  # the few values of a grid
    hits = rankings.where(F.col("rank") <= k).join(wanted, ["query_id", "item_id"], "left_semi")
    per = hits.groupBy(*others, "query_id").agg(
        F.count(F.when(F.col("rank") <= 1, 1)).alias("h1"), F.count("*").alias("hk"), F.min("rank").alias("first"), F.sum(S.log2_gain(F.col("rank"))).alias("gain"),
    )
    joined = sizes.join(per, [*others, "query_id"], "left")
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n_relevant"), F.lit(k)).cast("int")), F.lit(0.0), lambda s, r: s + S.log2_gain(r))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return joined.select(
        *groups, "query_id", "n_relevant", (zero(F.col("h1")) / F.col("n_relevant")).alias("recall_1"), (zero(F.col("hk")) / F.col("n_relevant")).alias("recall_k"),
        S.reciprocal_rank(F.col("first")).alias("rr"), (F.coalesce("gain", F.lit(0.0)) / ideal).alias("ndcg_k"),
    )


def summary(per: DataFrame, groups: tuple[str, ...] = (), digits: int | None = None) -> DataFrame:
    """(groups, n_events, recall_1, recall_k, mrr, ndcg_k): macro means."""
    r = (lambda c: F.round(c, digits)) if digits is not None else (lambda c: c)
    means = [F.count("*").alias("n_events"), r(F.avg("recall_1")).alias("recall_1"), r(F.avg("recall_k")).alias("recall_k"), r(F.avg("rr")).alias("mrr"), r(F.avg("ndcg_k")).alias("ndcg_k")]
    return per.groupBy(*groups).agg(*means)


def sane(table: DataFrame) -> DataFrame:
    """The summary rows that can't be right: a metric outside [0, 1] or recall_k below recall_1."""
    outside = lambda c: ~F.col(c).between(0, 1)
    return table.where(outside("recall_1") | outside("recall_k") | outside("mrr") | outside("ndcg_k") | (F.col("recall_k") < F.col("recall_1")))


def grid_gaps(table: DataFrame, axes: dict[str, list], within: tuple[str, ...] = ()) -> DataFrame:
    """Cells of the grid that are absent, repeated, or have another event count than the most common one.

    ``within``: axes along which event counts may differ, such as splits.
    """
    spark = table.sparkSession
    grid = None
    for name, values in axes.items():
        axis = spark.createDataFrame([(v,) for v in values], f"{name} {table.schema[name].dataType.simpleString()}")
        grid = axis if grid is None else grid.crossJoin(axis)  # the axes are given lists
    counts = table.groupBy(*axes).agg(F.count("*").alias("n"), F.min("n_events").alias("low"), F.max("n_events").alias("high"))
    usual = table.groupBy(*within, "n_events").count().groupBy(*within).agg(F.max_by("n_events", F.struct("count", -F.col("n_events"))).alias("usual"))
    joined = grid.join(counts, list(axes), "left")
    joined = joined.join(F.broadcast(usual), list(within), "left") if within else joined.crossJoin(F.broadcast(usual))
    return joined.where("n is null or n <> 1 or low <> usual or high <> usual").select(*axes, F.coalesce("n", F.lit(0)).alias("n"))


def nested(rankings: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """One row for each key with its ranking as an array, for sinks."""
    pairs = F.sort_array(F.collect_list(F.struct("rank", "item_id")))
    return rankings.groupBy(*keys).agg(F.transform(pairs, lambda p: p["item_id"]).alias("ranking"))


def share(test: Column) -> Column:
    """Share of rows that pass a test, 0 for no rows."""
    return F.coalesce(F.avg(test.cast("double")), F.lit(0.0))
