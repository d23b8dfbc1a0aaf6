"""Row numbers in whole groups without one task for a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sextant.sources.scratch import keep


def numbered(rows: DataFrame, group: list[str], order: list[Column | str], tasks: int | None = None, name: str = "n") -> DataFrame:
    """``rows`` with their number from 1 in their group, by an order without ties.

    Rows are dealt out by ranges of group and order; each range is numbered by itself, behind as
    many rows of its group as the ranges before it hold. Only these counts are added up in one place.
    """
    tasks = tasks or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(c).alias(f"_o{k}") if isinstance(c, str) else c.alias(f"_o{k}") for k, c in enumerate(order)]
    keyed = rows.select("*", *keys)
    by = [*group, *(f"_o{k}" for k in range(len(order)))]
    dealt = keep(keyed.repartitionByRange(tasks, *by).withColumn("_p", F.spark_partition_id()), "ranges")
    counts = dealt.groupBy(*group, "_p").agg(F.count("*").alias("_c"))
    before = F.sum("_c").over(Window.partitionBy(*group).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))
    starts = keep(counts.select(*group, "_p", F.coalesce(before, F.lit(0)).alias("_before")), "range_starts")
    inner = F.row_number().over(Window.partitionBy(*group, "_p").orderBy(*by[len(group) :]))
    out = dealt.withColumn("_i", inner).join(F.broadcast(starts), [*group, "_p"])  # a row for each group and range
    return out.select(*rows.columns, (F.col("_before") + F.col("_i")).alias(name))

