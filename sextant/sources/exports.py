"""Sinks and sources: datasets with manifests, rankings, statistics, split lists."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sextant.operators import leakage, metrics


def write(table: DataFrame, path: str, form: str = "parquet", overwrite: bool = False, order: str | None = None, partition: str | None = None) -> None:
    """Write a table; an existing one is an error unless ``overwrite``. ``order`` sorts by a key."""
    if order:
        table = table.orderBy(order)
    writer = table.write.mode("overwrite" if overwrite else "errorifexists")
    if partition:
        writer = writer.partitionBy(partition)
    if form == "csv":
        writer = writer.option("header", True)
    writer.format(form).save(path)


def row_digest(columns: list[str]) -> Column:
    return F.sha2(F.to_json(F.struct(*(F.col(c) for c in sorted(columns))), {"ignoreNullFields": "false"}), 256)


def fingerprint(table: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(rows, fingerprint): the sum of 60-bit prefixes of row digests, whatever the rows' order or files."""
    prefix = F.conv(F.substring(row_digest(columns or table.columns), 1, 15), 16, 10).cast("decimal(38,0)")
    return table.agg(F.count("*").alias("rows"), F.coalesce(F.sum(prefix), F.lit(0).cast("decimal(38,0)")).cast("string").alias("fingerprint"))


def manifest(items: DataFrame, events: DataFrame) -> DataFrame:
    """One row: counts, counts by split, whether the audit passes, a fingerprint of each table."""
    audit = leakage.summary(events, items).select("event_count", F.col("target_count").alias("item_count"), "split_counts", "passed")
    return audit.join(fingerprint(items).select(F.col("fingerprint").alias("items_fingerprint"))).join(fingerprint(events).select(F.col("fingerprint").alias("events_fingerprint")))


#: Hex digits of a leaf's prefix: 16 ** digits ranges of key hashes.
DIGITS = 3


def leaves(table: DataFrame, key: str, digits: int = DIGITS, columns: list[str] | None = None) -> DataFrame:
    """(prefix, rows, total): the leaves of a hash tree over ranges of key hashes.

    A leaf holds the rows whose key's SHA-256 starts with its prefix; its total is the sum of 60-bit
    prefixes of their row digests. Totals add up, so a node above is the sum of its leaves (``nodes``),
    and they are taken where rows lie. A null key has the hash of the empty text.
    """
    total = F.sum(F.conv(F.substring(row_digest(columns or table.columns), 1, 15), 16, 10).cast("decimal(38,0)"))
    prefix = F.substring(F.sha2(F.coalesce(F.col(key).cast("string"), F.lit("")), 256), 1, digits)
    return table.groupBy(prefix.alias("prefix")).agg(F.count("*").alias("rows"), total.cast("string").alias("total"))


def nodes(tree: DataFrame, digits: int) -> DataFrame:
    """The nodes of a level above the leaves; with 0 digits the root."""
    return tree.groupBy(F.substring("prefix", 1, digits).alias("prefix")).agg(F.sum("rows").alias("rows"), F.sum(F.col("total").cast("decimal(38,0)")).cast("string").alias("total"))


def changed_ranges(kept: DataFrame, found: DataFrame, digits: int = DIGITS) -> DataFrame:
    """(prefix, rows_kept, rows_found) of the leaves that differ, from the root down.

    Each level is compared only below the nodes that differ on the level before.
    """
    none = F.lit(0).cast("long")
    at = None
    for n in range(digits + 1):
        a, b = (nodes(t, n) if n < digits else t for t in (kept, found))
        if at is not None:
            a, b = (t.join(at, F.substring("prefix", 1, n - 1) == F.col("above"), "left_semi") for t in (a, b))
        both = a.join(b.select("prefix", F.col("rows").alias("r"), F.col("total").alias("t")), "prefix", "full").where(~(F.col("rows").eqNullSafe(F.col("r")) & F.col("total").eqNullSafe(F.col("t"))))
        at = both.select(F.col("prefix").alias("above"))
    return both.select("prefix", F.coalesce("rows", none).alias("rows_kept"), F.coalesce("r", none).alias("rows_found"))


def files(table: DataFrame, key: str) -> DataFrame:
    """(file, rows, low, high, total) of each file of a table that was read, with its range of keys."""
    total = F.sum(F.conv(F.substring(row_digest(table.columns), 1, 15), 16, 10).cast("decimal(38,0)")).cast("string")
    return table.groupBy(F.col("_metadata.file_name").alias("file")).agg(F.count("*").alias("rows"), F.min(key).cast("string").alias("low"), F.max(key).cast("string").alias("high"), total.alias("total"))


KEYS = {"items": "item_id", "events": "event_id"}
MANIFEST = "manifest.json"


def _store(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), spark._jvm.org.apache.hadoop.fs.Path


def commit(spark: SparkSession, folder: str, row: dict) -> None:
    """Make a manifest the folder's own: written beside it, then renamed over it in one step."""
    store, path = _store(spark, folder)
    beside, final = path(f"{folder}/{MANIFEST}.{uuid.uuid4().hex}"), path(f"{folder}/{MANIFEST}")
    out = store.create(beside, True)
    out.write(bytearray(json.dumps(row, sort_keys=True).encode()))
    out.close()
    gateway, options = spark.sparkContext._gateway, spark._jvm.org.apache.hadoop.fs.Options.Rename
    how = gateway.new_array(options, 1)
    how[0] = options.OVERWRITE
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(store.getUri(), spark._jsc.hadoopConfiguration())
    context.rename(store.makeQualified(beside), store.makeQualified(final), how)


def read_manifest(spark: SparkSession, folder: str) -> dict | None:
    """The manifest of a committed export; None where there is none, whatever else the folder holds."""
    store, path = _store(spark, folder)
    if not store.exists(path(f"{folder}/{MANIFEST}")):
        return None
    return json.loads("\n".join(r.value for r in spark.read.option("wholetext", True).text(f"{folder}/{MANIFEST}").collect()))


def export_dataset(items: DataFrame, events: DataFrame, folder: str, form: str = "json", overwrite: bool = False) -> None:
    """Items by item_id and events by event_id as one commit; only if the leakage audit passes.

    Tables go to a data folder of their own with their files and hash trees. They are read back and
    compared with what was given; then the manifest that names the data folder is put in place, the
    one step that counts. A failure before it leaves an earlier export whole, and readers
    ignore what no manifest names. The data folder replaced goes last.
    """
    spark = items.sparkSession
    before = read_manifest(spark, folder)
    if before is not None and not overwrite:
        raise ValueError(f"{folder} already exists")
    row = manifest(items, events).first()
    if not row.passed:
        raise ValueError("the leakage audit doesn't pass; nothing was written")
    data = f"data-{uuid.uuid4().hex}"
    for name, table in (("items", items), ("events", events)):
        at = f"{folder}/{data}/{name}"
        write(table, at, form, order=KEYS[name])
        back = spark.read.schema(table.schema).format(form).load(at)
        leaves(back, KEYS[name]).write.parquet(f"{folder}/{data}/{name}-tree")
        files(back, KEYS[name]).write.parquet(f"{folder}/{data}/{name}-files")
        total = nodes(spark.read.parquet(f"{folder}/{data}/{name}-tree"), 0).first()
        if (total.total if total else "0") != row[f"{name}_fingerprint"]:
            raise ValueError(f"{name}: what was read back differs from what was given")
    commit(spark, folder, row.asDict(recursive=True) | {"data": data, "form": form})
    if before is not None:
        store, path = _store(spark, folder)
        store.delete(path(f"{folder}/{before['data']}"), True)


def read_export(spark: SparkSession, folder: str, name: str, schema: str) -> DataFrame:
    """A table of the committed export."""
    kept = read_manifest(spark, folder)
    if kept is None:
        raise FileNotFoundError(f"{folder} holds no committed export")
    return spark.read.schema(schema).format(kept["form"]).load(f"{folder}/{kept['data']}/{name}")


def tampering(spark: SparkSession, folder: str, name: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """What differs from a committed table: its ranges of key hashes, and its files.

    (prefix, rows_kept, rows_found) and (file, low, high, rows_kept, rows_found: null for a file that is gone).
    """
    kept = read_manifest(spark, folder)
    now, base = read_export(spark, folder, name, schema), f"{folder}/{kept['data']}/{name}"
    ranges = changed_ranges(spark.read.parquet(f"{base}-tree"), leaves(now, KEYS[name]))
    a, b = spark.read.parquet(f"{base}-files"), files(now, KEYS[name])
    both = a.alias("a").join(b.alias("b"), "file", "full").where(~(F.col("a.rows").eqNullSafe(F.col("b.rows")) & F.col("a.total").eqNullSafe(F.col("b.total"))))
    return ranges, both.select("file", F.coalesce("a.low", "b.low").alias("low"), F.coalesce("a.high", "b.high").alias("high"), F.col("a.rows").alias("rows_kept"), F.col("b.rows").alias("rows_found"))


def verify_export(spark: SparkSession, folder: str, items_schema: str, events_schema: str) -> list[str]:
    """Names of the tables of an export that differ from its manifest."""
    kept = read_manifest(spark, folder)
    return [name for name, schema in (("items", items_schema), ("events", events_schema)) if fingerprint(read_export(spark, folder, name, schema)).first().fingerprint != kept[f"{name}_fingerprint"]]


def export_rankings(rankings: DataFrame, path: str, keys: tuple[str, ...], overwrite: bool = False) -> None:
    """One row for each event with its ranking as a list, a folder for each ranker."""
    write(metrics.nested(rankings, keys), path, "parquet", overwrite, partition="ranker")


def export_statistics(statistics: DataFrame, path: str, overwrite: bool = False) -> None:
    """Paired statistics, a row for each ranker and contrast, as JSON lines in that order."""
    statistics.orderBy("ranker", "contrast").write.mode("overwrite" if overwrite else "errorifexists").json(path)


def export_decisions(decisions: DataFrame, cases: DataFrame, path: str, overwrite: bool = False) -> None:
    """Each decision beside the expected outcome, whether it conforms, its rules and why, as JSON lines by request."""
    audit = decisions.join(cases.select("request_id", "expected_outcome"), "request_id").withColumn("conforms", F.col("outcome") == F.col("expected_outcome"))
    write(audit, path, "json", overwrite, "request_id")


def split_manifest(events: DataFrame, path: str, overwrite: bool = False) -> None:
    write(events.select("event_id", "split", "target_family_id", "template_id"), path, "csv", overwrite, "event_id")


def read_split_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("event_id string, split string, target_family_id int, template_id int").option("header", True).csv(path)
