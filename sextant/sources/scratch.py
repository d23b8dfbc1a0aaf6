"""The shared folder for intermediate tables."""

from __future__ import annotations

import math
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir.

    Only in local mode, as in tests, one of our own where it is unset; a cluster without it is an
    error, since a folder of one machine would lose what others need.
    """
    conf = spark.sparkContext.getConf()
    folder = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines of the cluster share")
        folder = f"file://{tempfile.gettempdir()}/checkpoints/{spark.sparkContext.applicationId}"
    return folder.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    This cuts the lineage: a lost executor costs a re-read, not the work before it. The table
    stays until ``discard`` or until the folder is cleared, since results read it lazily.
    """
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._kept_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``keep`` that nothing reads any more."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t._kept_at)
        path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def qualified(spark: SparkSession, folder: str) -> str:
    """The folder's full URI in the session's file systems, made if it doesn't exist."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    store = path.getFileSystem(spark._jsc.hadoopConfiguration())
    store.mkdirs(path)
    return store.makeQualified(path).toString()


def write_shards(df: DataFrame, name: str, size: int, most: int, key: Column, order: list[str]) -> list[str]:
    """``df`` in shards of about ``most`` bytes by the hash of ``key``, one folder each; their URIs.

    ``size``: the table's bytes. Tasks read a shard with ``read_shard``, so no
    shard passes through the driver. pyarrow.fs has to reach the shared folder.
    """
    n = max(1, math.ceil(size / most))
    folder = qualified(df.sparkSession, new_folder(df.sparkSession, name))
    placed = df.withColumn("shard", F.pmod(F.xxhash64(key), F.lit(n)).cast("int"))
    placed.repartition(min(n, 1000), "shard").sortWithinPartitions("shard", *order).write.mode("overwrite").partitionBy("shard").parquet(folder)
    return [f"{folder}/shard={k}" for k in range(n)]


def read_shard(uri: str) -> pa.Table | None:
    """The rows of a shard in their order, in a task; None for a shard without rows."""
    from pyarrow import fs
    from pyarrow import parquet

    store, path = fs.FileSystem.from_uri(uri)
    found = store.get_file_info(fs.FileSelector(path, allow_not_found=True))
    parts = [parquet.read_table(f.path, filesystem=store, partitioning=None) for f in sorted(found, key=lambda f: f.path) if f.path.endswith(".parquet")]
    return pa.concat_tables(parts) if parts else None


_held: dict[tuple, object] = {}


def held(uri: str, build, *more) -> object:
    """``build(table of the shard, *more)``, kept by this worker for the next batch or task; one at a time."""
    key = (uri, build.__module__, build.__qualname__, more)
    if key not in _held:
        _held.clear()
        _held[key] = build(read_shard(uri), *more)
    return _held[key]


def sizes(df: DataFrame, each: Column) -> tuple[int, int]:
    """(rows, bytes) of a table by a measure of each row."""
    r = df.agg(F.count("*"), F.coalesce(F.sum(each), F.lit(0))).first()
    return int(r[0]), int(r[1])

