"""Exact top-k rankings of query tables against an item library.

Two forms with the same results. The blocked form multiplies Arrow batches of queries with the
library as a matrix and keeps each query's best rows inside the batch, so the product of queries
and items is never shuffled. The library is written in shards of ``LIBRARY_BYTES`` that tasks read
from the shared folder, so it never passes through the driver; a shard's best rows are
merged by rank, which is exact, and with one shard nothing is shuffled at all. Rows of a shard lie in
clusters, and a cluster is multiplied only with the queries whose k-th score it can still reach. The expression form does
the same with built-in functions, a block of items in a row.

``prepare`` checks and writes a library once for several rankings.

Order is score descending, then item_id. ``digits`` rounds scores before they are ordered, for
comparisons between engines that add in different orders.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from hashlib import sha256
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from sextant.functions import scalars as S
from sextant.functions import vectors as V
from sextant.operators import permutation, ranks
from sextant.sources.scratch import discard, held, keep, read_shard, write_shards

#: Bytes of item vectors (and memory vectors) that a task holds at once.
LIBRARY_BYTES = 32 << 20
#: Scores held at once, of a batch of queries.
BLOCK_SCORES = 4 << 20
#: The same for the hybrid, which holds several blocks at once; rows of its results in a batch.
HYBRID_SCORES, HYBRID_ROWS = 512 << 10, 20_000
#: Records of an item that lie in layers; largest exponent at which weights keep away from their floor.
LAYERS, SAFE_EXPONENT = 64, 600.0
#: Rows that are one cluster; most clusters, rows of the sample for each, and rounds that place their centres.
CLUSTER_LEAST, CLUSTER_MOST, CLUSTER_SAMPLE, CLUSTER_ROUNDS = 1024, 1024, 16, 3
#: Rows in a batch of rankings by hashes.
SHUFFLED_ROWS = 20_000
#: Added to angles and bounds, for rounding.
BOUND_SLACK = 1e-7
#: Most bytes of a library that the expression form takes.
EXPRESSION_BYTES = 64 << 20
#: Items in a row of the expression form.
BLOCK_ITEMS = 512


def check_library(items: DataFrame, vector: str = "item_vector") -> int:
    """Dimension of the library; ValueError for duplicate ids, mixed dimensions or zero norms."""
    return _checked(items, vector)[0]


def _checked(items: DataFrame, vector: str) -> tuple[int, int]:
    r = items.agg(F.count("*").alias("n"), F.countDistinct("item_id").alias("ids"), F.min(F.size(vector)).alias("low"), F.max(F.size(vector)).alias("high"), F.count(V.normalise(F.col(vector))).alias("units")).first()
    if not r.n or r.ids < r.n or r.low != r.high or r.units < r.n:
        raise ValueError(f"library of {r.n} rows: {r.ids} distinct ids, dimensions {r.low} to {r.high}, {r.units} vectors with a direction")
    return int(r.high), int(r.n)


@dataclass(frozen=True)
class Library:
    """A checked library in shards that tasks read; with ``memory``, its records in shards of the same items."""

    dim: int
    shards: tuple[str, ...]
    memory: tuple[str, ...] = ()


def prepare(items: DataFrame, most: int = LIBRARY_BYTES, memory: DataFrame | None = None) -> Library:
    """Write (item_id, item_vector), and the active memory records of these items, as a ``Library``."""
    table = keep(items.select("item_id", "item_vector"), "library")
    dim, n = _checked(table, "item_vector")
    size = n * (8 * dim + 64)
    if memory is None:
        out = Library(dim, tuple(write_shards(clustered(table, "item_vector", n), "library_shards", size, most, F.col("item_id"), ["cluster", "item_id"])))
        discard(table)
        return out
    records = memory.where("active").select("item_id", "memory_id", "context_vector", "strength", F.unix_micros("updated_at").alias("updated"))
    records = keep(records.join(table.select("item_id"), "item_id", "left_semi"), "memory")
    size += records.count() * (8 * dim + 64)
    out = Library(dim, tuple(write_shards(table, "library_shards", size, most, F.col("item_id"), ["item_id"])), tuple(write_shards(records, "memory_shards", size, most, F.col("item_id"), ["item_id", "memory_id"])))
    discard(table, records)
    return out


def library(items: DataFrame) -> DataFrame:
    """Distinct items by id; sorting belongs to the sink."""
    return items.select("item_id", "family_id", "item_vector").dropDuplicates(["item_id"])


def ranked(scored: DataFrame, keys: list[str], k: int, score: str = "score", ties: tuple[str, ...] = ("item_id",)) -> DataFrame:
    """The best k rows of each key with ``rank`` from 1, by score descending, then ties."""
    order = Window.partitionBy(*keys).orderBy(F.col(score).desc(), *ties)
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def cosine_expressions(queries: DataFrame, items: DataFrame, k: int, digits: int | None = None, most: int = EXPRESSION_BYTES) -> DataFrame:
    """The expression form over (query_id, vector): each query meets blocks of items and keeps k of each.

    Blocks are copied to the queries, so a library of more than ``most`` bytes is an error.
    """
    size, dim = items.agg(F.count("*"), F.coalesce(F.max(F.size("item_vector")), F.lit(0))).first()
    if size * (8 * dim + 64) > most:
        raise ValueError(f"{size} items of {dim} dimensions are more than {most} bytes: use cosine_top_k")
    n = max(1, math.ceil(size / BLOCK_ITEMS))
    units = items.select(F.expr(f"pmod(xxhash64(item_id), {n})").alias("block"), F.struct("item_id", V.normalise(F.col("item_vector")).alias("u")).alias("x"))
    blocks = units.groupBy("block").agg(F.collect_list("x").alias("items"))
    q = queries.select("query_id", V.normalise(F.col("vector")).alias("q")).where("q is not null")
    score = lambda x: F.round(V.dot(F.col("q"), x["u"]), digits) if digits is not None else V.dot(F.col("q"), x["u"])
    best = F.slice(F.sort_array(F.transform("items", lambda x: F.struct((-score(x)).alias("s"), x["item_id"].alias("item_id")))), 1, k)
    found = q.join(F.broadcast(blocks)).select("query_id", F.explode(best).alias("x")).select("query_id", "x.item_id", (F.lit(0.0) - F.col("x.s")).alias("score"))
    return ranked(found, ["query_id"], k).select("query_id", "rank", "item_id", "score")


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _units(x: np.ndarray) -> np.ndarray:
    n = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x / np.where(n > V.EPSILON, n, np.nan)


def centres(sample: np.ndarray, n: int) -> np.ndarray:
    """``n`` unit centres of a sample of unit vectors (k-means by cosine, a few rounds)."""
    out = sample[:: max(1, len(sample) // n)][:n]
    for _ in range(CLUSTER_ROUNDS):
        nearest = (sample @ out.T).argmax(axis=1)
        sums = np.zeros_like(out)
        np.add.at(sums, nearest, sample)
        size = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
        out = np.where(size > V.EPSILON, sums / np.where(size > V.EPSILON, size, 1), out)
    return out


def clustered(rows: DataFrame, vector: str, n: int) -> DataFrame:
    """``rows`` with ``cluster``: the nearest of about the root of ``n`` centres, made of CLUSTER_SAMPLE rows for each at most.

    Centres only decide which rows are skipped together, not the results. Tables of CLUSTER_LEAST rows or
    fewer are one cluster.
    """
    wanted = min(CLUSTER_MOST, math.isqrt(n))
    if n <= CLUSTER_LEAST:
        return rows.withColumn("cluster", F.lit(0))
    some = rows.select(F.col(vector).alias("v")).orderBy(F.xxhash64("v")).limit(CLUSTER_SAMPLE * wanted).collect()
    found = _units(np.array([r.v for r in some], float))
    found = centres(found[np.isfinite(found).all(axis=1)], wanted)
    if not len(found):
        return rows.withColumn("cluster", F.lit(0))
    names = [f.name for f in rows.schema]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                nearest = (np.nan_to_num(_units(_matrix(batch.column(names.index(vector))))) @ found.T).argmax(axis=1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(nearest.astype(np.int32))], [*names, "cluster"])

    return rows.mapInArrow(assign, StructType([*rows.schema.fields, StructField("cluster", IntegerType())]))


class Clusters:
    """Unit vectors of a shard in runs of one cluster each: every member of a run is within an angle of its centre."""

    def __init__(self, units: np.ndarray, cluster: np.ndarray, order: np.ndarray):
        self.units, self.order = units, order
        self.start = np.flatnonzero(np.r_[True, cluster[1:] != cluster[:-1]])
        self.stop = np.r_[self.start[1:], len(units)]
        self.centre = np.nan_to_num(_units(np.add.reduceat(np.nan_to_num(units), self.start, axis=0)))
        nearest = np.clip(np.einsum("ij,ij->i", np.nan_to_num(units), np.repeat(self.centre, self.stop - self.start, axis=0)), -1, 1)
        self.angle = np.arccos(np.minimum.reduceat(nearest, self.start)) + BOUND_SLACK

    def cosines(self, queries: np.ndarray) -> np.ndarray:
        """Most cosine that any member of a run can have with each query."""
        apart = np.arccos(np.clip(queries @ self.centre.T, -1, 1))
        return np.cos(np.maximum(0, apart - self.angle)) + BOUND_SLACK

    def best(self, queries: np.ndarray, k: int, bound: np.ndarray, score: Callable[[np.ndarray, np.ndarray, slice], np.ndarray]) -> tuple[np.ndarray, np.ndarray, int]:
        """(rows, scores, pairs scored): the k best of each query by score descending, then order; -1 and -inf where there are fewer.

        ``bound``: most score that each query can have in each run; ``score(cosines, queries, run)``: scores of a block.
        Each query first meets its most promising run; then each run is multiplied with
        those queries whose k-th score it can still reach.
        """
        n = len(queries)
        top, at, ties = np.full((n, k), -np.inf), np.full((n, k), -1), np.full((n, k), np.iinfo(np.int64).max)
        first, scored = bound.argmax(axis=1), 0
        for turn in (0, 1):
            for run, (start, stop) in enumerate(zip(self.start, self.stop, strict=True)):
                who = np.flatnonzero(first == run if turn == 0 else (first != run) & (bound[:, run] >= top[:, -1]))
                if not len(who):
                    continue
                scored += len(who) * (stop - start)
                own = score(queries[who] @ self.units[start:stop].T, who, slice(start, stop))
                own = np.where(np.isnan(own), -np.inf, own)
                if stop - start > 4 * k:  # what is below the k-th best of the run can't stay
                    edge = np.partition(own, own.shape[1] - k, axis=1)[:, own.shape[1] - k]
                    column = np.flatnonzero((own >= np.maximum(edge, top[who, -1])[:, None]).any(axis=0))
                    own = own[:, column]
                else:
                    column = np.arange(stop - start)
                rows = np.broadcast_to(start + column, own.shape)
                both = [np.concatenate(x, axis=1) for x in ((top[who], own), (at[who], rows), (ties[who], np.broadcast_to(self.order[start + column], own.shape)))]
                best = np.lexsort((both[2], -both[0]), axis=1)[:, :k]
                top[who], at[who], ties[who] = (np.take_along_axis(x, best, axis=1) for x in both)
        at[np.isinf(top)] = -1
        return at, top, scored


def _places(*columns: pa.Array) -> np.ndarray:
    """Places of rows in the order of text columns (by bytes)."""
    keys = list(zip(*([x.encode() for x in c.to_pylist()] for c in columns), strict=True))
    out = np.empty(len(keys), np.int64)
    out[sorted(range(len(keys)), key=keys.__getitem__)] = np.arange(len(keys))
    return out


def _clusters(shard: pa.Table, vector: str, *ids: str) -> Clusters:
    units = _units(_matrix(shard.column(vector).combine_chunks()))
    cluster = shard.column("cluster").to_numpy() if "cluster" in shard.column_names else np.zeros(len(units), int)
    return Clusters(units, cluster, _places(*(shard.column(c) for c in ids)))


def _cosine_side(shard: pa.Table | None) -> tuple[pa.Array, Clusters] | None:
    if shard is None or not shard.num_rows:
        return None
    return pa.array(shard.column("item_id").to_pylist(), pa.string()), _clusters(shard, "item_vector", "item_id")


def _taken(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(query, place) of the rows found, and their ranks."""
    query, place = np.nonzero(at >= 0)
    return query, place, pa.array((place + 1).astype(np.int32))


def _cosine(uri: str, k: int, digits: int | None, work: bool = False):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            side = held(uri, _cosine_side)
            if side is None:
                continue
            names, clusters = side
            step = max(1, BLOCK_SCORES // len(names))
            slack = 0 if digits is None else 10.0**-digits
            score = (lambda x, who, rows: x) if digits is None else (lambda x, who, rows: np.round(x, digits) + 0.0)
            for i in range(0, batch.num_rows, step):
                part = batch.slice(i, step)
                asked = _units(_matrix(part.column(1)))
                at, scores, scored = clusters.best(asked, min(k, len(names)), clusters.cosines(asked) + slack, score)
                if work:
                    yield pa.RecordBatch.from_arrays([pa.array([part.num_rows * len(names)], pa.int64()), pa.array([scored], pa.int64())], ["pairs", "scored"])
                    continue
                query, place, rank = _taken(at)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(query)), rank, names.take(pa.array(at[query, place])), pa.array(scores[query, place])], ["query_id", "rank", "item_id", "score"])

    return run


def scored_share(queries: DataFrame, library: Library, k: int, digits: int | None = None) -> DataFrame:
    """(pairs, scored): the pairs of (query_id, vector) and items, and how many of them ``cosine_top_k`` multiplies."""
    asked = queries.select(F.col("query_id").cast("string").alias("query_id"), F.col("vector").cast(V.DOUBLES).alias("vector"))
    parts = [asked.mapInArrow(_cosine(uri, k, digits, True), "pairs long, scored long") for uri in library.shards]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out.agg(F.sum("pairs").alias("pairs"), F.sum("scored").alias("scored"))


def _spread(asked: DataFrame) -> DataFrame:
    """Queries over all cores: each costs the whole library, however few bytes they are and whatever files hold them."""
    return asked.repartition(2 * asked.sparkSession.sparkContext.defaultParallelism, "query_id")


def _merged(parts: list[DataFrame], keys: list[str], k: int, ties: tuple[str, ...] = ("item_id",)) -> DataFrame:
    """The best k of each key of rankings by shards; the ranking itself where there is one shard."""
    if len(parts) == 1:
        return parts[0]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return ranked(out.drop("rank"), keys, k, ties=ties)


def cosine_top_k(queries: DataFrame, items: DataFrame | Library, k: int, digits: int | None = None, most: int = LIBRARY_BYTES) -> DataFrame:
    """(query_id, rank, item_id, score) of the k nearest items of each (query_id, vector).

    ``k`` beyond the library's size gives the whole library. Queries without a direction are an
    error of the caller: see ``vectors.is_finite``. Query ids are unique.
    """
    if k < 1:
        raise ValueError("k is 1 at least")
    library = items if isinstance(items, Library) else prepare(items, most)
    asked = queries.select(F.col("query_id").cast("string").alias("query_id"), F.col("vector").cast(V.DOUBLES).alias("vector"))
    parts = [asked.mapInArrow(_cosine(uri, k, digits), "query_id string, rank int, item_id string, score double") for uri in library.shards]
    return _merged(parts, ["query_id"], k).select("query_id", "rank", "item_id", "score")


def random_top_k(queries: DataFrame, items: DataFrame, k: int, seed: int, key: str = "query_id") -> DataFrame:
    """A reproducible random ranking of each query, which depends on the seed and ``key`` alone.

    Items are numbered by id; a query's items are the first images of its keyed permutation of
    the numbers, so a query costs k items and not the library. Duplicate ids are an error.
    """
    r = items.agg(F.count("*").alias("n"), F.countDistinct("item_id").alias("ids")).first()
    if r.ids < r.n:
        raise ValueError(f"library of {r.n} rows: {r.ids} distinct ids")
    numbers = ranks.numbered(items.select("item_id"), [], ["item_id"], name="number")
    asked = queries.select(F.col("query_id").cast("string").alias("query_id"), permutation.first(k, r.n, F.col(key).cast("string"), seed).alias("x"))
    found = asked.select("query_id", F.posexplode("x").alias("at", "number")).select("query_id", (F.col("at") + 1).alias("rank"), (F.col("number") + 1).alias("number"))
    return found.join(numbers, "number").select("query_id", "rank", "item_id")


def _name_side(shard: pa.Table | None) -> list[bytes] | None:
    return None if shard is None or not shard.num_rows else [x.encode() for x in shard.column("item_id").to_pylist()]


def _least(start: bytes, names: list[bytes], k: int) -> list[tuple[bytes, bytes]]:
    """(hash, name) of the k names with the least hashes behind ``start``; every name is hashed."""
    digests = b"".join([sha256(start + x).digest() for x in names])
    k = min(k, len(names))
    lead = np.frombuffer(digests, ">u8")[::4].astype(np.uint64)
    near = np.flatnonzero(lead <= np.partition(lead, k - 1)[k - 1])
    return sorted((digests[32 * i : 32 * i + 32], names[i]) for i in near.tolist())[:k]


def _shuffled(uri: str, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = held(uri, _name_side)
            if names is None:
                continue
            step = max(1, SHUFFLED_ROWS // min(k, len(names)))
            for i in range(0, batch.num_rows, step):
                part = batch.slice(i, step)
                found = [(query, n, name.decode(), h) for query, start in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True) for n, (h, name) in enumerate(_least(start.encode(), names, k), 1)]
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*found, strict=True), (pa.string(), pa.int32(), pa.string(), pa.binary()), strict=True)], ["query_id", "rank", "item_id", "h"])

    return run


def shuffled_top_k(queries: DataFrame, items: DataFrame | Library, k: int, seed: int, key: str = "query_id", most: int = LIBRARY_BYTES) -> DataFrame:
    """The first k items of a random order of the whole library for each query, which depends on the seed and ``key`` alone.

    The order is that of the hashes of seed, key and item, so each query costs the whole library: tasks
    hash all items of a shard and keep its k least. ``random_top_k`` is the form that draws k items alone.
    """
    if k < 1:
        raise ValueError("k is 1 at least")
    library = items if isinstance(items, Library) else prepare(items, most)
    asked = _spread(queries.select(F.col("query_id").cast("string").alias("query_id"), F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"), F.lit("")).alias("start")))
    parts = [asked.mapInArrow(_shuffled(uri, k), "query_id string, rank int, item_id string, h binary") for uri in library.shards]
    out = parts[0]
    if len(parts) > 1:
        for x in parts[1:]:
            out = out.unionByName(x)
        order = Window.partitionBy("query_id").orderBy("h", "item_id")
        out = out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return out.select("query_id", "rank", "item_id")


Ranker = Callable[[DataFrame], DataFrame]


def all_rankers(queries: DataFrame, rankers: dict[str, Ranker]) -> DataFrame:
    """(ranker, query_id, rank, item_id): every ranker on every query."""
    out = None
    for name, rank in rankers.items():
        one = rank(queries).select(F.lit(name).alias("ranker"), "query_id", "rank", "item_id")
        out = one if out is None else out.unionByName(one)
    return out


def _both_sides(shard: pa.Table | None, memory_uri: str) -> dict | None:
    """Items and their records: items with most records first, so that records lie in layers, the n-th of each item together."""
    if shard is None or not shard.num_rows:
        return None
    kept = read_shard(memory_uri)
    kept = None if kept is None or not kept.num_rows else kept
    ids = shard.column("item_id").combine_chunks().cast(pa.string())
    owner = np.zeros(0, int) if kept is None else pc.index_in(kept.column("item_id").combine_chunks().cast(pa.string()), value_set=ids).to_numpy(zero_copy_only=False).astype(int)
    count = np.bincount(owner, minlength=len(ids))
    order = np.argsort(-count, kind="stable")
    place = np.empty(len(ids), np.int64)
    place[pc.sort_indices(ids).to_numpy()] = np.arange(len(ids))
    out = {"names": ids.take(pa.array(order)), "place": place[order], "units": _units(_matrix(shard.column("item_vector").combine_chunks()))[order], "records": 0}
    if kept is None:
        return out
    count, column = count[order], np.empty(len(ids), int)
    column[order] = np.arange(len(ids))
    column = column[owner]
    by_item = np.argsort(column, kind="stable")
    nth = np.arange(len(column)) - np.searchsorted(column[by_item], column[by_item])  # of its item
    # items with more than LAYERS records lie item by item, in front
    many = int((count > LAYERS).sum())
    rows = by_item[np.lexsort((column[by_item], np.where(column[by_item] < many, -1, nth)))]
    heads = np.cumsum(np.r_[0, count[:many]])
    layers = [int((count[many:] > n).sum()) for n in range(int(count[many:].max(initial=0)))]
    # a record without a direction is like nothing
    vectors = np.nan_to_num(_units(_matrix(kept.column("context_vector").combine_chunks()))[rows])
    return out | {"records": len(rows), "vectors": vectors, "strength": kept.column("strength").to_numpy()[rows], "updated": kept.column("updated").to_numpy().astype(float)[rows], "heads": heads, "layers": layers, "owners": int((count > 0).sum())}


def _decayed(memory: dict, at: np.ndarray, rate: float | None, days: float) -> np.ndarray:
    """Strength times decay of each record, for queries at ``at`` (microseconds) and ``days`` later."""
    weight = memory["strength"][None, :]
    if rate is None:
        return weight
    age = (at[:, None] + days * 86_400e6 - memory["updated"][None, :]) / 86_400e6
    return weight * np.maximum(np.exp(-rate * age), S.TINY)


def _best_records(side: dict, weighted: np.ndarray) -> np.ndarray:
    """The best record of each item that has some, from scores of records in their layers."""
    heads, layers = side["heads"], side["layers"]
    many = len(heads) - 1
    out = np.empty((len(weighted), side["owners"]))
    if many:
        out[:, :many] = np.maximum.reduceat(weighted[:, : heads[-1]], heads[:-1], axis=1)
    start = heads[-1]
    for n, width in enumerate(layers):
        layer, own = weighted[:, start : start + width], out[:, many : many + width]
        own[:] = layer if n == 0 else np.maximum(own, layer)
        start += width
    return out


def _recalls(side: dict, similar: np.ndarray, at: np.ndarray, wanted: set[tuple]) -> dict[tuple, np.ndarray]:
    """The best decayed record of each item for (rate, days) pairs: of a rate once, and scaled for the days where no weight meets its floor."""
    out: dict[tuple, np.ndarray] = {}
    times, which = np.unique(at, return_inverse=True)
    for rate in {r for r, _ in wanted}:
        days = sorted({n for r, n in wanted if r == rate})
        weigh = lambda n, rate=rate: (lambda w: w if len(w) == 1 else w[which])(_decayed(side, times, rate, n))
        ages = np.array([times[0] - side["updated"].max(), times[-1] - side["updated"].min()]) / 86_400e6
        if rate is None or max(abs(rate * (age + n)) for age in ages for n in (*days, 0)) < SAFE_EXPONENT:
            base = _best_records(side, similar * weigh(0))
            for n in days:
                out[rate, n] = np.clip(base if rate is None or n == 0 else base * math.exp(-rate * n), 0, 1)
        else:
            for n in days:
                out[rate, n] = np.clip(_best_records(side, similar * weigh(n)), 0, 1)
    return out


def best_columns(scores: np.ndarray, k: int, place: np.ndarray, digits: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, rank from 0, score) of the k best of each row, by score (clipped to 0 and 1, and rounded), then place; NaN is never chosen.

    The k-th best maximum of runs of columns is a bound, and only what reaches it is rounded and sorted.
    """
    n = scores.shape[1]
    k = min(k, n)
    run = max(1, min(64, n // (4 * k)))
    most = np.maximum.reduceat(scores, np.arange(0, n, run), axis=1) if run > 1 else scores
    slack = 1e-12 if digits is None else 2 * 10.0**-digits
    bound = np.partition(most, most.shape[1] - k, axis=1)[:, most.shape[1] - k] - slack
    exact = lambda x: np.clip(x, 0, 1) if digits is None else np.round(np.clip(x, 0, 1), digits) + 0.0
    near = scores >= bound[:, None]
    for i in np.flatnonzero(near.sum(axis=1) > 16 * k):  # many equal scores: those in front by place
        own = exact(scores[i])
        edge = np.partition(own, n - k)[n - k]
        above, equal = np.flatnonzero(own > edge), np.flatnonzero(own == edge)
        left = k - len(above)
        near[i] = False
        near[i, above] = True
        near[i, equal if left >= len(equal) else equal[np.argpartition(place[equal], left)[:left]]] = True
    row, column = np.nonzero(near)
    score = exact(scores[row, column])
    order = np.lexsort((place[column], -score, row))
    row, column, score = row[order], column[order], score[order]
    rank = np.arange(len(row)) - np.searchsorted(row, row)
    kept = rank < k
    return row[kept], column[kept], rank[kept], score[kept]


def _hybrid(uri: str, memory_uri: str, cells: list[dict], k: int, digits: int | None):
    # the weight alone tells cells apart, so those that differ only in what has no part in it are scored once
    of = [(c["alpha"], None if c["alpha"] == 1 else (c["rate"], 0 if c["rate"] is None else c["days"])) for c in cells]
    alike = {x: [c["cell"] for c, y in zip(cells, of, strict=True) if x == y] for x in dict.fromkeys(of)}
    columns = ["query_id", "cell", "rank", "item_id", "score", "library_score", "memory_score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            side = held(uri, _both_sides, memory_uri)
            if side is None:
                continue
            names, n, owners = side["names"], len(side["names"]), side.get("owners", 0)
            step = max(1, HYBRID_SCORES // (n + side["records"]))
            waiting: list[tuple] = []
            for i in range(0, batch.num_rows, step):
                part = batch.slice(i, step)
                fused, projected = _units(_matrix(part.column(1))), _units(_matrix(part.column(2)))
                by_item = np.clip(projected @ side["units"].T, 0, 1)
                recalls = {}
                if owners and (wanted := {x for _, x in alike if x}):
                    recalls = _recalls(side, np.clip(fused @ side["vectors"].T, 0, 1), part.column(3).to_numpy(zero_copy_only=False).astype(float), wanted)
                for (alpha, key), cell_names in alike.items():
                    total, recalled = alpha * by_item, recalls.get(key)
                    if recalled is not None:
                        total[:, :owners] += (1 - alpha) * recalled
                    if not 0 <= alpha <= 1:
                        np.clip(total, 0, 1, out=total)
                    row, column, rank, score = best_columns(total, k, side["place"], digits)
                    memory = np.zeros(len(row))
                    if recalled is not None:
                        own = column < owners
                        memory[own] = recalled[row[own], column[own]]
                    waiting += [(row + i, cell, rank + 1, column, score, by_item[row, column], memory) for cell in cell_names]
                if i + step >= batch.num_rows or sum(len(x[0]) for x in waiting) >= HYBRID_ROWS:
                    row, rank, column, score, by, memory = (np.concatenate([x[at] for x in waiting]) for at in (0, 2, 3, 4, 5, 6))
                    cell = pa.array([x[1] for x in waiting], pa.string()).take(pa.array(np.repeat(np.arange(len(waiting)), [len(x[0]) for x in waiting])))
                    waiting = []
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), cell, pa.array(rank.astype(np.int32)), names.take(pa.array(column)), pa.array(score), pa.array(by), pa.array(memory)], columns)

    return run


def hybrid_top_k(queries: DataFrame, items: DataFrame | Library, memory: DataFrame | None, cells: list[dict], k: int, digits: int | None = None, most: int = LIBRARY_BYTES) -> DataFrame:
    """Rankings by ``alpha * library + (1 - alpha) * memory`` for each cell of a grid.

    queries: (query_id, vector: fused, projected: to be compared with the items, as_of). A cell
    is {cell, alpha, rate (None: no decay), days (added to as_of)}. Similarities are taken once
    for all cells. All active memories compete before the best of each item counts; items
    without memory score 0 there, and memories of other items never show.

    Items are sharded together with their memories (``prepare`` with a memory does so once); a
    shard's best rows are merged by rank.
    """
    library = items if isinstance(items, Library) else prepare(items, most, memory)
    asked = _spread(queries.select(F.col("query_id").cast("string").alias("query_id"), F.col("vector").cast(V.DOUBLES).alias("vector"), F.col("projected").cast(V.DOUBLES).alias("projected"), F.unix_micros("as_of").alias("as_of")))
    schema = "query_id string, cell string, rank int, item_id string, score double, library_score double, memory_score double"
    parts = [asked.mapInArrow(_hybrid(uri, memory_uri, cells, k, digits), schema) for uri, memory_uri in zip(library.shards, library.memory, strict=True)]
    return _merged(parts, ["cell", "query_id"], k)


def _record_side(shard: pa.Table | None) -> dict | None:
    if shard is None or not shard.num_rows:
        return None
    clusters = _clusters(shard, "context_vector", "item_id", "memory_id")
    strength, updated = shard.column("strength").to_numpy(), shard.column("updated").to_numpy().astype(float)
    # for bounds: the strongest and the latest record of each run
    most = {"strength": np.maximum.reduceat(strength, clusters.start), "updated": np.maximum.reduceat(updated, clusters.start)}
    return {"memory": pa.array(shard.column("memory_id").to_pylist(), pa.string()), "item": pa.array(shard.column("item_id").to_pylist(), pa.string()), "clusters": clusters, "strength": strength, "updated": updated, "most": most}


def _recall(uri: str, k: int, rate: float | None, digits: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            side = held(uri, _record_side)
            if side is None:
                continue
            clusters = side["clusters"]
            step = max(1, BLOCK_SCORES // len(clusters.units))
            for i in range(0, batch.num_rows, step):
                part = batch.slice(i, step)
                asked, times = _units(_matrix(part.column(1))), part.column(2).to_numpy(zero_copy_only=False).astype(float)

                def score(x: np.ndarray, who: np.ndarray, rows: slice, times: np.ndarray = times, side: dict = side) -> np.ndarray:
                    own = np.clip(x, 0, 1) * _decayed({n: side[n][rows] for n in ("strength", "updated")}, times[who], rate, 0)
                    return np.round(own, digits) + 0.0 if digits is not None else own

                # a negative rate makes old records strong, so that their weight has no such bound
                weight = _decayed(side["most"], times, rate, 0) if rate is None or rate >= 0 else np.inf
                bound = np.clip(clusters.cosines(asked), 0, 1) * weight + BOUND_SLACK + (0 if digits is None else 10.0**-digits)
                at, scores, _ = clusters.best(asked, min(k, len(clusters.units)), np.nan_to_num(bound, nan=np.inf, posinf=np.inf), score)
                query, place, rank = _taken(at)
                rows = at[query, place]
                similar = np.clip(np.einsum("ij,ij->i", asked[query], clusters.units[rows]), 0, 1)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(query)), rank, side["memory"].take(pa.array(rows)), side["item"].take(pa.array(rows)), pa.array(similar), pa.array(scores[query, place])], ["query_id", "rank", "memory_id", "item_id", "similarity", "score"]
                )

    return run


def memory_top_k(queries: DataFrame, memory: DataFrame, k: int, rate: float | None, digits: int | None = None, most: int = LIBRARY_BYTES) -> DataFrame:
    """(query_id, rank, memory_id, item_id, similarity, score) of the k best active records of each (query_id, vector, as_of)."""
    records = keep(memory.where("active").select("item_id", "memory_id", "context_vector", "strength", F.unix_micros("updated_at").alias("updated")), "memory")
    r = records.agg(F.count("*").alias("n"), F.max(F.size("context_vector")).alias("dim")).first()
    shards = write_shards(clustered(records, "context_vector", r.n), "record_shards", r.n * (8 * (r.dim or 0) + 96), most, F.col("memory_id"), ["cluster", "item_id", "memory_id"])
    discard(records)
    asked = queries.select(F.col("query_id").cast("string").alias("query_id"), F.col("vector").cast(V.DOUBLES).alias("vector"), F.unix_micros("as_of").alias("as_of"))
    parts = [asked.mapInArrow(_recall(uri, k, rate, digits), "query_id string, rank int, memory_id string, item_id string, similarity double, score double") for uri in shards]
    return _merged(parts, ["query_id"], k, ("item_id", "memory_id"))


def _label_side(shard: pa.Table | None) -> tuple[np.ndarray, dict[str, slice]] | None:
    if shard is None or not shard.num_rows:
        return None
    labels = np.array(shard.column("item_id").to_pylist(), object)
    start = np.flatnonzero(np.r_[True, labels[1:] != labels[:-1]])
    return _units(_matrix(shard.column("context_vector").combine_chunks())), {labels[a]: slice(a, b) for a, b in zip(start, np.r_[start[1:], len(labels)], strict=True)}


def _label_best(uri: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            side = held(uri, _label_side)
            if side is None or not batch.num_rows:
                continue
            units, places = side
            asked, labels = _units(_matrix(batch.column(2))), pc.dictionary_encode(batch.column(1), null_encoding="encode")
            best, code = np.full(batch.num_rows, np.nan), labels.indices.to_numpy(zero_copy_only=False)
            order = np.argsort(code, kind="stable")
            edges = np.searchsorted(code[order], np.arange(len(labels.dictionary) + 1))
            for at, label in enumerate(labels.dictionary.to_pylist()):
                if label not in places:
                    continue
                own, rows = order[edges[at] : edges[at + 1]], units[places[label]]
                step = max(1, BLOCK_SCORES // len(rows))
                for i in range(0, len(own), step):
                    best[own[i : i + step]] = np.fmax.reduce(asked[own[i : i + step]] @ rows.T, axis=1)
            found = np.flatnonzero(~np.isnan(best))
            at = pa.array(found)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(np.clip(best[found], 0, 1))], ["query_id", "item_id", "score"])

    return run


def best_of_label(queries: DataFrame, memory: DataFrame, most: int = LIBRARY_BYTES) -> DataFrame:
    """(query_id, item_id, score): of each (query_id, item_id, vector) the best clipped cosine among that item's records.

    Records lie in shards by their id, so a popular item is in all of them; queries meet its records
    as matrices in tasks, and only a maximum of each query and shard is shuffled. Queries whose item has no record have no row.
    """
    records = keep(memory.select("item_id", "memory_id", "context_vector"), "label_records")
    r = records.agg(F.count("*").alias("n"), F.max(F.size("context_vector")).alias("dim")).first()
    shards = write_shards(records, "label_shards", r.n * (8 * (r.dim or 0) + 96), most, F.col("memory_id"), ["item_id", "memory_id"])
    discard(records)
    asked = _spread(queries.select(F.col("query_id").cast("string").alias("query_id"), F.col("item_id").cast("string").alias("item_id"), F.col("vector").cast(V.DOUBLES).alias("vector")))
    out = None
    for uri in shards:
        part = asked.mapInArrow(_label_best(uri), "query_id string, item_id string, score double")
        out = part if out is None else out.unionByName(part)
    return out if len(shards) == 1 else out.groupBy("query_id", "item_id").agg(F.max("score").alias("score"))


def first_by(table: DataFrame, group: list[str], *order: Any) -> DataFrame:
    """The first row of each group."""
    return table.withColumn("_n", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where("_n = 1").drop("_n")

