"""Hard negatives of anchors by angular triangle filtering (operator 11).

Components are scaled to integers (``floor(SCALE * x)``) and a score is an integer inner product, so
results are exact. Each row keeps its norm and its angles to reference directions. A direction
``r`` bounds the angle of two rows by the triangle inequality: their cosine is in ``cos(ta) cos(tv) -+
sin(ta) sin(tv)``. Reference directions are orthogonal, so the cosines add up and the product of
sines becomes that of what the directions so far leave of each row: each further direction narrows the interval.
Times both norms, and widened by ``SLACK`` for rounding, it bounds the score. The bounds are taken in
``STEPS`` (more directions for what the fewer ones leave over); only pairs whose interval overlaps the
window of scores that can still matter get an integer score.

1. Positives: the best ``POSITIVES`` other rows of an anchor's label. The window reaches from the least
   of the best scores found so far upwards.
2. Negatives: the best ``NEGATIVES`` rows of other labels between ``LOW`` and ``HIGH`` percent of a positive's
   score, for each positive. The window reaches from the least score that any of its lists still
   takes to the highest that any allows.

Rows are written in shards by hash, so no label or group of copies fills one, with their angles and
ordered by dimension and label. A task holds a shard of anchors and reads some shards of rows, one at a time; it hands on
the best rows of each anchor only, which are merged by rank. References are the leading
directions of ``REFERENCE_ROWS`` rows (those with the least hashes); they change the work, not the results.

Edge cases: rows with a null label or vector, or a component that is null or not finite (or is not when scaled), take no
part. Rows without an id are no anchors, and come last among equal scores. Rows are told apart by
their place, so a row's copies are other rows to it, and repeated anchors give repeated results.
Vectors of other dimensions have no score with an anchor; those of norm 0 (empty ones too) score 0. An anchor without
positives or negatives has no rows; a negative positive score allows none. Scores beyond 53 bits are
taken in whole numbers, those beyond a long count as its border. Empty tables give an empty result, other columns are ignored.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sextant.llm.common import keep, read_shard, table, write_shards

SCALE = 256
ANCHOR_EVERY, POSITIVES, NEGATIVES = 50, 5, 3
LOW, HIGH = 50, 95
#: Rows that the reference directions are made of.
REFERENCE_ROWS = 4096
#: Directions of each step, as shares of the dimension, and most directions.
STEPS = (0.25, 0.5, 0.75)
MOST_DIRECTIONS = 192
#: Bytes of a shard of rows and of anchors.
ROW_BYTES, ANCHOR_BYTES = 32 << 20, 4 << 20
#: Rows and anchors that are compared at once.
ROWS, ANCHORS = 1024, 256
#: Pairs that are scored at once.
PAIRS = 1 << 15
#: Error of a cosine that was stored as a 32-bit angle, and of norms, with room.
ANGLE_ERROR, SLACK = 5e-7, 1e-6
EXACT = 1 << 53
LONG = (1 << 63) - 1


def usable(embedding: Column, label: Column) -> Column:
    bad = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x * SCALE) == float("inf")))
    return label.isNotNull() & embedding.isNotNull() & ~F.coalesce(bad, F.lit(True))


def directions(sample: np.ndarray) -> np.ndarray:
    """Orthogonal reference directions (columns), those that hold most of the sample first."""
    d = sample.shape[1]
    norm = np.sqrt((sample * sample).sum(axis=1))
    units = sample[norm > 0] / norm[norm > 0, None]
    return np.linalg.eigh(units.T @ units)[1][:, ::-1][:, : min(d, MOST_DIRECTIONS)] if len(units) else np.eye(d)[:, : min(d, MOST_DIRECTIONS)]


def steps(d: int) -> list[int]:
    """Numbers of directions of each step, from 0."""
    return sorted({0, *(min(MOST_DIRECTIONS, math.floor(d * x)) for x in STEPS)})


def _described(known: dict[int, np.ndarray]):
    """Adds norm and angles to (vec_id, label, vector)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            size = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(float)
            at = np.r_[0, np.cumsum(size)]
            norms, angles = np.zeros(len(size)), [b""] * len(size)
            for d in np.unique(size):
                own = np.flatnonzero(size == d)
                x = flat[at[own][:, None] + np.arange(d)]
                top = np.abs(x).max(axis=1, initial=0)
                scaled = x / np.where(top > 0, top, 1)[:, None]  # no square overflows
                n = np.sqrt((scaled * scaled).sum(axis=1))
                norms[own] = n * top
                r = known.get(int(d))
                r = np.eye(d)[:, : steps(d)[-1]] if r is None else r[:, : steps(d)[-1]]
                cos = np.clip((scaled / np.where(n > 0, n, 1)[:, None]) @ r, -1, 1)
                for k, a in zip(own, np.arccos(cos).astype(np.float32), strict=True):
                    angles[k] = a.tobytes()
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(3)), pa.array(size, pa.int32()), pa.array(norms), pa.array(angles, pa.binary())], ["vec_id", "label", "vector", "dim", "norm", "angles"])

    return run


class Side:
    """Rows of one dimension, in order of label."""

    def __init__(self, rows: pa.Table, d: int):
        self.no = rows.column("no").to_numpy()
        self.label = rows.column("label").to_numpy()
        none = rows.column("vec_id").is_null().to_numpy()
        self.none, self.id = none, rows.column("vec_id").fill_null(0).to_numpy()
        flat = rows.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        self.vector = flat.astype(float).reshape(len(rows), d)
        self.largest = float(np.abs(self.vector).max(initial=0))
        self.norm = rows.column("norm").to_numpy()
        angles = np.frombuffer(b"".join(rows.column("angles").to_pylist()), np.float32)
        self.cos = np.cos(angles.astype(float)).reshape(len(rows), steps(d)[-1])
        self.d = d
        # what the directions of a step leave of each row, with the error of stored angles
        squares = np.cumsum(np.c_[np.zeros(len(rows)), self.cos**2], axis=1)
        self.left = {k: np.sqrt(np.maximum(0, 1 - squares[:, k]) + error(k)) for k in steps(d)}


def error(k: int) -> float:
    """Most that k stored angles add to a sum of products of their cosines."""
    return ANGLE_ERROR * 2 * (math.sqrt(k) + 1)


def bounds(a: Side, i: np.ndarray, v: Side, j: slice, low: np.ndarray, high: np.ndarray, alive: np.ndarray) -> np.ndarray:
    """Of the ``alive`` pairs of anchors ``i`` and rows ``j``, those whose score interval overlaps low to high of the anchor."""
    size = a.norm[i][:, None] * v.norm[j][None, :]
    total = np.zeros(size.shape)
    at = steps(a.d)
    for start, end in zip([0, *at], at, strict=False):
        total += a.cos[i, start:end] @ v.cos[j, start:end].T
        rest = a.left[end][i][:, None] * v.left[end][j][None, :] + error(end) + SLACK
        alive &= ((total + rest) * size >= low[:, None] - 1) & ((total - rest) * size <= high[:, None] + 1)
        if not alive.any():
            break
    return alive


def scores(a: Side, i: np.ndarray, v: Side, j: np.ndarray) -> np.ndarray:
    """Integer inner products of pairs of rows."""
    most = a.d * a.largest * v.largest
    if most < EXACT:
        return np.concatenate([np.einsum("ij,ij->i", a.vector[i[k : k + PAIRS]], v.vector[j[k : k + PAIRS]]) for k in range(0, len(i), PAIRS)] or [np.zeros(0)]).astype(np.int64)
    whole = (sum(int(x) * int(y) for x, y in zip(a.vector[p], v.vector[q], strict=True)) for p, q in zip(i, j, strict=True))
    return np.array([min(max(x, -LONG - 1), LONG) for x in whole], np.int64)


class Best:
    """The best rows of some lists: by score descending, then id (none last)."""

    def __init__(self, lists: int, most: int):
        self.most = most
        self.list = self.score = self.id = self.none = np.zeros(0, np.int64)
        #: Least score that each list still takes.
        self.least = np.full(lists, -LONG - 1, np.int64)

    def add(self, which: np.ndarray, score: np.ndarray, ids: np.ndarray, none: np.ndarray) -> None:
        fits = score >= self.least[which]
        if not fits.any():
            return
        which, score, ids, none = (np.concatenate([x, y[fits]]) for x, y in ((self.list, which), (self.score, score), (self.id, ids), (self.none, none.astype(np.int64))))
        order = np.lexsort((ids, none, np.invert(score), which))
        which = which[order]
        first = np.flatnonzero(np.r_[True, which[1:] != which[:-1]])
        place = np.arange(len(which)) - np.repeat(first, np.diff(np.r_[first, len(which)]))
        kept = order[place < self.most]
        full = place == self.most - 1
        self.least[which[full]] = score[order[full]]
        self.list, self.score, self.id, self.none = which[place < self.most], score[kept], ids[kept], none[kept]


def sides(shard: pa.Table | None) -> dict[int, Side]:
    if shard is None:
        return {}
    d = shard.column("dim").to_numpy()
    return {int(x): Side(shard.filter(pa.array(d == x)), int(x)) for x in np.unique(d)}


NAMES = ["anchor", "list", "score", "id", "pairs", "scored"]
KINDS = [pa.int64(), pa.int32(), *[pa.int64()] * 4]


def _units(folder_rows: str, folder_anchors: str, search):
    """(anchor, list, score, id) and the numbers of pairs and of scores of units of (shard of anchors, first and last shard of rows)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for which, start, stop in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                shard = read_shard(f"{folder_anchors}/shard={which}")
                anchors = sides(shard)
                made = {d: search(a, shard) for d, a in anchors.items()}
                for k in range(start, stop):
                    rows = sides(read_shard(f"{folder_rows}/shard={k}")) if anchors else {}
                    for d in anchors.keys() & rows.keys():
                        made[d].meet(rows[d])
                for d, m in made.items():
                    b = m.best
                    ids = pa.array(b.id, pa.int64(), mask=b.none.astype(bool))
                    none = pa.nulls(len(b.list), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(anchors[d].no[b.list // m.lists], pa.int64()), pa.array(b.list % m.lists, pa.int32()), pa.array(b.score, pa.int64()), ids, none, none], NAMES)
                    yield pa.RecordBatch.from_pylist([{"pairs": m.pairs, "scored": m.scored}], pa.schema(list(zip(NAMES, KINDS, strict=True))))

    return run


def _blocks(first: int, last: int) -> Iterator[slice]:
    """Ranges of rows, small ones first: windows are wide until lists are full."""
    size = ROWS // 16
    while first < last:
        yield slice(first, min(first + size, last))
        first, size = first + size, min(2 * size, ROWS)


class Positives:
    """The best rows of each anchor's own label."""

    lists = 1

    def __init__(self, a: Side, shard: pa.Table, most: int):
        self.a, self.best, self.pairs, self.scored = a, Best(len(a.no), most), 0, 0

    def meet(self, v: Side) -> None:
        for label in np.intersect1d(self.a.label, v.label):
            first, last = np.searchsorted(v.label, label), np.searchsorted(v.label, label, "right")
            own = np.flatnonzero(self.a.label == label)
            for k in range(0, len(own), ANCHORS):
                i = own[k : k + ANCHORS]
                for part in _blocks(first, last):
                    other = self.a.no[i][:, None] != v.no[part][None, :]
                    self.pairs += int(other.sum())
                    p, q = np.nonzero(bounds(self.a, i, v, part, self.best.least[i].astype(float), np.full(len(i), np.inf), other))
                    self.scored += len(p)
                    p, q = i[p], q + part.start
                    self.best.add(p, scores(self.a, p, v, q), v.id[q], v.none[q])


class Negatives:
    """The best rows of other labels in the window of each positive of an anchor."""

    def __init__(self, a: Side, shard: pa.Table, most: int, positives: int, low: int, high: int):
        self.a, self.lists, self.pairs, self.scored = a, positives, 0, 0
        self.best = Best(len(a.no) * positives, most)
        held = shard.filter(pa.array(shard.column("dim").to_numpy() == a.d)).column("scores").to_pylist()
        # no list: from the greatest number down to the least
        self.low, self.high = np.full((len(a.no), positives), LONG), np.full((len(a.no), positives), -LONG - 1)
        for k, own in enumerate(held):
            self.low[k, : len(own)] = [-(-low * x // 100) for x in own]
            self.high[k, : len(own)] = [high * x // 100 for x in own]

    def meet(self, v: Side) -> None:
        for k in range(0, len(self.a.no), ANCHORS):
            i = np.arange(k, min(k + ANCHORS, len(self.a.no)))
            for part in _blocks(0, len(v.no)):
                other = self.a.label[i][:, None] != v.label[part][None, :]
                self.pairs += int(other.sum())
                least = np.maximum(self.low[i], self.best.least.reshape(-1, self.lists)[i])
                open_ = self.low[i] <= self.high[i]
                low = np.where(open_, least.astype(float), np.inf).min(axis=1)
                high = np.where(open_, self.high[i].astype(float), -np.inf).max(axis=1)
                p, q = np.nonzero(bounds(self.a, i, v, part, low, high, other))
                self.scored += len(p)
                p, q = i[p], q + part.start
                found = scores(self.a, p, v, q)
                for n in range(self.lists):
                    fits = (self.low[p, n] <= found) & (found <= self.high[p, n])
                    self.best.add(p[fits] * self.lists + n, found[fits], v.id[q[fits]], v.none[q[fits]])


def _ranked(found: DataFrame, most: int, *group: str) -> DataFrame:
    order = Window.partitionBy(*group).orderBy(F.col("score").desc(), F.col("id").asc_nulls_last())
    return found.where("anchor is not null").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def mine(
    rows: DataFrame, every: int = ANCHOR_EVERY, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, row_bytes: int = ROW_BYTES, anchor_bytes: int = ANCHOR_BYTES
) -> tuple[DataFrame, DataFrame]:
    """Hard negatives of (vec_id, embedding, label), and how many pairs there were and were scored.

    (anchor_id, positive_id, rank, negative_id, positive_score, negative_score) and (stage, pairs, scored).
    """
    spark = rows.sparkSession
    held = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("e"))
    held = held.where(usable(F.col("e"), F.col("label")))
    # floor of a double as a double: no border of a long
    scaled = F.transform("e", lambda x: F.rint(x * SCALE) - F.when(F.rint(x * SCALE) > x * SCALE, 1.0).otherwise(0.0))
    held = held.select("vec_id", "label", scaled.alias("vector"))
    sample = held.select("vector").orderBy(F.xxhash64("vector"), F.xxhash64("vec_id", "vector")).limit(REFERENCE_ROWS).collect()
    by_size: dict[int, list] = {}
    for r in sample:
        by_size.setdefault(len(r.vector), []).append(r.vector)
    known = {d: directions(np.array(x)) for d, x in by_size.items() if d}
    schema = "vec_id long, label long, vector array<double>, dim int, norm double, angles binary"
    described = keep(held.mapInArrow(_described(known), schema).withColumn("no", F.monotonically_increasing_id()), "described")

    size = lambda t: t.agg(F.count("*"), F.coalesce(F.sum(F.col("dim") * 8 + F.octet_length("angles") + 64), F.lit(0))).first()
    cores = spark.sparkContext.defaultParallelism
    asked = described.where((F.col("vec_id") % every) == 0)
    (n, total), (m, anchors_total) = size(described), size(asked)
    row_shards = max(math.ceil(total / row_bytes), min(2 * cores, math.ceil(n / ROWS)), 1)
    row_folder = write_shards(described, "negative_rows", total, max(1, math.ceil(total / row_shards)), F.col("no"), ["dim", "label", "no"])
    row_shards, row_folder = len(row_folder), row_folder[0].rpartition("/")[0]

    def searched(anchors: DataFrame, name: str, search) -> DataFrame:
        uris = write_shards(anchors, name, anchors_total, anchor_bytes, F.col("no"), ["dim", "label", "no"])
        run = max(1, row_shards * len(uris) // (4 * cores))
        spans = math.ceil(row_shards / run)
        units = spark.range(0, len(uris) * spans, 1, min(len(uris) * spans, 10_000)).select(
            F.expr(f"cast(id div {spans} as int)").alias("anchors"), F.expr(f"cast(id % {spans} * {run} as int)").alias("start"), F.expr(f"cast(least(id % {spans} * {run} + {run}, {row_shards}) as int)").alias("stop")
        )
        found = units.mapInArrow(_units(row_folder, uris[0].rpartition("/")[0], search), "anchor long, list int, score long, id long, pairs long, scored long")
        return keep(found, name)

    first = searched(asked, "positives", functools.partial(Positives, most=positives))
    best = _ranked(first, positives, "anchor").groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("rank", "id", "score"))).alias("x"))
    best = keep(best.select(F.col("anchor").alias("no"), F.transform("x", lambda x: x["score"]).alias("scores"), F.transform("x", lambda x: x["id"]).alias("ids")), "best_positives")
    second = searched(asked.join(best.select("no", "scores"), "no"), "negatives", functools.partial(Negatives, most=negatives, positives=positives, low=low, high=high))
    named = asked.select("no", F.col("vec_id").alias("anchor_id")).join(best, "no")
    out = _ranked(second, negatives, "anchor", "list").join(named, F.col("anchor") == F.col("no"))
    at = F.col("list") + 1
    out = out.select("anchor_id", F.element_at("ids", at).alias("positive_id"), "rank", F.col("id").alias("negative_id"), F.element_at("scores", at).alias("positive_score"), F.col("score").alias("negative_score"))
    work = first.withColumn("stage", F.lit("positives")).unionByName(second.withColumn("stage", F.lit("negatives")))
    return out, work.groupBy("stage").agg(F.sum("pairs").alias("pairs"), F.sum("scored").alias("scored"))


def labelled(rows: DataFrame, wrong_every: int = 7, labels: int = 10) -> DataFrame:
    """The rows with another label where vec_id is divisible by ``wrong_every``."""
    moved = F.when((F.col("vec_id") % wrong_every) == 0, (F.col("label") + 1) % labels).otherwise(F.col("label"))
    return rows.select("vec_id", "embedding", moved.alias("label"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine(labelled(table(spark, sf_dir, "embeddings")))[0]


SQL = """
WITH e AS (SELECT row_number() OVER () AS no, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.no AS a, a.vec_id AS anchor_id, b.no AS b, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM e a JOIN e b ON a.vec_id % 50 = 0 AND len(a.v) = len(b.v) AND a.no <> b.no),
p AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, vec_id NULLS LAST, b) AS place FROM s WHERE same QUALIFY place <= 5),
n AS (SELECT p.anchor_id, p.vec_id AS positive_id, p.place, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
  row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.vec_id NULLS LAST, s.b) AS rank
  FROM p JOIN s ON s.a = p.a AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""
