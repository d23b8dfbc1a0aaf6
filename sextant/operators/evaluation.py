"""Graded distribution shift, paired contrasts, bootstrap intervals and shift diagnostics."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sextant.functions import scalars as S
from sextant.functions import vectors as V
from sextant.operators import ridge
from sextant.operators.ranks import numbered
from sextant.sources.scratch import held, keep, read_shard, write_shards

# Tiers with their strength and seed, and the contrasts between them.
TIERS = (("mild", 0.25, 7001), ("moderate", 0.50, 8001), ("severe", 1.0, 9001))
CONTRASTS = (("mild", "moderate"), ("moderate", "severe"), ("mild", "severe"))
TIE = 1e-15
RESAMPLES, SEED = 10_000, 4242
MODALITIES = ("text", "image", "audio")


def tiers(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(TIERS), "tier string, strength double, tier_seed int")


def pair_problems(identity: DataFrame, severe: DataFrame) -> DataFrame:
    """(latent_event_id, problem) where identity and severe observation can't be blended."""
    a = identity.select("latent_event_id", *(F.col(c).alias(f"a_{c}") for c in ("template_id", "target_item_id", "target_family_id")), *(F.size(f"{m}_vector").alias(f"a_{m}") for m in MODALITIES), F.lit(True).alias("a"))
    b = severe.select("latent_event_id", *(F.col(c).alias(f"b_{c}") for c in ("template_id", "target_item_id", "target_family_id")), *(F.size(f"{m}_vector").alias(f"b_{m}") for m in MODALITIES), F.lit(True).alias("b"))
    joined = a.join(b, "latent_event_id", "full")
    differ = lambda c: ~F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}"))
    both = F.col("a").isNotNull() & F.col("b").isNotNull()
    problem = F.array_compact(F.array(
        F.when(~both, "unpaired"), F.when(both & differ("target_item_id"), "target differs"), F.when(both & differ("target_family_id"), "family differs"),
        F.when(both & differ("template_id"), "template differs"), F.when(both & (differ("text") | differ("image") | differ("audio")), "dimensions differ"),
    ))
    return joined.select("latent_event_id", F.explode(problem).alias("problem"))


def views(pairs: DataFrame) -> DataFrame:
    """Three views of each pair (id_*, sev_* vectors): the blend at each tier's strength."""
    graded = pairs.crossJoin(F.broadcast(tiers(pairs.sparkSession)))  # three fixed rows
    blended = (V.blend(F.col(f"id_{m}"), F.col(f"sev_{m}"), F.col("strength")).alias(f"{m}_vector") for m in MODALITIES)
    return graded.select("latent_event_id", S.observed_id(F.col("latent_event_id"), F.col("tier")).alias("observed_event_id"), "tier", "strength", "tier_seed", "template_id", "target_item_id", "target_family_id", *blended)


def view_problems(graded: DataFrame) -> DataFrame:
    """(latent_event_id, problem) of latent events that lack a tier or mix targets; repeated observed ids."""
    names = F.array(*(F.lit(t) for t, _, _ in TIERS))
    per = graded.groupBy("latent_event_id").agg(F.count("*").alias("n"), F.sort_array(F.collect_set("tier")).alias("tiers"), F.countDistinct("target_item_id", "target_family_id", "template_id").alias("labels"), F.countDistinct("observed_event_id").alias("ids"))
    problem = F.array_compact(F.array(F.when(F.col("n") != len(TIERS), "number of views"), F.when(F.col("tiers") != F.sort_array(names), "tiers"), F.when(F.col("labels") != 1, "labels differ"), F.when(F.col("ids") != F.col("n"), "repeated observed id")))
    return per.select("latent_event_id", F.explode(problem).alias("problem"))


def as_events(graded: DataFrame, split: str = "ood_test") -> DataFrame:
    return graded.select(F.col("observed_event_id").alias("event_id"), F.lit(split).alias("split"), "template_id", "target_item_id", "target_family_id", *(f"{m}_vector" for m in MODALITIES))


def displaced(events: DataFrame, at: str, days: list[int]) -> DataFrame:
    """Each event at each displaced time."""
    return events.withColumn("day", F.explode(F.array(*map(F.lit, days)))).withColumn("as_of", F.col(at) + F.make_dt_interval(F.col("day")))


def vector_differences(a: DataFrame, b: DataFrame, columns: list[str], digits: int = 9) -> DataFrame:
    """Rows of either side that the other lacks, vectors rounded; both empty means equal."""
    held = lambda d: d.select(*(V.rounded(F.col(c), digits).alias(c) if "array" in d.schema[c].dataType.simpleString() else F.col(c) for c in columns))
    x, y = held(a), held(b)
    return x.exceptAll(y).withColumn("side", F.lit("first")).unionByName(y.exceptAll(x).withColumn("side", F.lit("second")))


def paired(per_query: DataFrame) -> DataFrame:
    """(ranker, contrast, latent_event_id, difference) for each contrast of tiers.

    per_query: (ranker, tier, latent_event_id, rr); tiers become columns, so nothing is joined.
    """
    wide = per_query.groupBy("ranker", "latent_event_id").pivot("tier", [t for t, _, _ in TIERS]).agg(F.first("rr"))
    each = F.explode(F.array(*(F.struct(F.lit(f"{a}_minus_{b}").alias("contrast"), (F.col(a) - F.col(b)).alias("difference")) for a, b in CONTRASTS)))
    return wide.select("ranker", "latent_event_id", each.alias("c")).select("ranker", "c.contrast", "latent_event_id", "c.difference")


def unpaired(per_query: DataFrame) -> DataFrame:
    """(ranker, latent_event_id) that don't occur once in every tier."""
    return per_query.groupBy("ranker", "latent_event_id").agg(F.count("*").alias("n"), F.countDistinct("tier").alias("tiers")).where(f"n <> {len(TIERS)} or tiers <> {len(TIERS)}").select("ranker", "latent_event_id")


def contrasts(differences: DataFrame, digits: int | None = None) -> DataFrame:
    """(ranker, contrast, n, mean_diff, sd_diff, better, tied, worse)."""
    r = (lambda c: F.round(c, digits)) if digits is not None else (lambda c: c)
    d = F.col("difference")
    return differences.groupBy("ranker", "contrast").agg(
        F.count("*").alias("n"), r(F.avg(d)).alias("mean_diff"), r(F.stddev_samp(d)).alias("sd_diff"), F.count_if(d > TIE).alias("better"), F.count_if(F.abs(d) <= TIE).alias("tied"), F.count_if(d < -TIE).alias("worse")
    )


def resample_means(values: np.ndarray, resamples: int = RESAMPLES, seed: int = SEED, rows: int = 256) -> np.ndarray:
    """Means of ``resamples`` draws with replacement, drawn in chunks from one generator."""
    generator = np.random.default_rng(seed)
    return np.concatenate([values[generator.integers(0, len(values), (min(rows, resamples - i), len(values)))].mean(axis=1) for i in range(0, resamples, rows)])


def bootstrap(differences: DataFrame, keys: list[str], value: str = "difference", unit: str = "latent_event_id", resamples: int = RESAMPLES, seed: int = SEED) -> DataFrame:
    """(keys, n, ci_lower, ci_upper): 95 percent percentile intervals of the mean.

    Each group's values meet in one task, in order of unit: meant for evaluation sets. For groups
    of any size, see ``bootstrap_poisson``.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        means = resample_means(pdf.sort_values(unit)[value].to_numpy(float), resamples, seed)
        low, high = np.percentile(means, [2.5, 97.5])
        return pd.DataFrame({**{k: [pdf[k].iloc[0]] for k in keys}, "n": [len(pdf)], "ci_lower": [low], "ci_upper": [high]})

    kinds = ", ".join(f"{k} {differences.schema[k].dataType.simpleString()}" for k in keys)
    return differences.select(*keys, unit, F.col(value).cast("double").alias(value)).groupBy(*keys).applyInPandas(run, f"{kinds}, n long, ci_lower double, ci_upper double")


#: Where the Poisson(1) distribution passes each count, in steps of 2**-32: a weight is the number of these at or below a draw.
POISSON = tuple(int(sum(math.exp(-1) / math.factorial(k) for k in range(n + 1)) * (1 << 32)) for n in range(13))


def bootstrap_poisson(differences: DataFrame, keys: list[str], value: str = "difference", unit: str = "latent_event_id", resamples: int = 1000, seed: int = SEED) -> DataFrame:
    """The same intervals for groups of any size: each unit has a Poisson(1) weight in each resample.

    A hash of (seed, block, unit) gives the draws of eight resamples, so sums are taken where the
    rows lie and don't depend on partitions.
    """
    h = F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col("j").cast("string"), F.col(unit).cast("string")), 256)
    each = differences.select(*keys, unit, F.col(value).cast("double").alias("d"), F.explode(F.sequence(F.lit(0), F.lit(-(-resamples // 8) - 1))).alias("j")).withColumn("h", h)
    draw = lambda i: F.conv(F.substring("h", 8 * i + 1, 8), 16, 10).cast("long")
    weight = lambda x: F.size(F.filter(F.array(*map(F.lit, POISSON)), lambda t: t <= x))
    weights = [weight(draw(i)).alias(f"w{i}") for i in range(8)]
    sums = each.select(*keys, "j", "d", *weights).groupBy(*keys, "j").agg(F.count("*").alias("n"), *(x for i in range(8) for x in (F.sum(f"w{i}").alias(f"w{i}"), F.sum(F.col(f"w{i}") * F.col("d")).alias(f"s{i}"))))
    means = sums.select(*keys, "n", F.explode(F.array(*(F.struct((8 * F.col("j") + i).alias("b"), F.try_divide(f"s{i}", f"w{i}").alias("mean")) for i in range(8)))).alias("x")).where(F.col("x.b") < resamples)
    return means.groupBy(*keys).agg(F.max("n").alias("n"), F.percentile("x.mean", F.lit(0.025)).alias("ci_lower"), F.percentile("x.mean", F.lit(0.975)).alias("ci_upper"))


def bootstrap_hashed(differences: DataFrame, keys: list[str], value: str = "difference", unit: str = "latent_event_id", resamples: int = 20, seed: int = SEED) -> DataFrame:
    """Means of resamples whose draws are hashes of (seed, resample, draw), which SQL can repeat.

    Units are numbered by ranges with offsets, so a group may be of any size.
    """
    each = numbered(differences.select(*keys, unit, value), keys, [unit], name="i").select(*keys, (F.col("i") - 1).alias("i"), value)
    sizes = each.groupBy(*keys).agg(F.count("*").alias("n"))
    draws = sizes.select(*keys, "n", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))).alias("b")).select(*keys, "n", "b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("draw"))
    prefix = F.substring(F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col("b").cast("string"), F.col("draw").cast("string")), 256), 1, 8)
    draws = draws.withColumn("i", F.conv(prefix, 16, 10).cast("long") % F.col("n"))
    return draws.join(each, [*keys, "i"]).groupBy(*keys, "b").agg(F.avg(value).alias("mean"))


def moments(rows: DataFrame, vector: str, by: str, values: list[str]) -> dict[str, tuple[int, np.ndarray, np.ndarray]]:
    """(n, mean, sample covariance) of each value of ``by`` that has rows, from one matrix of sums for each task."""
    seed = F.coalesce(*(F.when(F.col(by) == x, k) for k, x in enumerate(values)))
    cells: dict[int, dict[tuple[int, int], float]] = {}
    for r in ridge.gram(rows.where(F.col(by).isin(values)).select(seed.alias("k"), F.col(vector).alias("x"), F.array().cast(V.DOUBLES).alias("y")), "x", "y", "k").collect():  # (dim + 1) ** 2 sums
        cells.setdefault(r.seed, {})[r.i, r.j] = r.value
    out = {}
    for k, found in cells.items():
        size = max(i for i, _ in found) + 1
        g = np.array([[found[i, j] for j in range(size)] for i in range(size)])
        n, mean = int(g[0, 0]), g[0, 1:] / g[0, 0]
        out[values[k]] = (n, mean, (g[1:, 1:] - n * np.outer(mean, mean)) / (n - 1) if n > 1 else np.full((size - 1, size - 1), np.nan))
    return out


def shift(rows: DataFrame, vector: str, dim: int, first: str = "validation", second: str = "ood_test", digits: int = 9) -> DataFrame:
    """Mean shift (L2), covariance shift (Frobenius) and cosine of centroids of two splits, in one row; none if a split has no rows."""
    found = moments(rows, vector, "split", [first, second])
    out = []
    if len(found) == 2:
        (n, mean, cov), (m, other, spread) = found[first], found[second]
        size = float(np.linalg.norm(mean) * np.linalg.norm(other))
        gap = float(np.linalg.norm(cov - spread))
        out = [(n, m, dim, float(np.linalg.norm(mean - other)), None if math.isnan(gap) else gap, float(mean @ other) / size if size > V.EPSILON else 0.0)]
    table = rows.sparkSession.createDataFrame(out, "validation_count long, ood_count long, dim int, mean_shift_l2 double, cov_shift_fro double, centroid_cosine double")
    return table.select("validation_count", "ood_count", "dim", *(F.round(c, digits).alias(c) for c in ("mean_shift_l2", "cov_shift_fro", "centroid_cosine")))


def sign_flip_test(differences: DataFrame, keys: list[str], value: str = "difference", unit: str = "latent_event_id", permutations: int = 200, seed: int = SEED) -> DataFrame:
    """(keys, n, mean_diff, p): paired permutation test of a zero mean.

    A unit's sign in each permutation is a hash of (seed, permutation, unit), so sums are taken
    where the rows lie and don't depend on partitions. The given order counts as one permutation.
    """
    up = F.substring(F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col("b").cast("string"), F.col(unit)), 256), 1, 1) < "8"
    each = differences.select(*keys, unit, F.col(value).alias("d"), F.explode(F.sequence(F.lit(0), F.lit(permutations))).alias("b"))
    means = each.groupBy(*keys, "b").agg(F.count("*").alias("n"), F.avg(F.when((F.col("b") == 0) | up, F.col("d")).otherwise(-F.col("d"))).alias("m"))
    observed = means.where("b = 0").select(*keys, "n", F.col("m").alias("mean_diff"))
    return means.join(observed.select(*keys, "mean_diff"), keys).groupBy(*keys).agg(F.first("n").alias("n"), F.first("mean_diff").alias("mean_diff"), F.avg((F.abs("m") >= F.abs("mean_diff") - 1e-12).cast("double")).alias("p"))


def holm(tests: DataFrame, family: list[str], order: list[str], p: str = "p") -> DataFrame:
    """``p_holm``: p-values corrected for the tests of a family by Holm's step-down rule."""
    ranked = Window.partitionBy(*family).orderBy(p, *order)
    step = (F.count("*").over(Window.partitionBy(*family)) - F.row_number().over(ranked) + 1) * F.col(p)
    return tests.withColumn("_s", step).withColumn("p_holm", F.least(F.lit(1.0), F.max("_s").over(ranked.rowsBetween(Window.unboundedPreceding, 0)))).drop("_s")


#: Rows in a shard; bins of squared distances (unit vectors: 0 to 4) in each pass, and passes, that find the median.
MMD_BLOCK, MMD_BINS, MMD_TOP, MMD_PASSES = 512, 20_000, 4.0, 3
#: Permutations whose sums a task takes at once.
MMD_COLUMNS = 1024
#: Standard deviations around the expected least hash of the first side within which it is looked for.
MMD_SPREAD = 8.0


class _Shard:
    """Vectors, sides and packed signs of a shard's rows."""

    def __init__(self, rows: pa.Table | None):
        n = 0 if rows is None else rows.num_rows
        self.v = np.array(rows.column("v").to_pylist(), float) if n else np.zeros((0, 0))
        self.p = np.array(rows.column("p").to_pylist(), bool) if n else np.zeros(0, bool)
        self.bits = np.array([np.frombuffer(x, np.uint8) for x in rows.column("bits").to_pylist()]) if n and "bits" in rows.column_names else None


def _squared(a: _Shard, b: _Shard) -> np.ndarray:
    return np.maximum(0, (a.v**2).sum(1)[:, None] + (b.v**2).sum(1)[None] - 2 * a.v @ b.v.T)


def _distances(a: _Shard, b: _Shard, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances of two shards, and which kind of pair each is (0: aa, 1: bb, 2: ab); a pair counts once."""
    d = _squared(a, b)
    kind = np.where(a.p[:, None] & b.p[None], 0, np.where(~a.p[:, None] & ~b.p[None], 1, 2))
    if same:
        i, j = np.triu_indices(len(d), 1)
        return d[i, j], kind[i, j]
    return d.ravel(), kind.ravel()


def _over_pairs(spark: SparkSession, uris: list[str], each: Callable[[Iterator[tuple[_Shard, _Shard, bool]]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``each`` over all pairs of shards of a task. Tasks read the shards of the pairs dealt to them, so rows are neither copied nor shuffled."""
    n = len(uris)
    folder = uris[0].rpartition("/")[0]
    units = spark.range(0, n * n, 1, min(n * n, 4 * spark.sparkContext.defaultParallelism)).where(F.expr(f"id div {n} <= id % {n}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs() -> Iterator[tuple[_Shard, _Shard, bool]]:
            for batch in batches:
                for unit in batch.column(0).to_pylist():
                    i, j = divmod(unit, n)
                    a = held(f"{folder}/shard={i}", _Shard)
                    b = a if i == j else _Shard(read_shard(f"{folder}/shard={j}"))
                    if len(a.v) and len(b.v):
                        yield a, b, i == j

        yield from each(pairs())

    return units.mapInArrow(run, schema)


def _histogram(spans: tuple[tuple[float, float], ...]):
    """Counts of the positive distances in the bins of each (low, width)."""

    def run(pairs: Iterator[tuple[_Shard, _Shard, bool]]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((len(spans), MMD_BINS), np.int64)
        for pair in pairs:
            d = _distances(*pair)[0]
            for k, (low, width) in enumerate(spans):
                inside = d[(d > 0) & (d >= low) & ((d < low + width) | (low + width >= MMD_TOP))]
                counts[k] += np.bincount(np.minimum(((inside - low) * (MMD_BINS / width)).astype(int), MMD_BINS - 1), minlength=MMD_BINS)
        span, at = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(span, pa.int32()), pa.array(at, pa.int64()), pa.array(counts[span, at])], ["span", "bin", "n"])

    return run


def _median(spark: SparkSession, uris: list[str], passes: int) -> float:
    """The median of the positive distances of all pairs, to MMD_TOP / MMD_BINS ** passes; 1 if there is none.

    Each pass counts distances in the bins of the interval that holds the median (of both middle
    values, where their number is even); only these counts reach the driver.
    """
    spans, ranks = [(0.0, MMD_TOP)], [None]
    for _ in range(passes):

        counts = _over_pairs(spark, uris, _histogram(tuple(spans)), "span int, bin long, n long").groupBy("span", "bin").agg(F.sum("n").alias("n")).orderBy("span", "bin").collect()
        if not counts:
            return 1.0
        if ranks == [None]:
            total = sum(r.n for r in counts)
            spans, ranks = spans * 2, [(total - 1) // 2, total // 2]
            of = [0, 0]
        else:
            of = [0, 1]
        for m in (0, 1):
            low, width = spans[m]
            for r in counts:
                if r.span == of[m]:
                    if ranks[m] < r.n:
                        spans[m] = (low + r.bin * width / MMD_BINS, width / MMD_BINS)
                        break
                    ranks[m] -= r.n
    return max(sum(low + width / 2 for low, width in spans) / 2, V.EPSILON)


def _two_sides(rows: DataFrame, vector: str, first: str, second: str) -> tuple[DataFrame, int, int]:
    """(event_id, p: of the first side, v) of two splits, and the sizes of both."""
    wanted = rows.where(F.col("split").isin(first, second)).select("event_id", (F.col("split") == first).alias("p"), F.col(vector).alias("v"))
    sides = keep(wanted, "mmd_sides")
    return sides, *(int(x) for x in sides.agg(F.count_if("p"), F.count_if(~F.col("p"))).first())


def _shards(rows: DataFrame, n: int, block: int) -> list[str]:
    return write_shards(rows, "mmd_shards", n, block, F.col("event_id"), ["event_id"])


def mmd_blocked(rows: DataFrame, vector: str, first: str, second: str, block: int = MMD_BLOCK, passes: int = MMD_PASSES, digits: int | None = None) -> DataFrame:
    """(mmd2, bandwidth2): biased RBF MMD squared of two splits of unit vectors, from pairs of shards: only sums leave a task.

    The bandwidth is the median of the positive squared distances.
    """
    spark = rows.sparkSession
    sides, n_first, n_second = _two_sides(rows, vector, first, second)
    uris = _shards(sides, n_first + n_second, block)
    bandwidth = _median(spark, uris, passes)

    def kernels(pairs: Iterator[tuple[_Shard, _Shard, bool]]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(3)
        for pair in pairs:
            d, kind = _distances(*pair)
            sums += np.bincount(kind, np.exp(-d / (2 * bandwidth)), 3)
        yield pa.RecordBatch.from_arrays([pa.array([0, 1, 2], pa.int32()), pa.array(sums)], ["kind", "s"])

    s = {r.kind: r.s for r in _over_pairs(spark, uris, kernels, "kind int, s double").groupBy("kind").agg(F.sum("s").alias("s")).collect()}
    aa = (2 * s.get(0, 0.0) + n_first) / max(1, n_first**2)
    bb = (2 * s.get(1, 0.0) + n_second) / max(1, n_second**2)
    ab = s.get(2, 0.0) / max(1, n_first * n_second)
    r = (lambda x: x) if digits is None else (lambda x: round(x, digits) + 0.0)
    return spark.createDataFrame([(r(max(0.0, aa + bb - 2 * ab)), r(bandwidth))], "mmd2 double, bandwidth2 double")


def mmd_estimate(rows: DataFrame, vector: str, first: str, second: str, bandwidth2: float, features: int = 1024, seed: int = 5151) -> DataFrame:
    """(mmd2, error): the RBF MMD squared by random Fourier features, for sizes where all pairs are too many.

    One pass takes the sums of ``features`` random waves over each side; a wave's squared distance of
    the sides' means is an unbiased value of MMD squared, and ``error`` is the standard error of
    their mean. An empty side gives null.
    """
    rng_of = np.random.default_rng

    def waves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((2, 2 * features)), np.zeros(2, np.int64)
        w = None
        for batch in batches:
            v, p = np.array(batch.column(1).to_pylist(), float), np.array(batch.column(0).to_pylist(), bool)
            if not len(v):
                continue
            w = rng_of(seed).normal(size=(v.shape[1], features)) / math.sqrt(bandwidth2) if w is None else w
            x = v @ w
            waves = np.hstack([np.cos(x), np.sin(x)])
            for k in (0, 1):
                sums[k] += waves[p == (k == 0)].sum(0)
                counts[k] += (p == (k == 0)).sum()
        for k in (0, 1):
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array(counts[k : k + 1]), pa.array([sums[k]], pa.list_(pa.float64()))], ["side", "n", "s"])

    both = rows.where(F.col("split").isin(first, second)).select((F.col("split") == first).alias("p"), F.col(vector).alias("v"))
    parts = both.mapInArrow(waves, "side int, n long, s array<double>").select("side", "n", F.posexplode("s").alias("j", "x"))
    means = parts.groupBy("j").pivot("side", [0, 1]).agg(F.sum("x").alias("x"), F.sum("n").alias("n"))
    apart = means.select((F.col("j") % features).alias("j"), F.pow(F.try_divide("0_x", "0_n") - F.try_divide("1_x", "1_n"), F.lit(2)).alias("d")).groupBy("j").agg(F.sum("d").alias("d"))
    return apart.agg(F.avg("d").alias("mmd2"), (F.stddev_samp("d") / math.sqrt(features)).alias("error"))


def _prefix(seed: int, k: int, events: list[bytes]) -> np.ndarray:
    """The first 63 bits of the hashes that order events in a permutation."""
    start = hashlib.sha256(f"{seed}:{k}:".encode())
    out = np.empty(len(events), np.int64)
    for i, e in enumerate(events):
        h = start.copy()
        h.update(e)
        out[i] = int.from_bytes(h.digest()[:8], "big") >> 1
    return out


def _selected(sides: DataFrame, n_first: int, n: int, permutations: int, seed: int) -> np.ndarray:
    """The n_first-th least hash of each permutation (from 1).

    Hashes are even, so that one lies within some standard deviations of its share. Tasks hand on how
    many of their hashes are below that interval and which are inside it: about the root of n of them.
    The interval is widened until it holds all that are looked for.
    """
    share = n_first / n
    spread = MMD_SPREAD * math.sqrt(share * (1 - share) / n) + 2 / n
    out, todo = np.full(permutations + 1, -1, np.int64), list(range(1, permutations + 1))
    while todo:
        low, high = (max(0, min((1 << 63) - 1, int(x * (1 << 63)))) for x in (share - spread, share + spread))

        def inside(batches: Iterator[pa.RecordBatch], low: int = low, high: int = high, todo: tuple[int, ...] = tuple(todo)) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                events = [x.encode() for x in batch.column(0).to_pylist()]
                below, near = [], []
                for k in todo:
                    h = _prefix(seed, k, events)
                    below.append(int((h < low).sum()))
                    near.append(h[(h >= low) & (h <= high)])
                yield pa.RecordBatch.from_arrays([pa.array(todo, pa.int32()), pa.array(below, pa.int64()), pa.array(near, pa.list_(pa.int64()))], ["k", "below", "near"])

        found = sides.select("event_id").mapInArrow(inside, "k int, below long, near array<long>").groupBy("k").agg(F.sum("below").alias("below"), F.sort_array(F.flatten(F.collect_list("near"))).alias("near"))
        place = F.lit(n_first) - F.col("below")
        for r in found.select("k", F.when((place >= 1) & (place <= F.size("near")), F.element_at("near", place.cast("int"))).alias("h")).collect():
            out[r.k] = -1 if r.h is None else r.h
        todo, spread = [k for k in todo if out[k] < 0], 4 * spread
    return out


def mmd_permutation_test(rows: DataFrame, vector: str, first: str, second: str, permutations: int = 200, seed: int = 5151, block: int = MMD_BLOCK) -> DataFrame:
    """(mmd2, p): whether two splits differ more than random divisions of the same sizes.

    In each permutation the events with the least hashes of (seed, permutation, event) are the
    first side: those up to the hash that ``_selected`` finds, so nothing is sorted or numbered. Each event's sides in
    all permutations are packed bits in its shard. All divisions share one pass over pairs of
    shards; the bandwidth is that of ``mmd_blocked``. The given division counts as one permutation.
    """
    spark = rows.sparkSession
    sides, n_first, n_second = _two_sides(rows, vector, first, second)
    n = n_first + n_second
    if not n_first or not n_second:
        return spark.createDataFrame([], "mmd2 double, p double")
    edges = _selected(sides, n_first, n, permutations, seed)

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            events, p = [x.encode() for x in batch.column(0).to_pylist()], np.array(batch.column(1).to_pylist(), bool)
            packed = np.zeros((len(events), -(-(permutations + 1) // 8)), np.uint8)
            for k in range(permutations + 1):
                z = p if k == 0 else _prefix(seed, k, events) <= edges[k]
                packed[:, k // 8] |= z.astype(np.uint8) << np.uint8(7 - k % 8)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([x.tobytes() for x in packed], pa.binary())], ["event_id", "p", "v", "bits"])

    labelled = sides.mapInArrow(signed, "event_id string, p boolean, v array<double>, bits binary")
    uris = _shards(labelled, n, block)
    width = _median(spark, uris, MMD_PASSES)

    def sums(pairs: Iterator[tuple[_Shard, _Shard, bool]]) -> Iterator[pa.RecordBatch]:
        both, one, total = np.zeros(permutations + 1), np.zeros(permutations + 1), 0.0
        for a, b, same in pairs:
            kernel = np.exp(-_squared(a, b) / (2 * width))
            total += kernel.sum() * (1 if same else 2)
            for k in range(0, permutations + 1, MMD_COLUMNS):
                at = slice(k, min(k + MMD_COLUMNS, permutations + 1))
                za, zb = (np.unpackbits(x.bits[:, k // 8 : -(-at.stop // 8)], axis=1)[:, : at.stop - k].astype(float) for x in (a, b))
                both[at] += ((kernel @ zb) * za).sum(0) * (1 if same else 2)  # within the first side
                one[at] += kernel.sum(1) @ za if same else kernel.sum(1) @ za + kernel.sum(0) @ zb  # of the first side with all
        yield pa.RecordBatch.from_arrays([pa.array(range(permutations + 1), pa.int32()), pa.array(both), pa.array(one), pa.array([total] * (permutations + 1))], ["k", "aa", "a", "t"])

    s = _over_pairs(spark, uris, sums, "k int, aa double, a double, t double").groupBy("k").agg(F.sum("aa").alias("aa"), F.sum("a").alias("a"), F.sum("t").alias("t"))
    m, o = float(n_first), float(n_second)
    value = F.col("aa") / (m * m) + (F.col("t") - 2 * F.col("a") + F.col("aa")) / (o * o) - 2 * (F.col("a") - F.col("aa")) / (m * o)
    tested = keep(s.select("k", F.greatest(F.lit(0.0), value).alias("mmd2")), "mmd_tested")
    given = tested.where("k = 0").first().mmd2
    return tested.agg(F.lit(given).alias("mmd2"), F.avg((F.col("mmd2") >= given - 1e-12).cast("double")).alias("p"))


def halves(events: DataFrame) -> DataFrame:
    """``half`` even or odd by order of event_id within a split."""
    return numbered(events, ["split"], ["event_id"], name="_n").withColumn("half", F.when((F.col("_n") - 1) % 2 == 0, "even").otherwise("odd")).drop("_n")


def random_halves(events: DataFrame, seeds: list[int], fraction: float = 0.5) -> DataFrame:
    """(seed, event_id, part): for each seed round(n * fraction) events calibrate, the rest evaluate."""
    n = events.count()
    each = events.select("event_id", F.explode(F.array(*map(F.lit, seeds))).alias("seed"))
    placed = numbered(each, ["seed"], [F.sha2(F.concat_ws(":", F.col("seed").cast("string"), "event_id"), 256), "event_id"], name="_n")
    return placed.select("seed", "event_id", F.when(F.col("_n") <= F.bround(F.lit(n * fraction)), "calibration").otherwise("evaluation").alias("part"))
