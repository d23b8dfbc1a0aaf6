"""Multi-output ridge regression with a free intercept, from distributed Gram sums."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sextant.functions import vectors as V


@dataclass(frozen=True)
class Ridge:
    """Coefficients (outputs x inputs), intercept, and the number of training rows."""

    coefficients: tuple[tuple[float, ...], ...]
    intercept: tuple[float, ...]
    rows: int

    def predict(self, v: Column) -> Column:
        """The prediction as an expression; the coefficients are literals."""
        return F.zip_with(V.apply_matrix(self.coefficients, v), F.array(*map(F.lit, self.intercept)), lambda x, b: x + b)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[object, np.ndarray] = {}
    for batch in batches:
        x, y = (np.array(batch.column(k).to_pylist(), float) for k in (1, 2))
        seeds = np.array(batch.column(0).to_pylist(), dtype=object)
        for seed in dict.fromkeys(seeds.tolist()):
            rows = seeds == seed
            z = np.c_[np.ones(int(rows.sum())), x[rows], y[rows]]
            total[seed] = total.get(seed, 0) + z.T @ z
    for seed, z in total.items():
        i, j = np.indices(z.shape)
        yield pa.RecordBatch.from_arrays([pa.array([seed] * z.size, pa.int64()), pa.array(i.ravel(), pa.int32()), pa.array(j.ravel(), pa.int32()), pa.array(z.ravel())], ["seed", "i", "j", "value"])


def gram(rows: DataFrame, x: str, y: str, seed: str | None = None) -> DataFrame:
    """(seed, i, j, value): sums of products of [1, x, y], from one matrix for each task."""
    key = F.col(seed).cast("long") if seed else F.lit(0).cast("long")
    held = rows.select(key.alias("seed"), F.col(x).cast(V.DOUBLES).alias("x"), F.col(y).cast(V.DOUBLES).alias("y")).where("x is not null and y is not null")
    parts = held.mapInArrow(_sums, "seed long, i int, j int, value double")
    return parts.groupBy("seed", "i", "j").agg(F.sum("value").alias("value"))


def solve(g: np.ndarray, inputs: int, alpha: float = 1.0) -> Ridge:
    """The ridge of a Gram matrix; the intercept isn't penalised."""
    n = g[0, 0]
    if n < 1:
        raise ValueError("no training rows")
    sx, sy = g[0, 1 : 1 + inputs], g[0, 1 + inputs :]
    xx = g[1 : 1 + inputs, 1 : 1 + inputs] - np.outer(sx, sx) / n
    xy = g[1 : 1 + inputs, 1 + inputs :] - np.outer(sx, sy) / n
    w = np.linalg.solve(xx + alpha * np.eye(inputs), xy)
    b = (sy - sx @ w) / n
    return Ridge(tuple(map(tuple, w.T.tolist())), tuple(b.tolist()), int(n))


def fit(rows: DataFrame, x: str, y: str, inputs: int, alpha: float = 1.0) -> Ridge:
    """Fit on all rows; only (1 + inputs + outputs)**2 sums reach the driver."""
    return fit_each(rows.withColumn("_one", F.lit(0)), x, y, inputs, "_one", alpha)[0]


def fit_each(rows: DataFrame, x: str, y: str, inputs: int, seed: str, alpha: float = 1.0) -> dict[int, Ridge]:
    """One ridge for each value of ``seed`` in one pass."""
    cells = gram(rows, x, y, seed).collect()
    if not cells:
        raise ValueError("no training rows")
    size = max(r.i for r in cells) + 1
    grams: dict[int, np.ndarray] = {}
    for r in cells:
        grams.setdefault(r.seed, np.zeros((size, size)))[r.i, r.j] = r.value
    return {s: solve(g, inputs, alpha) for s, g in grams.items()}
