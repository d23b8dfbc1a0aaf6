"""What several corpus operators share: table access, shared storage, vectorised words.

Words are the maximal runs of bytes other than space, \\t, \\n, \\v, \\f and \\r. They are hashed
straight from Arrow's UTF-8 buffers with NumPy, so no Python string is made for a word.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sextant.sources.scratch import discard, held, keep, new_folder, qualified, read_shard, sizes, write_shards  # noqa: F401

#: Bytes of text that are tokenised at once; longer texts go alone.
SLICE_BYTES = 1 << 20
#: Most bytes of a table that is broadcast.
BROADCAST_BYTES = 32 << 20
WHITE_SPACE = " \t\n\r\x0b\x0c"

_U = np.uint64
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(WHITE_SPACE.encode())] = True
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
_LOWER_BYTE = _BYTE.copy()
_LOWER_BYTE[65:91] = _BYTE[97:123]
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_POSITION = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) | _U(1)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` (a written table), marked for broadcast if its measured size is at most ``most`` bytes.

    Beyond that the join shuffles both sides, and Spark splits skewed parts.
    """
    text = [F.coalesce(F.octet_length(f.name), F.lit(0)) for f in df.schema if f.dataType.simpleString() in ("string", "binary")]
    row = sum(text, F.lit(16 * (len(df.columns) + 1)))
    size = df.agg(F.coalesce(F.sum(row), F.lit(0))).first()[0]
    return F.broadcast(df) if size <= most else df.hint("merge")


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _BASE_INVERSE)):
            steps = np.full(max(n, SLICE_BYTES + 1), base, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a string array; null counts as empty."""
    if pa.types.is_large_string(column.type) or column.null_count:
        column = pa.array(["" if x is None else x for x in column.to_pylist()], pa.large_string())
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    if not len(column) or offsets is None:
        return np.zeros(len(column) + 1, np.int64), np.zeros(0, np.uint8)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return at, np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)


def slices(at: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows with at most ``most`` bytes, or one row."""
    k, n = 0, len(at) - 1
    while k < n:
        end = max(k + 1, int(np.searchsorted(at, at[k] + most, "right")) - 1)
        yield k, min(end, n)
        k = end


def _hash_words(begin: np.ndarray, data: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first bytes) of the words of texts that begin at ``begin``."""
    n = len(data)
    space = _IS_SPACE[data]
    edge = np.empty(n + 1, bool)  # a word can't go on over this byte's left side
    edge[0] = edge[n] = True
    edge[1:n] = space[:-1]
    after = np.empty(n, bool)
    after[:] = False
    after[:-1] = space[1:]
    if n:
        after[-1] = True
    inner = begin[(begin > 0) & (begin < n)]
    edge[inner] = True
    after[inner - 1] = True
    word = ~space
    start = np.flatnonzero(word & edge[:n])
    stop = np.flatnonzero(word & after) + 1
    power, inverse = _power(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((_LOWER_BYTE if lower else _BYTE)[data] * power[:n], out=total[1:])
    return mix((total[stop] - total[start]) * inverse[start]), start


class Words:
    """Words of some texts: ``hash`` (uint64) in order, ``first[i]:first[i+1]`` those of text i.

    A text beyond ``SLICE_BYTES`` is hashed piece by piece, cut where white space is.
    """

    def __init__(self, at: np.ndarray, data: np.ndarray, lower: bool = True):
        begin = at - at[0]
        data = data[at[0] : at[-1]]
        if len(at) == 2 and len(data) > 2 * SLICE_BYTES:
            cuts = [0]
            while cuts[-1] < len(data):
                k = cuts[-1] + SLICE_BYTES
                while k < len(data) and not (space := _IS_SPACE[data[k : k + SLICE_BYTES]]).any():
                    k += SLICE_BYTES
                cuts.append(min(len(data), k + int(space.argmax())) if k < len(data) else len(data))
            self.hash = np.concatenate([_hash_words(np.array([0, j - i]), data[i:j], lower)[0] for i, j in itertools.pairwise(cuts)])
            self.first = np.array([0, len(self.hash)])
        else:
            self.hash, start = _hash_words(begin, data, lower)
            self.first = np.searchsorted(start, begin)

    def __len__(self) -> int:
        return len(self.hash)


def windows(words: np.ndarray, n: int) -> np.ndarray:
    """64-bit hashes of each run of n word hashes (over borders of texts too)."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(m, np.uint64)
    for k in range(n):
        out += words[k : k + m] * _POSITION[k]
    return mix(out + _U(n))


def shingle_set(words: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct hashes of the n-word shingles of one text; a shorter text is one shingle."""
    if not len(words):
        return np.zeros(0, np.uint64)
    return np.unique(windows(words, min(n, len(words))))
