"""Keyed permutations of 0 to n - 1 whose images are found one by one.

A number is a pair (left, right) below (a, b), where a * b is n or slightly more. Rounds add a
hash of one part to the other, modulo its border, so each round can be undone and all rounds are a
permutation of the pairs. Images of n and above are passed over, as in cycle walking; at most
a * b - n numbers have one, so the first k + a * b - n of them hold k images whatever the key. All of it is
built-in expressions on the row of the key: the cost is that of k numbers, whatever n is.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

ROUNDS = 6


def sides(n: int) -> tuple[int, int]:
    """(a, b): of the sides near the square root, those with the least above n."""
    root = math.isqrt(max(n, 1) - 1) + 1
    return min(((a, -(-n // a)) for a in range(root, root + root // 4 + 1)), key=lambda x: (x[0] * x[1], x[0]))


def _hash(seed: int, key: Column, step: Column, x: Column) -> Column:
    digest = F.sha2(F.concat_ws(":", F.lit(str(seed)), key, step.cast("string"), x.cast("string")), 256)
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def image(x: Column, key: Column, seed: int, a: int, b: int) -> Column:
    """The image of a number below a * b."""
    start = F.struct(F.floor(x / b).cast("long").alias("l"), (x % b).cast("long").alias("r"))

    def step(s: Column, k: Column) -> Column:
        left = F.when(k % 2 == 0, (s["l"] + _hash(seed, key, k, s["r"])) % a).otherwise(s["l"])
        right = F.when(k % 2 == 1, (s["r"] + _hash(seed, key, k, s["l"])) % b).otherwise(s["r"])
        return F.struct(left.alias("l"), right.alias("r"))

    return F.aggregate(F.array(*(F.lit(k) for k in range(ROUNDS))), start, step, lambda s: s["l"] * b + s["r"])


def first(k: int, n: int, key: Column, seed: int) -> Column:
    """The first k (or n, if fewer) different numbers below n of the key's permutation, as an array."""
    k = min(k, n)
    if not k:
        return F.array().cast("array<bigint>")
    a, b = sides(n)
    numbers = F.sequence(F.lit(0).cast("long"), F.lit(k + a * b - n - 1).cast("long"))
    return F.slice(F.filter(F.transform(numbers, lambda x: image(x, key, seed, a, b)), lambda x: x < n), 1, k)


def image_sql(x: str, key: str, seed: int, a: str = "a", b: str = "b") -> str:
    """``image`` in DuckDB."""
    mixed = f"CAST('0x' || substr(sha256(concat_ws(':', '{seed}', {key}, e.k, {{}})), 1, 15) AS BIGINT)"
    steps = ", ".join([f"{{'l': CAST({x} // {b} AS BIGINT), 'r': CAST({x} % {b} AS BIGINT), 'k': -1}}", *(f"{{'l': 0::BIGINT, 'r': 0::BIGINT, 'k': {k}}}" for k in range(ROUNDS))])
    reduced = f"list_reduce([{steps}], lambda s, e: {{'l': CASE WHEN e.k % 2 = 0 THEN (s.l + {mixed.format('s.r')}) % {a} ELSE s.l END, 'r': CASE WHEN e.k % 2 = 1 THEN (s.r + {mixed.format('s.l')}) % {b} ELSE s.r END, 'k': e.k}})"
    return f"({reduced}).l * {b} + ({reduced}).r"


def sides_sql(table: str) -> str:
    """(n, a, b) of a table's rows in DuckDB."""
    root = "CAST(ceil(sqrt(n)) AS BIGINT)"
    return f"(SELECT n, a, CAST(ceil(n / a) AS BIGINT) AS b FROM (SELECT n, unnest(range({root}, {root} + {root} // 4 + 1)) AS a FROM (SELECT count(*) AS n FROM {table})) ORDER BY a * ceil(n / a), a LIMIT 1)"
