"""Mixing sources to target weights (operator 6).

A source's weight is its token share to the power of an exponent: 1 keeps the shares, 0 makes
the sources equal. The exponent is the largest that brings the entropy of the weights to
``ENTROPY`` of its maximum; if that repeats some source more than ``REPEATS`` times, it is the
smallest that doesn't. Both are found by bisection at once, many exponents in each aggregate, so
the table of sources never leaves Spark.

The weights are realised to a token budget. Each pass over a source is a permutation of its
blocks and of the documents in each block, both keyed by hashes; a source gets as many whole
passes as its budget holds, then the first blocks of one more, then the first documents of the
block at the border. Blocks have ``BLOCK_TOKENS`` tokens or so, whatever the source's size, so
running sums are taken over ranges of blocks and inside one block, never over a source. Blocks and
orders are keyed by hashes of whole rows and their copy numbers, so ids may be missing or shared.
With no budget given, it is the least that covers every source once.

Edge cases: a null source is a source of its own; documents without words are in every whole
pass of their source; a source without words at all has no weight and no rows. Repeated rows
are taken each, as numbered copies that lie in blocks of their own; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sextant.llm.common import discard, keep, small, table
from sextant.llm.native import words

ENTROPY = 0.97
REPEATS = 4.0
BLOCK_TOKENS = 1_000_000
SEED = 11
#: Exponents tried in each round, and rounds: the exponent is found to POINTS ** -ROUNDS.
POINTS, ROUNDS = 64, 4


def _weights(exponent: float | Column) -> Column:
    return F.exp(exponent * (F.log("tokens") - F.col("log_top")))


def exponent_for(sources: DataFrame, entropy: float = ENTROPY, repeats: float = REPEATS, budget: float | None = None) -> float:
    """The exponent for ``sources`` (source, tokens > 0, log_top: log of the largest)."""

    def measure(points: list[float]) -> dict[float, tuple[float, float]]:
        """(entropy as a share of its maximum, most passes over a source) of each exponent, in one aggregate."""
        w = F.col("w")
        each = sources.select("tokens", "log_top", F.explode(F.array(*map(F.lit, points))).alias("e")).select("e", "tokens", _weights(F.col("e")).alias("w"))
        sums = each.groupBy("e").agg(F.count("*").alias("n"), F.sum(w).alias("z"), F.sum(w * F.log(w)).alias("h"), F.max(w / F.col("tokens")).alias("top"), F.min(w / F.col("tokens")).alias("low")).collect()
        out = {}
        for r in sums:
            passes = r.top / r.low if budget is None else r.top / r.z * budget
            out[r.e] = (1.0 if r.n < 2 else (math.log(r.z) - r.h / r.z) / math.log(r.n), passes)
        return out

    # the border up to which the entropy is high enough, and that from which no source repeats too often
    flat, least = (0.0, 1.0), (0.0, 1.0)
    for _ in range(ROUNDS):
        tried = [[low + (high - low) * k / POINTS for k in range(POINTS + 1)] for low, high in (flat, least)]
        found = measure(sorted(set(tried[0] + tried[1])))
        k = max((i for i, e in enumerate(tried[0]) if found[e][0] >= entropy - 1e-12), default=0)
        flat = (tried[0][k], tried[0][min(k + 1, POINTS)])
        k = min((i for i, e in enumerate(tried[1]) if found[e][1] <= repeats + 1e-9), default=POINTS)
        least = (tried[1][max(k - 1, 0)], tried[1][k])
    return max(flat[0], least[1])


def hashes(docs: DataFrame) -> Column:
    """128 bits of a whole row (but for its maps, which have no hash)."""
    columns = [F.col(f"`{c}`") for c, kind in docs.dtypes if "map<" not in kind]
    return F.struct(F.xxhash64(*columns).alias("a"), F.xxhash64(F.lit(1), *columns).alias("b"))


def _singled(rows: DataFrame, copies: DataFrame) -> DataFrame:
    """``rows`` (with ``hashes``) and their copy number from 0. Equal rows meet as one row and a count, and come apart again."""
    counted = rows.join(small(copies), "hashes", "left")
    single = counted.where("copies is null").drop("copies").withColumn("copy", F.lit(0).cast("long"))
    names = [c for c in rows.columns if c != "hashes"]
    # the row itself is one value of the group; as many copies come out as went in
    several = counted.where("copies is not null").groupBy("hashes").agg(F.first(F.struct(*names)).alias("x"), F.first("copies").alias("copies"))
    several = several.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    return single.unionByName(several.select("hashes", *(F.col(f"x.{c}").alias(c) for c in names), "copy"))


def _placed(docs: DataFrame, carry: list[str], entropy: float, repeats: float, budget: int | None, block_tokens: int, seed: int) -> DataFrame:
    """``carry`` of docs (doc_id, source, text, hashes and more) with source, n_tokens, weight, pass, block_key, doc_key for each time taken."""
    named = docs.select(*carry, F.col("doc_id").alias("d"), F.col("source").cast("string").alias("s"), F.col("text").cast("string").alias("text"), "hashes")
    count = F.size(words(F.col("text"))).cast("long")
    keys = keep(named.select("d", "s", count.alias("n_tokens"), "hashes"), "tokens")
    totals = keep(keys.groupBy("s").agg(F.sum("n_tokens").alias("tokens")).where("tokens > 0"), "sources")
    top = totals.agg(F.max("tokens")).first()[0]
    totals = totals.withColumn("log_top", F.lit(math.log(top or 1)))
    exponent = exponent_for(totals, entropy, repeats, budget) if top else 1.0
    z, most = totals.agg(F.sum(_weights(exponent)), F.max(F.col("tokens") / _weights(exponent))).first()
    z, budget = z or 1.0, budget if budget is not None else (most or 0.0) * (z or 1.0)
    quota = totals.select(F.col("s").alias("q"), "tokens", (_weights(exponent) / z).alias("weight"))
    quota = quota.withColumn("passes", F.floor(F.col("weight") * budget / F.col("tokens") + 1e-9))
    quota = quota.withColumn("rest", F.greatest(F.lit(0), F.floor(F.col("weight") * budget - F.col("passes") * F.col("tokens") + 1e-6)))
    quota = small(keep(quota.withColumn("blocks", F.ceil(F.col("tokens") / block_tokens)), "quota"))
    copies = keep(keys.groupBy("hashes").agg(F.count("*").alias("copies")).where("copies > 1"), "copies")

    def place(rows: DataFrame) -> DataFrame:
        alone = _singled(rows, copies).join(quota, F.col("s").eqNullSafe(F.col("q"))).drop("q")
        return alone.withColumn("block", F.expr(f"pmod(xxhash64({seed}, hashes, copy), blocks)"))

    sums = place(keys).groupBy("s", "block", "passes", "rest").agg(F.sum("n_tokens").alias("block_tokens")).withColumn("key", F.xxhash64(F.lit(seed), "s", "block", "passes"))
    # running sums over a source's blocks: ranges of blocks are summed where they lie, behind the sums of the ranges before them
    step = Window.partitionBy("s", "range").orderBy("key", "block").rowsBetween(Window.unboundedPreceding, -1)
    sums = keep(sums.withColumn("range", F.shiftright("key", 54)), "block_sums")
    ranges = sums.groupBy("s", "range").agg(F.sum("block_tokens").alias("n"))
    ranges = ranges.select(F.col("s").alias("rs"), F.col("range").alias("rr"), F.coalesce(F.sum("n").over(Window.partitionBy("s").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    sums = sums.join(ranges, F.col("s").eqNullSafe(F.col("rs")) & (F.col("range") == F.col("rr"))).drop("rs", "rr")
    left = F.col("rest") - F.col("before") - F.coalesce(F.sum("block_tokens").over(step), F.lit(0))
    # whole blocks, then the block at the border, of which the first documents are taken
    part = F.when(F.col("left") >= F.col("block_tokens"), "whole").when(F.col("left") > 0, "border").otherwise("none")
    sums = keep(sums.withColumn("left", left).select(F.col("s").alias("b_source"), F.col("block").alias("b_block"), part.alias("part"), "left"), "blocks")
    # keys where nothing is carried; else whole rows, whose words are counted after the filters
    rows = place(named if carry else keys).join(small(sums), F.col("s").eqNullSafe(F.col("b_source")) & (F.col("block") == F.col("b_block"))).drop("b_source", "b_block")
    if carry:
        discard(keys)
    counted = lambda x: x.withColumn("n_tokens", count).drop("text") if carry else x
    doc_key = lambda p: F.xxhash64(F.lit(seed), p, F.col("hashes"), F.col("copy"))
    order = Window.partitionBy("s", "block").orderBy(doc_key(F.col("passes")), "hashes", "copy").rowsBetween(Window.unboundedPreceding, 0)
    border = counted(rows.where("part = 'border'")).withColumn("sofar", F.sum("n_tokens").over(order)).where(F.col("sofar") <= F.col("left")).drop("sofar")
    last = F.col("passes") - F.when(F.col("part") == "whole", 0).otherwise(1)
    full = counted(rows.where("passes > 0 or part = 'whole'")).withColumn("pass", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    taken = full.unionByName(border.withColumn("pass", F.col("passes")))
    return taken.select(*carry, F.col("d").alias("doc_id"), F.col("s").alias("source"), "n_tokens", "weight", "pass", F.xxhash64(F.lit(seed), "s", "block", "pass").alias("block_key"), doc_key(F.col("pass")).alias("doc_key"))


def mix(docs: DataFrame, entropy: float = ENTROPY, repeats: float = REPEATS, budget: int | None = None, block_tokens: int = BLOCK_TOKENS, seed: int = SEED) -> DataFrame:
    """One row for each time a document is taken.

    (doc_id, source, n_tokens, weight, pass, block_key, doc_key): sorted by pass, block_key and
    doc_key these rows are the training order.
    """
    return _placed(docs.select("doc_id", "source", "text", hashes(docs).alias("hashes")), [], entropy, repeats, budget, block_tokens, seed)


def corpus(docs: DataFrame, entropy: float = ENTROPY, repeats: float = REPEATS, budget: int | None = None, block_tokens: int = BLOCK_TOKENS, seed: int = SEED) -> DataFrame:
    """The rows of ``mix`` with the columns of ``docs``; those of ``mix`` are in a struct ``mixing``.

    Only the documents of blocks at a border are shuffled with their texts.
    """
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), "doc_id", "source", "text", hashes(docs).alias("hashes"))
    taken = _placed(packed, ["row"], entropy, repeats, budget, block_tokens, seed)
    names = ("n_tokens", "weight", "pass", "block_key", "doc_key")
    return taken.select(*(F.col(f"row.`{c}`").alias(c) for c in docs.columns), F.struct(*names).alias("mixing"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))
