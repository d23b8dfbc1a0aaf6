"""MinHash near-duplicate search with odd sketches (operator 10).

1. Each text becomes the set of its distinct five-word shingles, one MinHash signature, band
   keys and an odd sketch: every sample (i, minimum) flips one bit of a bitmap, so the XOR of
   two bitmaps has about one bit for each sample that differs, and its population count
   estimates a high similarity closely.
2. Texts with equal sets are one class; only one text of each class goes on.
3. Classes meet in band buckets. Each class is first compared with the bucket leader that it
   meets most often; what these links join is one component.
4. Buckets that still hold several components are compared in full, block by block, by odd
   sketches; pairs inside a component are skipped. So a large group costs its number of
   members, not of pairs, as far as its members are linked with its leader.
5. Every candidate is confirmed on the full sets before it links two classes.

Bands of 7 in 36 rows find a pair of similarity 0.85 with probability 1 - 1e-6; a pair is
dropped by its sketch only if the estimate lies 0.10 below the threshold (over four standard
deviations of 252 samples).

Classes are nodes of their own, numbered when they are written; a component is named by the least
doc_id of its rows. So rows without doc_id, or with one that others have too, are linked by their texts.

Edge cases: null text, empty text and text without words have an empty set and are linked with
nothing; a text of fewer than five words is one shingle. A row without doc_id is linked like any other,
but its own component is null and it is kept. Repeated rows get equal results; of rows that share
a doc_id but not the text, each has the component of its own text. An empty table gives an empty
result; other columns are ignored.

``one_of_each`` filters rows: of each component one row stays, that with the least doc_id (rows
without one last), whatever ids and other columns are repeated; rows without words all stay.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructType

from sextant.llm.common import Words, discard, keep, mix, shingle_set, slices, table, utf8
from sextant.llm.components import components

BANDS, ROWS = 36, 7
SAMPLES = BANDS * ROWS
SKETCH_BITS = 1024
WORDS = 5
THRESHOLD = 85
MARGIN = 0.10
#: Members of a bucket that are compared at once; larger buckets are split into pairs of blocks.
BLOCK = 256
#: Shingles of the sets, and sets, that are compared with a leader's at once.
CHUNK, MEMBERS = 1 << 18, 128
#: Rows for each task of the steps that compare sets or sketches, which cost time rather than bytes.
TASK_ROWS = 4000

_rng = np.random.default_rng(7)
_A = _rng.integers(0, 1 << 32, SAMPLES, dtype=np.uint32) | np.uint32(1)
_B = _rng.integers(0, 1 << 32, SAMPLES, dtype=np.uint32)
_ROW = _rng.integers(1, 1 << 63, ROWS, dtype=np.uint64) | np.uint64(1)
_BAND = _rng.integers(1, 1 << 63, BANDS, dtype=np.uint64)
_INDEX = _rng.integers(1, 1 << 63, SAMPLES, dtype=np.uint64)


def minhash(shingles: np.ndarray) -> np.ndarray:
    """The SAMPLES minima of a set of shingle hashes, in steps of bounded memory."""
    low = (shingles >> np.uint64(32)).astype(np.uint32)
    best = np.full(SAMPLES, 0xFFFFFFFF, np.uint32)
    for k in range(0, len(low), 1024):
        part = _A[:, None] * low[None, k : k + 1024]
        part += _B[:, None]
        np.minimum(best, part.min(axis=1), out=best)
    return best


def odd_sketch(samples: np.ndarray) -> np.ndarray:
    """Parity bitmap of the samples, as bytes."""
    bit = mix(_INDEX ^ samples.astype(np.uint64)) % np.uint64(SKETCH_BITS)
    return np.packbits(np.bincount(bit.astype(np.int64), minlength=SKETCH_BITS).astype(np.uint8) & 1)


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarity of sketches (byte matrices that broadcast) by the population count of their XOR."""
    odd = np.bitwise_count(np.bitwise_xor(a, b)).sum(axis=-1).astype(float)
    share = np.minimum(2 * odd / SKETCH_BITS, 0.999)
    different = -SKETCH_BITS / 2 * np.log1p(-share)  # samples in the symmetric difference
    return 1 - different / (2 * SAMPLES)


def _least(threshold: int) -> float:
    return threshold / 100 - MARGIN


def _key(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def _signatures(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, data = utf8(batch.column(batch.num_columns - 1))
            for i, j in slices(at):
                tokens = Words(at[i : j + 1], data)
                n, key, sketch, bands, codes = [], [], [], [], []
                for k in range(j - i):
                    found = shingle_set(tokens.hash[tokens.first[k] : tokens.first[k + 1]], words)
                    n.append(len(found))
                    if not len(found):
                        key.append(None), sketch.append(None), bands.append(None), codes.append(None)
                        continue
                    least = minhash(found)
                    key.append(_key(found))
                    sketch.append(odd_sketch(least).tobytes())
                    band = mix((least.reshape(BANDS, ROWS).astype(np.uint64) * _ROW).sum(axis=1, dtype=np.uint64) ^ _BAND)
                    bands.append(band.view(np.int64))
                    codes.append(band.astype(np.uint32).tobytes())
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:-1], pa.array(n, pa.int64()), pa.array(key, pa.binary()), pa.array(sketch, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(codes, pa.binary())],
                    [*part.schema.names[:-1], "n_shingles", "set_key", "sketch", "bands", "codes"],
                )

    return run


def _held(docs: DataFrame, row: bool = False) -> DataFrame:
    """(at, doc_id, row if asked for, text): ``at`` leads back to a class's text, whatever ids repeat."""
    doc_id, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    rows = [F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")] if row else []
    return docs.select(F.xxhash64(doc_id, text).alias("at"), doc_id.alias("doc_id"), *rows, text.alias("text"))


def signatures(held: DataFrame, words: int = WORDS) -> DataFrame:
    """The columns of ``held`` but its last, text, and (n_shingles, set_key, sketch, bands, codes)."""
    schema = StructType(list(held.schema.fields[:-1])).add("n_shingles", "long").add("set_key", "binary").add("sketch", "binary").add("bands", ArrayType(LongType())).add("codes", "binary")
    return held.mapInArrow(_signatures(words), schema)


def _sets(words: int):
    """(id, shingles) of rows (id, set_key, text) whose text has that set; copies in a task give it once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()
        for batch in batches:
            at, data = utf8(batch.column(2))
            ids, keys = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for i, j in slices(at):
                tokens = Words(at[i : j + 1], data)
                out: dict[int, bytes] = {}
                for k in range(i, j):
                    if ids[k] not in done:
                        found = shingle_set(tokens.hash[tokens.first[k - i] : tokens.first[k - i + 1]], words)
                        if _key(found) == keys[k]:
                            done.add(ids[k])
                            out[ids[k]] = found.tobytes()
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.int64()), pa.array(out.values(), pa.binary())], ["id", "shingles"])

    return run


def _confirm(threshold: int):
    """Of one leader and a chunk of its candidates, those linked by the full sets."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        leader = key[0].as_py()
        ids, texts = rows.column("id").to_pylist(), rows.column("shingles").to_pylist()
        own = np.frombuffer(texts[ids.index(leader)], np.uint64)
        linked = []
        for i, x in zip(ids, texts, strict=True):
            if i != leader:
                other = np.frombuffer(x, np.uint64)
                shared = len(own) + len(other) - len(np.union1d(own, other))
                if 100 * shared >= threshold * (len(own) + len(other) - shared):
                    linked.append(i)
        return pa.table({"a": pa.array([leader] * len(linked), pa.int64()), "b": pa.array(linked, pa.int64())})

    return run


def _tasks(rows: int, size: int = 0) -> int:
    """Tasks for a step over so many rows and bytes."""
    return max(8, -(-rows // TASK_ROWS), -(-size // (32 << 20)))


def confirm(pairs: DataFrame, sets: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """Of the candidate pairs (a, b, n: size of b's set), those whose full sets are similar enough.

    A set travels once for each pair in which it is b; the leader a is sent to as many chunks
    as hold its candidates, so that a leader of many is checked by many tasks.
    """
    heads = keep(pairs.groupBy("a").agg(F.count("*").alias("rows"), F.sum("n").alias("size"), F.ceil(F.greatest(F.sum("n") / CHUNK, F.count("*") / MEMBERS)).alias("chunks")), "heads")
    total = heads.agg(F.coalesce(F.sum("rows") + F.sum("chunks"), F.lit(0)), F.coalesce(8 * F.sum("size"), F.lit(0))).first()
    leaders = heads.select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk"), F.col("a").alias("id"))
    members = pairs.join(heads, "a").select("a", F.expr("pmod(xxhash64(b), chunks)").alias("chunk"), F.col("b").alias("id"))
    filled = members.select("a", "chunk").distinct()
    rows = members.unionByName(leaders.join(filled, ["a", "chunk"], "left_semi")).join(sets, "id").select("a", "chunk", "id", "shingles")
    out = rows.repartition(_tasks(*map(int, total)), "a", "chunk").groupBy("a", "chunk").applyInArrow(_confirm(threshold), "a long, b long")
    found = keep(out, "links")
    discard(heads)
    return found


def _blocks(least: float):
    """Candidates of different components in a pair of blocks of one bucket.

    A pair that shares several buckets is returned by the first band alone: members carry short
    codes of all their band keys.
    """

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        side, ids, parts = (rows.column(c).to_numpy() for c in ("side", "id", "component"))
        sketches, codes = (np.frombuffer(b"".join(rows.column(c).to_pylist()), t).reshape(len(ids), -1) for c, t in (("sketch", np.uint8), ("codes", np.uint32)))
        band = int(np.flatnonzero((codes == np.uint32(key[0].as_py() & 0xFFFFFFFF)).all(axis=0))[0])
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        same = not len(right)  # a block with itself
        right = left if same else right
        a, b = [], []
        for i in left:
            near = right[(parts[right] != parts[i]) & ((ids[right] > ids[i]) if same else True)]
            near = near[~(codes[near, :band] == codes[i, :band]).any(axis=1)]
            if len(near):
                near = near[estimate(sketches[i], sketches[near]) >= least]
                a.append(np.minimum(ids[i], ids[near]))
                b.append(np.maximum(ids[i], ids[near]))
        a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a, b))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _across(members: DataFrame, labels: DataFrame, sketches: DataFrame, least: float) -> DataFrame:
    """Candidate pairs (a, b, n) of different components from all buckets that hold several, each pair once.

    The members of the bucket's largest component stand aside from the rest: they are blocked
    apart and two of their blocks never meet.
    """
    placed = keep(members.join(labels, "id"), "placed")
    counts = placed.groupBy("key", "component").agg(F.count("*").alias("n"))
    mixed = counts.groupBy("key").agg(F.max_by("component", F.struct("n", -F.col("component"))).alias("first"), F.count("*").alias("parts")).where("parts > 1").select("key", "first")
    mixed = keep(mixed, "mixed")
    across = keep(placed.join(mixed.hint("merge"), "key").withColumn("main", F.col("component") == F.col("first")), "across")
    sizes = keep(across.groupBy("key").agg(F.ceil(F.count(F.when(F.col("main"), 1)) / BLOCK).alias("m"), F.ceil(F.count(F.when(~F.col("main"), 1)) / BLOCK).alias("r")), "bucket_sizes")
    # a block of the rest meets all blocks; a block of the main component only those of the rest
    meetings = F.when(F.col("main"), F.col("r")).otherwise(F.col("r") + F.col("m"))
    total = across.join(sizes, "key").agg(F.coalesce(F.sum(meetings), F.lit(0))).first()[0]
    rows = across.join(sizes, "key").join(sketches, "id")
    block = F.when(F.col("main"), F.col("r") + F.expr("pmod(xxhash64(id), m)")).otherwise(F.expr("pmod(xxhash64(id), greatest(r, 1))"))
    rows = rows.withColumn("block", block).withColumn("other", F.explode(F.when(F.col("main"), F.expr("sequence(0L, r - 1)")).otherwise(F.expr("sequence(0L, r + m - 1)"))))
    rows = rows.select("key", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), F.when(F.col("block") <= F.col("other"), 0).otherwise(1).alias("side"), "id", "component", "sketch", "codes")
    pairs = rows.repartition(_tasks(int(total)), "key", "low", "high").groupBy("key", "low", "high").applyInArrow(_blocks(least), "a long, b long")
    found = keep(pairs.join(sketches.select(F.col("id").alias("b"), F.col("n_shingles").alias("n")), "b").select("a", "b", "n"), "candidates")
    discard(placed, mixed, across, sizes)
    return found


def _components(signed: DataFrame, held: DataFrame, words: int, threshold: int) -> tuple[DataFrame, DataFrame]:
    """(classes, labels): the classes (id, set_key, doc_id) of rows with equal sets, and (id, component) of the linked ones."""
    if threshold < 80:
        raise ValueError(f"threshold {threshold}: the bands are made for 80 at least")
    same = [F.first(c).alias(c) for c in ("n_shingles", "sketch", "bands", "codes")]
    classes = signed.where("set_key is not null").groupBy("set_key").agg(F.min("at").alias("at"), F.min("doc_id").alias("doc_id"), F.count("*").alias("rows"), *same)
    nodes = keep(classes.withColumn("id", F.monotonically_increasing_id()), "nodes")
    # leaders: the text with most copies, then the first one, is the likeliest source of the others
    order = F.struct(-F.col("rows"), F.col("doc_id").isNull(), "doc_id", "id")
    buckets = nodes.select(F.explode("bands").alias("key"), "id", order.alias("order"))
    full = keep(buckets.groupBy("key").agg(F.min_by("id", "order").alias("leader"), F.count("*").alias("n")).where("n > 1").select("key", "leader"), "leaders")
    buckets = buckets.drop("order")
    # merged, never broadcast: these sides grow with the documents
    members = keep(buckets.join(full.hint("merge"), "key"), "members")
    sketches = keep(nodes.join(members.select("id").distinct(), "id", "left_semi").select("id", "at", "set_key", "n_shingles", "sketch", "codes"), "sketches")
    texts = held.select("at", "text").join(sketches.select("at", "id", "set_key").hint("merge"), "at").select("id", "set_key", "text")
    sets = keep(texts.mapInArrow(_sets(words), "id long, shingles binary"), "sets")

    met = members.where("id <> leader").groupBy("id", "leader").count()
    star = met.groupBy("id").agg(F.max_by("leader", F.struct("count", -F.col("leader"))).alias("a"))
    star = keep(star.join(sketches.select("id", "n_shingles"), "id").select("a", F.col("id").alias("b"), F.col("n_shingles").alias("n")), "star")
    edges = confirm(star, sets, threshold)
    first = components(edges)
    everyone = keep(sketches.select("id").join(first, "id", "left").select("id", F.coalesce("component", "id").alias("component")), "labels")
    candidates = _across(members, everyone, sketches, _least(threshold))
    more = confirm(candidates, sets, threshold)
    labels = first if more.isEmpty() else components(edges.unionByName(more))
    discard(full, members, sketches, sets, star, edges, everyone, candidates, more, *([] if labels is first else [first]))
    return nodes, labels


def near_duplicates(docs: DataFrame, words: int = WORDS, threshold: int = THRESHOLD) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): the component of each row of ``docs``.

    ``threshold`` is a percentage of the similarity of shingle sets; less than 80 is an error.
    """
    held = _held(docs)
    signed = keep(signatures(held, words), "signatures")
    nodes, labels = _components(signed, held, words, threshold)
    least = nodes.select("id", "doc_id").join(labels, "id").groupBy("component").agg(F.min("doc_id").alias("named"))
    named = labels.join(least, "component").select("id", "named")
    classes = keep(nodes.join(named, "id", "left").select("set_key", F.coalesce("named", "doc_id").alias("component")), "class_components")
    discard(nodes, labels)
    rows = signed.select("doc_id", "n_shingles", "set_key")
    out = rows.where("set_key is not null").join(classes, "set_key").drop("set_key").unionByName(rows.where("set_key is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component")))
    component = F.when(F.col("doc_id").isNotNull(), F.col("component"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def one_of_each(docs: DataFrame, words: int = WORDS, threshold: int = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, one of each component; rows without words all stay."""
    held = _held(docs, row=True)
    signed = keep(signatures(held, words).withColumn("n", F.monotonically_increasing_id()), "signatures")
    nodes, labels = _components(signed, held, words, threshold)
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "n")
    best = signed.where("set_key is not null").groupBy("set_key").agg(F.min(order).alias("best"))
    of = nodes.select("id", "set_key").join(labels, "id", "left").select("set_key", F.coalesce("component", "id").alias("component"))
    chosen = keep(best.join(of, "set_key").groupBy("component").agg(F.min("best").alias("best")).select("best.n"), "kept_rows")
    discard(nodes, labels)
    kept = signed.where("set_key is not null").join(chosen.hint("merge"), "n", "left_semi").unionByName(signed.where("set_key is null").select("n", *(c for c in signed.columns if c != "n")))
    return kept.select(*(F.col(f"row.`{c}`").alias(c) for c in docs.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_sort(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))) END AS sh FROM d),
c AS (SELECT sh, min(doc_id) AS id, len(sh) AS n FROM s WHERE len(sh) > 0 GROUP BY sh),
x AS (SELECT id, n, unnest(sh) AS g FROM c),
p AS (SELECT a.id AS a, b.id AS b FROM x a JOIN x b ON a.g = b.g AND a.id < b.id AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n) GROUP BY a.id, b.id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
e AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r AS (SELECT id, id AS other FROM c UNION SELECT r.id, e.b FROM r JOIN e ON e.a = r.other),
k AS (SELECT id, min(other) AS component FROM r GROUP BY id)
SELECT s.doc_id, CAST(len(s.sh) AS BIGINT) AS n_shingles, coalesce(k.component, s.doc_id) AS component_id, s.doc_id = coalesce(k.component, s.doc_id) AS kept
FROM s LEFT JOIN c ON c.sh = s.sh LEFT JOIN k ON k.id = c.id
"""
