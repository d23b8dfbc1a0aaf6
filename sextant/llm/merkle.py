"""Merkle manifest of a dataset (operator 12).

Each document is a leaf: the SHA-256 of its fields, each with its length. The leaves of a source,
ascending by doc_id, are hashed in runs of ``FAN`` until one node is left, the source's subroot;
the subroots, in order of source, are hashed in the same way to the root. Digests enter hashes as
hex text. A document's proof is the list of the other members of its run at each level, up to the root.

Leaves are dealt to superblocks of ``FAN ** LOCAL`` neighbours. A first pass over the superblocks
exchanges only their roots, from which the levels above are hashed, a row for each node. Then
leaves and the outer runs that their superblock's path crosses are cogrouped by superblock: one
function finishes the local reduction, joins inner and outer siblings to proofs, and folds each
document's presented leaf back to a root. No group holds more than a superblock and a run for each
level; numbers inside sources come from ranges with offsets, so no source is in one task.

``presented`` are the texts that are proven against the manifest: here those of ``tampered``.

Edge cases: null fields are ``-``. A null source is the first source, null ids come before all
others. Rows of one doc_id are ordered by their leaf digest, and equal rows are interchangeable.
A lone leaf is its source's subroot, a lone subroot is the root; a proof without siblings is the
hash of nothing. Empty texts are texts, texts of any length are hashed whole, and an empty table
gives an empty result. Columns beyond the five are ignored.
"""

from __future__ import annotations

import hashlib
import string

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sextant.llm.common import discard, keep, small, table
from sextant.operators import ranks

FAN = 16
#: Levels that are reduced inside a superblock.
LOCAL = 2
BLOCK = FAN**LOCAL
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
HEX = 64


def field(value: Column) -> Column:
    """Byte count, colon and value; ``-`` for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(**fields: Column) -> Column:
    return F.sha2(F.concat(*(field(fields[k]) for k in FIELDS)), 256)


def tampered(doc_id: Column, text: Column) -> Column:
    """The text as it is presented for the proof: A-Z in lower case in every fifth document by checksum."""
    chosen = F.crc32(doc_id.cast("string")) % 5 == 0
    return F.when(chosen, F.translate(text, string.ascii_uppercase, string.ascii_lowercase)).otherwise(text)


def levels(n: Column) -> Column:
    """Levels of runs above n nodes."""
    out = F.lit(0)
    for k in range(15):
        out = out + (n > FAN**k).cast("int")
    return out


def reduced(nodes: list[str], depth: int) -> list[list[str]]:
    """The nodes of each level, from the given one up."""
    out = [nodes]
    for _ in range(depth):
        last = out[-1]
        out.append([hashlib.sha256("".join(last[k : k + FAN]).encode()).hexdigest() for k in range(0, len(last), FAN)])
    return out


def _local_root(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("n")
    top = reduced([x.hex() for x in rows["leaf"]], int(rows["depth"].iloc[0]))[-1]
    return pd.DataFrame({"s": rows["s"].iloc[:1], "i": rows["block"].iloc[:1], "digest": top})


def _runs(nodes: DataFrame, *group: str) -> DataFrame:
    """(group, parent, run): the hex text of each run of (group, i, digest)."""
    listed = F.sort_array(F.collect_list(F.struct("i", "digest")))
    return nodes.groupBy(*group, F.expr(f"i div {FAN}").alias("parent")).agg(F.array_join(F.transform(listed, lambda x: x["digest"]), "").alias("run"))


def _proven(rows: pd.DataFrame, outer: pd.DataFrame, with_proof: bool) -> pd.DataFrame:
    """A superblock's leaves with proofs and folded roots."""
    if not len(rows):
        return pd.DataFrame()
    rows = rows.sort_values("n")
    nodes = [x.hex() for x in rows["leaf"]]
    inner = reduced(nodes, int(rows["depth"].iloc[0]))
    outer = outer.sort_values("level")
    above = [(run[: HEX * at], run[HEX * (at + 1) :], up) for at, run, up in zip(outer["at"], outer["run"], outer["level"] >= UPPER, strict=True)]

    def up(digest: str, k: int) -> tuple[str, str, list[str]]:
        """(subroot, root, siblings) of the k-th leaf with that digest."""
        found: list[str] = []
        for level in inner[:-1]:
            start, at = k // FAN * FAN, k % FAN
            run = level[start : start + FAN]
            left, right = "".join(run[:at]), "".join(run[at + 1 :])
            found.append(left + right)
            digest, k = hashlib.sha256((left + digest + right).encode()).hexdigest(), k // FAN
        subroot = digest
        for left, right, beyond in above:
            found.append(left + right)
            digest = hashlib.sha256((left + digest + right).encode()).hexdigest()
            subroot = subroot if beyond else digest
        return subroot, digest, found

    out = []
    for k, (own, other) in enumerate(zip(nodes, rows["presented"], strict=True)):
        subroot, root, found = up(own, k)
        folded = up(other.hex(), k)[1] if other is not None else root
        out.append((own, subroot, root, hashlib.sha256("".join(found).encode()).hexdigest(), folded, folded == root, *([[x for x in found if x]] if with_proof else [])))
    names = ["leaf", "subroot", "root", "proof_sha256", "folded_root", "verified", *(["proof"] if with_proof else [])]
    result = pd.DataFrame(out, columns=names)
    for c in ("doc_id", "source", "n"):
        result[c] = rows[c].to_numpy()
    return result


#: Levels from here on are above the sources.
UPPER = 100


def manifest(docs: DataFrame, presented=tampered, proofs: bool = False) -> DataFrame:
    """(doc_id, source, position, leaf, subroot, root, proof_sha256, folded_root, verified) of each row.

    ``presented(doc_id, text)``: the text that is proven in place of the row's own. ``proofs`` adds the
    siblings of each level (concatenated hex digests), from the leaf's run to the root's.
    """
    own = {k: F.col(f"`{k}`") for k in FIELDS}
    text = own["text"].cast("string")
    shown = presented(own["doc_id"], text)
    changed = ~text.eqNullSafe(shown)
    digests = docs.select(
        own["doc_id"].cast("long").cast("string").alias("doc_id"), own["doc_id"].cast("long").alias("d"), own["source"].cast("string").alias("source"),
        F.unhex(leaf(**own)).alias("leaf"), F.when(changed, F.unhex(leaf(**own | {"text": shown}))).alias("presented"),
    )
    digests = keep(digests, "leaves")
    sources = keep(digests.groupBy("source").agg(F.count("*").alias("size")), "sources")
    sources = ranks.numbered(sources, [], ["source"], name="s").withColumn("s", F.col("s") - 1)
    sources = keep(sources.select("s", F.col("source").alias("q"), "size", levels(F.col("size")).alias("levels")), "numbered_sources")
    top = sources.agg(F.count("*").alias("n"), F.max("levels").alias("levels")).first()
    placed = digests.join(small(sources.select("s", "q", "levels")), F.col("source").eqNullSafe(F.col("q"))).drop("q")
    # equal rows are dealt over ranges too
    placed = ranks.numbered(placed.withColumn("row", F.monotonically_increasing_id()), ["s"], ["d", "leaf", "row"])
    placed = placed.select("s", F.expr(f"(n - 1) div {BLOCK}").alias("block"), "n", "doc_id", "source", "leaf", "presented", F.least("levels", F.lit(LOCAL)).alias("depth"), "levels")
    placed = keep(placed, "numbered_leaves")
    discard(digests)

    # the levels above the superblocks: inside sources, then over sources
    nodes = keep(placed.select("s", "block", "n", "leaf", "depth").groupBy("s", "block").applyInPandas(_local_root, "s long, i long, digest string"), "superblocks")
    blocks = nodes.join(small(sources.select("s", "levels")), "s").select("s", F.col("i").alias("block"), "levels")
    outer, subroots = [], []
    for level in range(LOCAL, max(LOCAL, top["levels"] or 0) + 1):
        deep = small(sources.where(F.col("levels") > level).select("s"))
        last = F.col("levels") == level if level > LOCAL else F.col("levels") <= level
        subroots.append(nodes.join(small(sources.where(last).select("s")), "s").select("s", "digest"))
        if level == top["levels"]:
            break
        runs = keep(_runs(nodes.join(deep, "s"), "s"), f"runs_{level}")
        step = FAN ** (level - LOCAL)
        path = blocks.where(F.col("levels") > level).withColumn("parent", F.expr(f"block div {step * FAN}"))
        outer.append(path.join(small(runs), ["s", "parent"]).select("s", "block", F.lit(level).alias("level"), F.expr(f"cast(block div {step} % {FAN} as int)").alias("at"), "run"))
        nodes = runs.select("s", F.col("parent").alias("i"), F.sha2("run", 256).alias("digest"))
    tree = subroots[0]
    for x in subroots[1:]:
        tree = tree.unionByName(x)
    tree = keep(tree.select(F.col("s").alias("i"), "digest"), "subroots")
    every = sources.select("s")
    k, left, paths = 0, top["n"], None
    while left > 1:
        runs = keep(_runs(tree), f"source_runs_{k}")
        path = every.withColumn("parent", F.expr(f"s div {FAN ** (k + 1)}")).join(small(runs), "parent")
        path = path.select("s", F.lit(UPPER + k).alias("level"), F.expr(f"cast(s div {FAN ** k} % {FAN} as int)").alias("at"), "run")
        paths = path if paths is None else paths.unionByName(path)
        tree = runs.select(F.col("parent").alias("i"), F.sha2("run", 256).alias("digest"))
        k, left = k + 1, -(-left // FAN)
    if paths is not None:
        # what all superblocks of a source share
        outer.append(blocks.select("s", "block").join(small(keep(paths, "source_paths")), "s"))
    empty = docs.sparkSession.createDataFrame([], "s long, block long, level int, at int, run string")
    for x in outer:
        empty = empty.unionByName(x)

    schema = "leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean" + (", proof array<string>" if proofs else "") + ", doc_id string, source string, n long"

    def proven(rows: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        return _proven(rows, found, proofs)

    out = placed.groupBy("s", "block").cogroup(empty.groupBy("s", "block")).applyInPandas(proven, schema)
    names = ["leaf", "subroot", "root", "proof_sha256", "folded_root", "verified", *(["proof"] if proofs else [])]
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), "source", F.col("n").alias("position"), *names)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(table(spark, sf_dir, "documents"))


def _sql(depth: int = 7, above: int = 4) -> str:
    """The manifest in DuckDB for sources of FAN ** depth leaves and FAN ** above sources."""
    f = lambda c: f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"
    cat = lambda text: "sha256(" + " || ".join(f(c) for c in (*FIELDS[:-1], text)) + ")"
    # CRC-32 bit by bit: after each byte, 256 stands for a shift
    bits = "flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: [CAST(ascii(c) AS BIGINT), 256, 256, 256, 256, 256, 256, 256, 256]))"
    crc = f"xor(list_reduce(list_prepend(4294967295, {bits}), lambda a, x: CASE WHEN x = 256 THEN xor(a >> 1, (a & 1) * 3988292384) ELSE xor(a, x) END), 4294967295)"
    out = [
        f"d AS (SELECT *, {crc} % 5 = 0 AS chosen, translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS small FROM documents)",
        "d1 AS (SELECT *, CASE WHEN chosen THEN small ELSE text END AS shown FROM d)",
        f"d2 AS (SELECT doc_id, source, {cat('text')} AS leaf, {cat('shown')} AS presented FROM d1)",
        "srcs AS (SELECT source, count(*) AS size, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS s FROM d2 GROUP BY source)",
        "l0 AS (SELECT d2.*, s, size, row_number() OVER (PARTITION BY s ORDER BY doc_id NULLS FIRST, leaf) - 1 AS n FROM d2 JOIN srcs ON d2.source IS NOT DISTINCT FROM srcs.source)",
        "n0 AS (SELECT s, size, n AS i, leaf AS digest FROM l0)",
    ]
    for k in range(depth):
        out.append(f"r{k} AS (SELECT s, any_value(size) AS size, i // {FAN} AS i, string_agg(digest, '' ORDER BY i) AS run FROM n{k} WHERE size > {FAN**k} GROUP BY s, i // {FAN})")
        out.append(f"n{k + 1} AS (SELECT s, size, i, sha256(run) AS digest FROM r{k} UNION ALL SELECT * FROM n{k} WHERE size <= {FAN**k})")
    out.append(f"m0 AS (SELECT s AS i, digest, count(*) OVER () AS size FROM n{depth})")
    for k in range(above):
        out.append(f"q{k} AS (SELECT any_value(size) AS size, i // {FAN} AS i, string_agg(digest, '' ORDER BY i) AS run FROM m{k} WHERE size > {FAN**k} GROUP BY i // {FAN})")
        out.append(f"m{k + 1} AS (SELECT i, sha256(run) AS digest, size FROM q{k} UNION ALL SELECT * FROM m{k} WHERE size <= {FAN**k})")
    out.append("f0 AS (SELECT doc_id, s, n, leaf, presented AS node, '' AS proof FROM l0)")
    step = lambda at: f"left(run, {HEX} * ({at})) || {{}} || substr(run, {HEX} * ({at}) + {HEX + 1})"
    for k in range(depth + above):
        r, where, at = (f"r{k}", f"r.s = f.s AND r.i = f.n // {FAN ** (k + 1)}", f"f.n // {FAN**k} % {FAN}") if k < depth else (f"q{k - depth}", f"r.i = f.s // {FAN ** (k - depth + 1)}", f"f.s // {FAN ** (k - depth)} % {FAN}")
        out.append(f"f{k + 1} AS (SELECT doc_id, f.s, n, leaf, CASE WHEN run IS NULL THEN node ELSE sha256({step(at).format('node')}) END AS node, proof || CASE WHEN run IS NULL THEN '' ELSE {step(at).format(chr(39) * 2)} END AS proof FROM f{k} f LEFT JOIN {r} r ON {where})")
    return (
        "WITH " + ",\n".join(out) + f"\nSELECT doc_id, srcs.source, n + 1 AS position, leaf, u.digest AS subroot, t.digest AS root, sha256(proof) AS proof_sha256, node AS folded_root, node = t.digest AS verified"
        f" FROM f{depth + above} f JOIN srcs ON srcs.s = f.s JOIN n{depth} u ON u.s = f.s CROSS JOIN m{above} t"
    )


SQL = _sql()
