"""Merkle manifest, fingerprints and hard negatives against plain versions, with nulls, repeats, ties and empty tables."""

import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sextant.llm import fingerprints, hard_negatives, merkle

DOCS = "doc_id long, text string, lang string, source string, n_chars long, s string, n long, `block` string, leaf string, part int, h long, tail boolean"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, lang, src, None if t is None else len(t), "x", 5, "y", "z", 1, 2, True) for i, t, lang, src in rows], DOCS)


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def plain_manifest(rows):
    """Rows of (doc_id, leaf, subroot, root, proof_sha256, folded_root, verified)."""
    by_source = {}
    for i, t, lang, src in rows:
        n = None if t is None else len(t)
        changed = t
        if i is not None and t is not None and zlib.crc32(str(i).encode()) % 5 == 0:
            changed = "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
        leaf, other = (sha(*map(field, (i, src, lang, n, x))) for x in (t, changed))
        by_source.setdefault(src, []).append((i is not None, i or 0, leaf, other, i))

    def tree(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([sha(*out[-1][k : k + 16]) for k in range(0, len(out[-1]), 16)])
        return out

    sources = sorted(by_source, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for src in sources:
        by_source[src].sort(key=lambda x: x[:3])
        trees[src] = tree([x[2] for x in by_source[src]])
    top = tree([trees[src][-1][0] for src in sources])
    out = []
    for m, src in enumerate(sources):
        for n, (_, _, leaf, other, i) in enumerate(by_source[src]):
            siblings, node = [], other
            for levels, at in ((trees[src], n), (top, m)):
                for level in levels[:-1]:
                    start = at // 16 * 16
                    run = level[start : start + 16]
                    left, right = run[: at - start], run[at - start + 1 :]
                    siblings += left + right
                    node, at = sha(*left, node, *right), at // 16
            out.append((i, leaf, trees[src][-1][0], top[-1][0], sha(*siblings), node, node == top[-1][0]))
    return out


MANIFEST = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
LONG = " ".join(f"V{k % 997}x{k}" for k in range(30_000))
ROWS = [
    (1, None, "en", "a"), (2, "", None, None), (3, "Ab C", "en", "a"), (5, "Equal", "en", None), (5, "Equal", "en", None), (5, "Other", "en", None), (None, "No ID", None, "c"), (None, None, None, None),
    (7, LONG, "de", "b"), (-4, "Ünï 𝄞 Z", "de", "é"), (9, "Lone", "en", "z"), (2**60 + 1, "Far", "en", "b"),
]


@pytest.mark.parametrize("rows", [ROWS, ROWS + [(k, f"Text {k} OF many", "en", "hot") for k in range(5000)], [(k, f"T{k}", "en", f"s{k}") for k in range(300)], [(1, "Alone", "en", "a")], [(3, "Same", "en", "a")] * 40])
def test_manifest_is_the_plain_tree(spark, rows):
    got = merkle.manifest(docs_of(spark, rows)).select(*MANIFEST).collect()
    assert Counter(map(tuple, got)) == Counter(plain_manifest(rows))


def test_manifest_of_nothing_and_whole_proofs(spark):
    assert merkle.manifest(docs_of(spark, [])).count() == 0
    for r in merkle.manifest(docs_of(spark, ROWS + [(k, f"Text {k}", "en", "hot") for k in range(100, 400)]), proofs=True).collect():
        assert sha(*r.proof) == r.proof_sha256
        assert all(len(x) % 64 == 0 for x in r.proof)


def test_a_changed_row_fails_its_proof_alone(spark):
    rows = [(k, f"Text {k}", "en", f"s{k % 3}") for k in range(500)]
    got = merkle.manifest(docs_of(spark, rows), lambda doc_id, text: F.when(doc_id == 77, "other").otherwise(text)).where("not verified").collect()
    assert [r.doc_id for r in got] == [77]


TEXTS = [
    (1, "one two three four five\nsix seven"), (2, "one two three four five\nsix seven"), (3, None), (4, ""), (5, " \n "), (6, LONG), (7, LONG + " more words"), (8, "word " * 5000), (None, "no id here"), (None, None), (9, "\n".join(f"line {k} of a text with lines" for k in range(300))),
    (10, "𝄞 ünï " * 90), (11, "a"), (12, "same row"), (12, "same row"), (12, "other text"), (13, "x" * 3_000_000 + " y\nz " + "q " * 10),
]


def plain_versions(rows):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, hash_of[r[1] or ""]))
    out = []
    for (i, t), (_, u) in zip(order, order[1:] + order[:1], strict=True):
        t, u = t or "", u or ""
        e = fingerprints.edited(t, u)
        a, b, c = fingerprints.fingerprints([t]), fingerprints.fingerprints([e]), fingerprints.fingerprints([u])
        out.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), str(a[0]), str(b[0]), fingerprints.compared(a, b)[0][0], fingerprints.compared(a, c)[0][0]))
    return out


hash_of = {}


@pytest.mark.parametrize("rows", [TEXTS, TEXTS[:1], [(3, "copy of a text")] * 400 + [(4, "next"), (2, "before")], [(None, "none")] * 200 + [(None, "other")], [(k % 7, f"text {k} " * (k % 40)) for k in range(300)]])
def test_fingerprints_of_the_next(spark, rows):
    df = docs_of(spark, [(i, t, "en", "a") for i, t in rows]).repartition(3)
    hash_of.update({r[0]: r[1] for r in df.select(F.coalesce("text", F.lit("")), F.xxhash64(F.coalesce("text", F.lit("")))).distinct().collect()})
    for tasks in (1, 5):
        assert Counter(map(tuple, fingerprints.of_next(df, tasks).collect())) == Counter(plain_versions(rows))


def test_fingerprints_of_nothing(spark):
    assert fingerprints.of_next(docs_of(spark, [])).count() == 0


def multiset(text, words):
    return Counter(fingerprints.part_keys([text.encode()], words)[0].tolist())


def test_differences_are_those_of_the_parts():
    rng = np.random.default_rng(5)
    lines = [" ".join(f"w{x}" for x in rng.integers(0, 300, rng.integers(1, 60))) for _ in range(400)]
    for n, m in ((0, 0), (0, 3), (1, 1), (30, 29), (200, 3), (300, 280), (400, 400)):
        a, b = "\n".join(lines[:n]), "\n".join(lines[400 - m :] if n != m else lines[:m])
        x, y = fingerprints.fingerprints([a]), fingerprints.fingerprints([b])
        likeness, gone, come = fingerprints.compared(x, y)[0]
        words = fingerprints.FINE_WORDS if x[0].fine is not None and y[0].fine is not None else fingerprints.PART_WORDS
        p, q = multiset(a, words), multiset(b, words)
        assert max([*p.values(), *q.values(), 0]) <= 1
        assert (set(gone.tolist()), set(come.tolist())) == (set(p - q), set(q - p))
        assert likeness == (sum((p & q).values()) / sum((p | q).values()) if p or q else 1.0)
        assert str(fingerprints.parsed(str(x[0]))) == str(x[0])


def test_an_edit_changes_the_parts_around_it(spark):
    text = " ".join(f"w{k % 211}v{k % 89}" for k in range(4000))
    old = spark.createDataFrame([(1, text), (2, text), (3, "short text")], "doc_id long, text string")
    new = spark.createDataFrame([(1, text.replace("w7v7 ", "new ", 1)), (2, text), (3, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in fingerprints.versions(fingerprints.fingerprinted(old), fingerprints.fingerprinted(new)).collect()}
    assert 0 < len(got[1].removed) <= 3 and 0 < len(got[1].added) <= 3 and got[1].likeness > 0.9
    assert (got[2].likeness, got[2].removed, got[2].added) == (1.0, [], [])
    assert got[3].likeness == 0.0 and got[3].added == []


VECTORS = "vec_id long, embedding array<double>, label long, no long, score long, id long, norm double"


def vectors_of(spark, rows):
    return spark.createDataFrame([(i, v, x, 1, 2, 3, 0.5) for i, v, x in rows], VECTORS)


def plain_negatives(rows):
    kept = [(i, [math.floor(256 * x) for x in v], label) for i, v, label in rows if label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    rank = lambda found: sorted(found, key=lambda x: (-x[0], x[1] is None, x[1] or 0, x[2]))
    out = []
    for a, (i, v, label) in enumerate(kept):
        if i is None or i % 50:
            continue
        scored = [(sum(x * y for x, y in zip(v, w, strict=True)), j, b, m) for b, (j, w, m) in enumerate(kept) if b != a and len(w) == len(v)]
        for p, j, *_ in rank([x for x in scored if x[3] == label])[:5]:
            window = [x for x in scored if x[3] != label and 50 * p <= 100 * x[0] <= 95 * p]
            out += [(i, j, r, n[1], p, n[0]) for r, n in enumerate(rank(window)[:3], 1)]
    return out


def some_vectors():
    rng = np.random.default_rng(3)
    near = rng.normal(size=(4, 12))
    rows = [(k, (near[k % 4] + rng.normal(size=12) * (0.3 if k % 3 else 1.5)).round(3).tolist(), k % 5) for k in range(700)]
    rows += [(k, rows[k][1], k % 5) for k in range(0, 200, 10)]  # repeated rows
    rows += [(1000 + k, rows[50][1], 2 * k % 7) for k in range(30)]  # one vector under many ids
    rows += [(50, [0.0] * 12, 1), (1, [0.0] * 12, 2), (100, [], 1), (101, [], 1), (102, [], 2), (None, rows[0][1], 0), (None, rows[3][1], 1), (150, None, 1), (200, [1.0, None], 1), (250, [float("nan")] * 12, 1), (300, [1.0, 2.0], None)]
    rows += [(350 + k, [1.0 + k, 2.0], k % 2) for k in range(20)] + [(400, [float("inf"), 1.0], 1), (450, [-1.0, -2.0], 1), (7, [-0.5, -1.0], 1)]
    return rows


def test_hard_negatives(spark):
    rows = some_vectors()
    for row_bytes, anchor_bytes in ((32 << 20, 4 << 20), (20_000, 1_000)):
        got, work = hard_negatives.mine(vectors_of(spark, rows), row_bytes=row_bytes, anchor_bytes=anchor_bytes)
        assert Counter(map(tuple, got.collect())) == Counter(plain_negatives(rows))
        done = {r.stage: r for r in work.collect()}
        assert all(0 < done[s].scored < done[s].pairs for s in ("positives", "negatives"))


def test_hard_negatives_of_nothing_and_of_great_numbers(spark):
    assert hard_negatives.mine(vectors_of(spark, []))[0].count() == 0
    assert hard_negatives.mine(vectors_of(spark, [(1, [1.0], 1), (2, [1.0], 2)]))[0].count() == 0
    rows = [(k, [float(2**22 + k), 1.0 - k, 2.0**20], k % 2) for k in range(60)]
    assert Counter(map(tuple, hard_negatives.mine(vectors_of(spark, rows))[0].collect())) == Counter(plain_negatives(rows))


def test_bounds_hold_scores():
    import pyarrow as pa

    rng = np.random.default_rng(9)
    x = np.floor(256 * rng.normal(size=(300, 32)) * np.exp(rng.normal(size=(300, 1))))
    r = hard_negatives.directions(x)
    batch = pa.RecordBatch.from_arrays([pa.array(range(300), pa.int64()), pa.array([1] * 300, pa.int64()), pa.array(x.tolist(), pa.list_(pa.float64()))], ["vec_id", "label", "vector"])
    rows = pa.Table.from_batches(hard_negatives._described({32: r})(iter([batch]))).append_column("no", pa.array(range(300)))
    side = hard_negatives.Side(rows, 32)
    exact = x @ x.T
    for k in (0, 1, 150, 299):
        low = high = exact[k]
        every = hard_negatives.bounds(side, np.full(300, k), side, slice(0, 300), low, high, np.ones((300, 300), bool))
        assert every.diagonal().all()
