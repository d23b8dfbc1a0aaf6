import datetime as dt
import hashlib
import math
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sextant.functions import vectors as V
from sextant.operators import leakage, metrics, permutation, retrieval, ridge, validation
from sextant.operators import memory as M

LIBRARY = [("a", 0, [1.0, 0.0]), ("b", 1, [0.0, 1.0]), ("c", 2, [-1.0, 0.0])]


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame(LIBRARY, "item_id string, family_id int, item_vector array<double>")


def queries(spark, *rows):
    return spark.createDataFrame(list(rows), "query_id string, vector array<double>")


def ranking(df):
    return [r.item_id for r in df.orderBy("query_id", "rank").collect()]


def test_cosine_order_scale_and_large_k(spark, items):
    assert ranking(retrieval.cosine_top_k(queries(spark, ("q", [0.9, 0.1])), items, 3)) == ["a", "b", "c"]
    assert ranking(retrieval.cosine_top_k(queries(spark, ("q", [90.0, 10.0])), items, 2)) == ["a", "b"]
    assert len(ranking(retrieval.cosine_top_k(queries(spark, ("q", [0.9, 0.1])), items, 100))) == 3


def test_equal_vectors_follow_the_id(spark, items):
    twice = items.unionByName(items.where("item_id = 'a'").withColumn("item_id", F.lit("0")))
    assert ranking(retrieval.cosine_top_k(queries(spark, ("q", [1.0, 0.0])), twice, 2)) == ["0", "a"]


def test_blocked_form_equals_expressions_whatever_shards_and_partitions(spark):
    rng = np.random.default_rng(1)
    lib = spark.createDataFrame([(f"i{k:03d}", 0, rng.normal(size=8).tolist()) for k in range(60)], "item_id string, family_id int, item_vector array<double>")
    q = queries(spark, *((f"q{k}", rng.normal(size=8).tolist()) for k in range(30)))
    want = {(r.query_id, r.rank): r.item_id for r in retrieval.cosine_expressions(q, lib, 7, 9).collect()}
    for most, parts in ((1 << 30, 1), (2000, 5)):
        got = {(r.query_id, r.rank): r.item_id for r in retrieval.cosine_top_k(q.repartition(parts), lib, 7, 9, most).collect()}
        assert got == want


def test_bad_libraries_are_errors(spark, items):
    for bad in (items.unionByName(items), items.unionByName(spark.createDataFrame([("d", 0, [1.0])], items.schema)), items.unionByName(spark.createDataFrame([("d", 0, [0.0, 0.0])], items.schema))):
        with pytest.raises(ValueError):
            retrieval.check_library(bad)
    with pytest.raises(ValueError):
        retrieval.cosine_top_k(queries(spark, ("q", [1.0, 0.0])), items, 0)


def test_random_ranking_depends_on_seed_and_key_alone(spark, items):
    q = queries(spark, ("q1", [1.0, 0.0]), ("q2", [0.0, 1.0])).withColumn("key", F.lit("same"))
    r = retrieval.random_top_k(q, items, 3, 7, "key")
    assert ranking(r.where("query_id = 'q1'")) == ranking(r.where("query_id = 'q2'"))
    assert ranking(retrieval.random_top_k(q.limit(1), items, 3, 7)) == ranking(retrieval.random_top_k(q, items, 3, 7).where("query_id = 'q1'"))


def test_fusion(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 1.0], None), ([2.0, 0.0], None, None), (None, None, None), ([1.0, 0.0], [1.0], None), ([1.0, 0.0], [-1.0, 0.0], None)], "t array<double>, i array<double>, a array<double>")
    m = [F.col(c) for c in "tia"]
    got = [r.f for r in df.select(V.fuse(m).alias("f")).collect()]
    assert got[0] == pytest.approx([math.sqrt(0.5)] * 2) and got[1] == [1.0, 0.0] and got[2:] == [None, None, None]
    errors = [r.e for r in df.select(V.fusion_errors(m).alias("e")).collect()]
    assert errors[0] == [] and "no modality available" in errors[2] and "dimensions differ" in errors[3] and "no direction" in errors[4]
    for names in ([], ["text", "text"], ["unknown"]):
        with pytest.raises(ValueError):
            V.select_modalities(names)


def test_finite_and_unit(spark):
    df = spark.createDataFrame([([1.0],), ([float("nan")],), ([float("inf")],), ([],), (None,)], "v array<double>")
    assert [r.f for r in df.select(V.is_finite(F.col("v")).alias("f")).collect()] == [True, False, False, False, False]


def test_fingerprints_follow_values_alone(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0], "a"), (1, [1.0, 2.0], "b"), (1, [2.0, 1.0], "c"), (2, [1.0, 2.0], "d")], "template_id int, v array<double>, event_id string")
    got = [r.f for r in df.orderBy("event_id").select(V.fingerprint(F.col("v")).alias("f")).collect()]
    assert got[0] == got[1] == got[3] != got[2] and len(got[0]) == 64
    keys = [r.f for r in df.orderBy("event_id").select(leakage.feature_key("v").alias("f")).collect()]
    assert keys[0] == keys[1] and len(set(keys)) == 3  # the template counts, the id doesn't


def test_metrics_by_hand(spark):
    r = spark.createDataFrame([("1", 1, "a"), ("1", 2, "b"), ("1", 3, "c"), ("2", 1, "x"), ("2", 2, "y"), ("2", 3, "z")], "query_id string, rank int, item_id string")
    w = spark.createDataFrame([("1", "a"), ("2", "z")], "query_id string, item_id string")
    m = metrics.summary(metrics.per_query(r, w, 3)).first()
    assert (m.recall_1, m.recall_k, m.ndcg_k) == (0.5, 1.0, 0.75) and m.mrr == pytest.approx(2 / 3)
    two = metrics.per_query(r.where("query_id = '1'"), spark.createDataFrame([("1", "a"), ("1", "c")], w.schema), 2).first()
    assert two.recall_k == 0.5


def test_a_query_without_hit_stays_in_the_mean(spark):
    r = spark.createDataFrame([("1", 1, "a")], "query_id string, rank int, item_id string")
    w = spark.createDataFrame([("1", "a"), ("2", "b")], "query_id string, item_id string")
    assert metrics.summary(metrics.per_query(r, w)).first().mrr == 0.5


def test_a_query_without_rows_counts_in_every_group(spark):
    r = spark.createDataFrame([("a", "1", 1, "x"), ("a", "2", 2, "y"), ("b", "1", 1, "x")], "ranker string, query_id string, rank int, item_id string")
    w = spark.createDataFrame([("1", "x", "s"), ("2", "y", "t"), ("3", "z", "t")], "query_id string, item_id string, split string")
    for cells, want in ((None, {"a", "b"}), (spark.createDataFrame([("a",), ("b",), ("c",)], "ranker string"), {"a", "b", "c"})):
        got = {(m.ranker, m.split): (m.n_events, m.mrr) for m in metrics.summary(metrics.per_query(r, w, 10, ("ranker", "split"), cells), ("ranker", "split")).collect()}
        assert got == {(k, s): (1 if s == "s" else 2, {("a", "s"): 1.0, ("a", "t"): 0.25, ("b", "s"): 1.0}.get((k, s), 0.0)) for k in want for s in "st"}


def test_grid_gaps_within_splits(spark):
    t = spark.createDataFrame([("a", "s", 3), ("b", "s", 3), ("c", "s", 2), ("a", "t", 9), ("b", "t", 9)], "ranker string, split string, n_events long")
    got = {(r.ranker, r.split, r.n) for r in metrics.grid_gaps(t, {"ranker": ["a", "b", "c"], "split": ["s", "t"]}, ("split",)).collect()}
    assert got == {("c", "s", 1), ("c", "t", 0)}


def test_memories_and_random_rankings_in_shards(spark, items):
    rng = np.random.default_rng(6)
    q = queries(spark, *((f"q{k}", rng.normal(size=4).tolist()) for k in range(20))).withColumn("as_of", F.lit("2024-02-01").cast("timestamp"))
    memory = spark.createDataFrame([(f"m{k:03d}", rng.normal(size=4).tolist(), f"i{k % 7}", 0.5 + k % 3 / 4, k % 9 != 0) for k in range(80)], "memory_id string, context_vector array<double>, item_id string, strength double, active boolean").withColumn("updated_at", F.lit("2024-01-01").cast("timestamp"))
    rows = lambda df: sorted((r.query_id, r["rank"], r.memory_id, r.score) for r in df.collect())
    whole = rows(retrieval.memory_top_k(q, memory, 5, 0.01, 9))
    assert len(whole) == 100 and whole == rows(retrieval.memory_top_k(q.repartition(3), memory, 5, 0.01, 9, 2000))
    for r in q.collect()[:3]:
        u = np.array(r.vector) / np.linalg.norm(r.vector)
        scored = [(-round(float(np.clip(u @ (np.array(m.context_vector) / np.linalg.norm(m.context_vector)), 0, 1)) * m.strength * float(np.exp(-0.01 * 31)), 9), m.item_id, m.memory_id) for m in memory.where("active").collect()]
        assert [x[2] for x in sorted(scored)[:5]] == [m for i, _, m, _ in whole if i == r.query_id]
    lib = spark.createDataFrame([(f"i{k:03d}", 0, [1.0, float(k)]) for k in range(50)], "item_id string, family_id int, item_vector array<double>")
    assert ranking(retrieval.random_top_k(q, lib, 4, 3)) == ranking(retrieval.random_top_k(q.repartition(3), lib.repartition(5), 4, 3))


def test_ranking_problems(spark):
    r = spark.createDataFrame([("1", 1, "a"), ("1", 2, "a"), ("2", 1, "x"), ("2", 3, "y")], "query_id string, rank int, item_id string")
    w = spark.createDataFrame([("1", "a"), ("2", "x"), ("3", "q")], "query_id string, item_id string")
    got = {(x.query_id, x.problem) for x in validation.ranking_problems(r, w, 2).collect()}
    assert got == {("1", "duplicate item"), ("2", "ranks not consecutive"), ("3", "empty ranking")}


def test_ridge_equals_a_direct_solution_whatever_the_partitions(spark):
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(80, 4)), rng.normal(size=(80, 3))
    df = spark.createDataFrame([(a.tolist(), b.tolist()) for a, b in zip(x, y, strict=True)], "x array<double>, y array<double>")
    xc, yc = x - x.mean(0), y - y.mean(0)
    w = np.linalg.solve(xc.T @ xc + np.eye(4), xc.T @ yc)
    for parts in (1, 6):
        model = ridge.fit(df.repartition(parts), "x", "y", 4)
        assert np.allclose(np.array(model.coefficients).T, w) and np.allclose(model.intercept, y.mean(0) - x.mean(0) @ w)
    p = df.limit(1).select("x", model.predict(F.col("x")).alias("p")).first()
    assert np.allclose(p.p, np.array(p.x) @ w + model.intercept)


def test_hybrid_shards_and_zero_memory_tail(spark, items):
    q = queries(spark, ("q", [0.9, 0.1])).withColumn("projected", F.col("vector")).withColumn("as_of", F.lit("2024-02-01").cast("timestamp"))
    memory = spark.createDataFrame([("m1", [1.0, 0.0], "b", 1.0), ("m2", [0.0, 1.0], "zz", 1.0)], "memory_id string, context_vector array<double>, item_id string, strength double")
    memory = memory.withColumn("updated_at", F.lit("2024-01-31").cast("timestamp")).withColumn("active", F.lit(True))
    cells = [{"cell": "m", "alpha": 0.0, "rate": None, "days": 0}, {"cell": "l", "alpha": 1.0, "rate": None, "days": 0}]
    for most in (1 << 30, 60):
        rows = retrieval.hybrid_top_k(q, items, memory, cells, 3, None, most).orderBy("cell", "rank").collect()
        assert [r.item_id for r in rows if r.cell == "m"] == ["b", "a", "c"]  # the tail of zeros follows the ids
        assert [r.item_id for r in rows if r.cell == "l"] == ["a", "b", "c"]


@pytest.mark.parametrize("n", [1, 2, 3, 7, 50, 101, 4096, 5003])
def test_a_keyed_permutation_has_every_number_once(spark, n):
    a, b = permutation.sides(n)
    assert n <= a * b < n + a
    got = spark.createDataFrame([("x",), ("y",), ("z",)], "k string").select(permutation.first(n, n, F.col("k"), 5).alias("p"), permutation.first(4, n, F.col("k"), 5).alias("few")).collect()
    assert all(sorted(r.p) == list(range(n)) and r.few == r.p[:4] for r in got)
    assert n < 50 or len({tuple(r.p) for r in got}) == 3


def test_first_images_are_spread_evenly(spark):
    first = spark.range(4000).select(permutation.first(1, 10, F.col("id").cast("string"), 1)[0].alias("x")).groupBy("x").count().collect()
    assert len(first) == 10 and all(300 < r["count"] < 500 for r in first)
    plan = spark.range(9).select(permutation.first(3, 1000, F.col("id").cast("string"), 1))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_random_rankings_are_whole_and_need_distinct_ids(spark):
    lib = spark.createDataFrame([(f"i{k:03d}",) for k in range(23)], "item_id string")
    q = spark.createDataFrame([("a",), ("b",)], "query_id string")
    got = retrieval.random_top_k(q, lib, 50, 9).collect()
    assert len(got) == 46 and all(len({r.item_id for r in got if r.query_id == x}) == 23 and sorted(r["rank"] for r in got if r.query_id == x) == list(range(1, 24)) for x in "ab")
    with pytest.raises(ValueError):
        retrieval.random_top_k(q, lib.union(lib), 3, 9)


def clouds(n, dim, groups, seed):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(groups, dim))
    return (centre[np.arange(n) % groups] + 0.1 * rng.normal(size=(n, dim))).round(2)


def test_pruned_rankings_equal_the_brute_form(spark):
    """Clusters, ties between equal vectors, opposite vectors and lists that are longer than a cluster."""
    v = clouds(3000, 8, 40, 1)
    v[1500:1600] = v[7]
    v[2000:2010] = -v[7]
    lib = spark.createDataFrame([(f"i{k * 7919 % 3000:04d}", k % 3, x.tolist()) for k, x in enumerate(v)], "item_id string, family_id int, item_vector array<double>")
    names = np.array([f"i{k * 7919 % 3000:04d}" for k in range(3000)])
    asked = np.vstack([clouds(60, 8, 40, 1), v[7], -v[7], np.random.default_rng(2).normal(size=(20, 8))])
    q = queries(spark, *((f"q{k:03d}", x.tolist()) for k, x in enumerate(asked)))
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    scores = np.round(unit(asked) @ unit(v).T, 9) + 0.0
    for k in (5, 120, 3000):
        got = {}
        for r in retrieval.cosine_top_k(q, retrieval.prepare(lib), k, 9).collect():
            got.setdefault(r.query_id, {})[r["rank"]] = r.item_id
        for n in range(len(asked) if k < 3000 else 3):
            best = np.lexsort((names, -scores[n]))[:k]
            assert [got[f"q{n:03d}"][i] for i in range(1, k + 1)] == names[best].tolist()
    for most in (40_000, 1 << 27):
        library = retrieval.prepare(lib, most)
        assert ranking(retrieval.cosine_top_k(q, library, 7, 9)) == ranking(retrieval.cosine_top_k(q.repartition(5), lib, 7, 9))
    w = retrieval.scored_share(q, retrieval.prepare(lib), 5, 9).first()
    assert w.pairs == 3000 * len(asked) and w.scored < 0.35 * w.pairs


def test_pruned_memories_equal_the_brute_form(spark):
    v = clouds(2500, 6, 30, 3)
    rng = np.random.default_rng(4)
    strength, day = rng.uniform(0.1, 1, 2500), rng.integers(1, 28, 2500)
    rows = [(f"m{k:04d}", x.tolist(), f"i{k % 50}", float(strength[k]), True, f"2024-01-{day[k]:02d}") for k, x in enumerate(v)]
    memory = spark.createDataFrame(rows, "memory_id string, context_vector array<double>, item_id string, strength double, active boolean, at string").withColumn("updated_at", F.col("at").cast("timestamp"))
    asked = clouds(25, 6, 30, 3)
    q = queries(spark, *((f"q{k}", x.tolist()) for k, x in enumerate(asked))).withColumn("as_of", F.lit("2024-02-01").cast("timestamp"))
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    similar = np.clip(unit(asked) @ unit(v).T, 0, 1)
    names, items_of = np.array([r[0] for r in rows]), np.array([r[2] for r in rows])
    for rate in (None, 0.05, -0.05):
        score = np.round(similar * strength * (1 if rate is None else np.maximum(np.exp(-rate * (32 - day)), 5e-324)), 9)
        got = {}
        for r in retrieval.memory_top_k(q, memory, 6, rate, 9).collect():
            got.setdefault(r.query_id, {})[r["rank"]] = r.memory_id
        for n in range(25):
            assert [got[f"q{n}"][i] for i in range(1, 7)] == names[np.lexsort((names, items_of, -score[n]))[:6]].tolist()


def test_the_best_of_a_label_in_shards(spark):
    v = clouds(400, 5, 9, 6)
    labels = [f"i{0 if k % 3 else k % 7}" for k in range(400)]  # one label has two thirds
    memory = spark.createDataFrame([(labels[k], f"m{k}", x.tolist()) for k, x in enumerate(v)], "item_id string, memory_id string, context_vector array<double>")
    asked = clouds(30, 5, 9, 7)
    q = spark.createDataFrame([(f"q{k}", f"i{k % 9}", x.tolist()) for k, x in enumerate(asked)], "query_id string, item_id string, vector array<double>")
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    sims = np.clip(unit(asked) @ unit(v).T, 0, 1)
    want = {f"q{k}": sims[k][[x == f"i{k % 9}" for x in labels]].max() for k in range(30) if k % 9 < 7}
    for most in (1 << 27, 5000):
        got = {r.query_id: r.score for r in retrieval.best_of_label(q.repartition(3), memory, most).collect()}
        assert got == pytest.approx(want, abs=1e-12)
    assert retrieval.best_of_label(q, memory.limit(0)).count() == 0
    with pytest.raises(ValueError):
        retrieval.cosine_expressions(q.select("query_id", "vector"), memory.select("item_id", F.col("context_vector").alias("item_vector")), 3, most=100)


def _hybrid_sides(monkeypatch, n, records, dim, seed=5):
    rng = np.random.default_rng(seed)
    ids, own = [f"i{x:05d}" for x in rng.permutation(n)], np.minimum(rng.exponential(n / 8, records).astype(int), n - 1)
    rows = lambda x: pa.array(x.tolist(), pa.list_(pa.float64()))
    items = pa.table({"item_id": ids, "item_vector": rows(np.round(rng.normal(size=(n, dim))) + 0.5)})
    memory = {"item_id": [ids[x] for x in own], "context_vector": rows(np.round(rng.normal(size=(records, dim))) + 0.5), "strength": rng.uniform(0.1, 1, records), "updated": (rng.uniform(0, 60, records) * 86_400e6).astype(int)}
    monkeypatch.setattr(retrieval, "read_shard", lambda uri: pa.table(memory))
    side = retrieval._both_sides(items, "")
    monkeypatch.setattr(retrieval, "held", lambda *x: side)
    return rng, ids, own, items, memory, rows


@pytest.mark.parametrize(("layers", "block"), [(64, 1 << 19), (2, 700), (0, 1)])
def test_hybrid_by_layers_equals_a_plain_pass(monkeypatch, layers, block):
    monkeypatch.setattr(retrieval, "LAYERS", layers)
    monkeypatch.setattr(retrieval, "HYBRID_SCORES", block)
    monkeypatch.setattr(retrieval, "HYBRID_ROWS", 50)
    rng, ids, own, items, memory, rows = _hybrid_sides(monkeypatch, 120, 200, 3)
    asked, projected, at = rng.normal(size=(9, 3)), rng.normal(size=(9, 3)), np.where(np.arange(9) % 2, 61, 70) * 86_400e6
    batch = pa.record_batch([pa.array([f"q{x}" for x in range(9)]), rows(asked), rows(projected), pa.array(at.astype(int))], ["query_id", "vector", "projected", "as_of"])
    # with a rate of 20, weights meet their floor
    cells = [{"cell": f"{a}|{r}|{n}", "alpha": a, "rate": r, "days": n} for a in (0.0, 0.5, 1.0) for r in (None, 0.01, 20.0) for n in (0, 30)]
    got = {(r["query_id"], r["cell"], r["rank"]): (r["item_id"], r["score"]) for b in retrieval._hybrid("", "", cells, 10, 9)(iter([batch])) for r in b.to_pylist()}
    unit = lambda x: np.array(x, float) / np.sqrt((np.array(x, float) ** 2).sum(axis=1, keepdims=True))
    by_item = np.clip(unit(projected) @ unit(items.column("item_vector").to_pylist()).T, 0, 1)
    similar = np.clip(unit(asked) @ unit(memory["context_vector"].to_pylist()).T, 0, 1)
    want = {}
    for c in cells:
        age = (at[:, None] + c["days"] * 86_400e6 - memory["updated"][None, :]) / 86_400e6
        each = similar * memory["strength"] * (1 if c["rate"] is None else np.maximum(np.exp(-c["rate"] * age), 2.2250738585072014e-308))
        best = np.zeros_like(by_item)
        np.maximum.at(best, (slice(None), own), each)
        total = np.round(c["alpha"] * by_item + (1 - c["alpha"]) * np.clip(best, 0, 1), 9)
        for q in range(9):
            for rank, x in enumerate(sorted(range(120), key=lambda x: (-total[q, x], ids[x]))[:10], 1):
                want[f"q{q}", c["cell"], rank] = (ids[x], pytest.approx(total[q, x], abs=2e-9))
    assert got == want


def test_hybrid_blocks_are_small(monkeypatch):
    rng, *_, rows = _hybrid_sides(monkeypatch, 2000, 2000, 16)
    q = rows(rng.normal(size=(2000, 16)))
    batch = pa.record_batch([pa.array([str(x) for x in range(2000)]), q, q, pa.array([61 * 86_400_000_000] * 2000)], ["query_id", "vector", "projected", "as_of"])
    tracemalloc.start()
    rows_out = sum(b.num_rows for b in retrieval._hybrid("", "", [{"cell": "c", "alpha": 0.5, "rate": 0.01, "days": 7}], 10, 9)(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows_out == 20_000 and peak < 48 << 20


def test_queries_of_one_file_are_ranked_by_all_cores(spark, items):
    q = spark.createDataFrame([("q", [1.0, 0.0], [1.0, 0.0], dt.datetime(2024, 2, 1))], "query_id string, vector array<double>, projected array<double>, as_of timestamp").coalesce(1)
    memory = spark.createDataFrame([], M.MEMORY)
    assert retrieval.hybrid_top_k(q, items, memory, [{"cell": "c", "alpha": 0.5, "rate": None, "days": 0}], 3).rdd.getNumPartitions() >= 4


def test_shuffled_rankings_order_the_whole_library(spark):
    ids = [f"i{k:03d}" for k in range(60)] + ["ä", "x y"]
    lib = spark.createDataFrame([(x, 0, [1.0, float(n)]) for n, x in enumerate(ids)], "item_id string, family_id int, item_vector array<double>")
    q = spark.createDataFrame([(f"q{k}", f"k{k % 7}") for k in range(30)], "query_id string, key string")
    order = lambda key: sorted(ids, key=lambda x: hashlib.sha256(f"5:{key}:{x}".encode()).digest())
    for k, most, parts in ((4, 1 << 30, 1), (4, 2000, 5), (100, 2000, 2)):
        rows = retrieval.shuffled_top_k(q.repartition(parts), lib, k, 5, "key", most).collect()
        got = {(r.query_id, r["rank"]): r.item_id for r in rows}
        assert got == {(f"q{n}", at): x for n in range(30) for at, x in enumerate(order(f"k{n % 7}")[:k], 1)} and len(rows) == len(got)
    with pytest.raises(ValueError):
        retrieval.shuffled_top_k(q, lib, 0, 5)
    with pytest.raises(ValueError):
        retrieval.shuffled_top_k(q, lib.union(lib), 3, 5)
