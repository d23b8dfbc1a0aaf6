import datetime as dt
import hashlib
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from sextant.operators import evaluation as E
from sextant.operators import leakage, policy, splits, validation
from sextant.operators import memory as M
from sextant.operators.ranks import numbered
from sextant.sources import exports, tables
from sextant.streaming import jobs
from sextant.streaming.corrections import VERSIONS as log_versions
from sextant.streaming.corrections import CorrectionLog

DATA = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables aren't there")


def t(day, hour=0):
    return dt.datetime(2024, 1, day, hour)


@pytest.fixture(scope="module")
def memory(spark):
    rows = [("m1", [1.0, 0.0], "x", t(1), t(1), 1.0, 0, True), ("m2", [0.0, 1.0], "y", t(1), t(10), 1.0, 0, True), ("m3", [1.0, 0.0], "z", t(1), t(1), 1.0, 0, False)]
    return spark.createDataFrame(rows, M.MEMORY)


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([("x", 0, [1.0, 0.0]), ("y", 1, [0.0, 1.0])], "item_id string, family_id int, item_vector array<double>")


def corrections(spark, rows):
    return spark.createDataFrame(rows, "seq long, correction_id string, memory_id string, corrected_at timestamp, reason string, new_item_id string, new_vector array<double>, new_strength double")


ROWS = [
    (1, "c1", "m1", t(2), "r", "y", None, None),
    (2, "c2", "m1", t(1, 12), "r", "x", None, None),  # goes back in time
    (3, "c1", "m2", t(11), "r", "x", None, None),  # id already used
    (4, "c3", "m9", t(11), "r", None, None, 0.5),  # unknown memory
    (5, "c4", "m2", t(12), " ", None, None, 0.5),  # no reason
    (6, "c4", "m2", t(12), "r", None, None, 0.5),  # the failed id may be used again
    (7, "c5", "m1", t(3), "r", "nope", None, None),  # unknown item
    (8, "c6", "m1", t(3), "r", None, [1.0], None),  # wrong dimension
    (9, "c7", "m1", t(3), "r", None, [0.0, 1.0], None),
]
REJECTED = {2, 3, 4, 5, 7, 8}


def test_similar_and_recent_memories_first(spark, memory):
    q = spark.createDataFrame([("q", [0.9, 0.1], t(11))], "query_id string, vector array<double>, as_of timestamp")
    assert [r.memory_id for r in M.top_memories(q, memory, 5, None).orderBy("rank").collect()] == ["m1", "m2"]
    same = memory.where("active").withColumn("context_vector", F.array(F.lit(1.0), F.lit(0.0)))
    assert M.top_memories(q, same, 1, 0.2).first().memory_id == "m2"
    assert M.top_memories(q, same, 1, None).first().memory_id == "m1"
    assert M.early_queries(q.withColumn("as_of", F.lit(t(9))), memory).count() == 1 and M.sizes(memory).first().active == 2


def test_corrections_are_folded_in_arrival_order(spark, memory, items):
    judged = {r.seq: r.error for r in M.judge_corrections(memory, corrections(spark, ROWS), items, 2).collect()}
    assert {s for s, e in judged.items() if e} == REJECTED
    accepted = corrections(spark, [r for r in ROWS if r[0] not in REJECTED])
    after = {r.memory_id: r for r in M.apply_corrections(memory, accepted).collect()}
    assert after["m1"].item_id == "y" and after["m1"].context_vector == [0.0, 1.0] and after["m1"].correction_count == 2 and after["m1"].created_at == t(1)
    assert after["m2"].strength == 0.5 and after["m2"].updated_at == t(12) and after["m3"].correction_count == 0
    audit = M.history(memory, accepted, "h").orderBy("seq").collect()
    assert [(a.previous_item_id, a.corrected_item_id, a.resulting_count) for a in audit] == [("x", "y", 1), ("y", "y", 1), ("y", "y", 2)]
    assert audit[2].previous_hash != audit[2].corrected_hash
    assert M.replacement_violations(memory, M.apply_corrections(memory, accepted)).isEmpty()


@pytest.mark.parametrize("keep_ids_ms", [None, 3_600_000])
def test_stream_equals_batch_per_memory(spark, memory, items, tmp_path, keep_ids_ms):
    rows = [r for r in ROWS if r[0] != 3]  # ids across memories need the log of corrections
    source = str(tmp_path / "in")
    for k, part in enumerate((rows[:4], rows[4:])):
        corrections(spark, part).coalesce(1).write.parquet(f"{source}/part={k}")
    stream = spark.readStream.schema(corrections(spark, rows).schema).option("maxFilesPerTrigger", 1).parquet(f"{source}/*")
    job = jobs.correct_stream(stream, memory, items, 2, keep_ids_ms).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "log"))
    if keep_ids_ms is None:
        job.trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
    else:  # state that expires keeps the query running
        run = job.start(str(tmp_path / "out"))
        for _ in range(120):
            run.awaitTermination(1)
            if sum(p.numInputRows for p in run.recentProgress) >= len(rows):
                break
        run.stop()
    got = {r.seq: r.error for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {r.seq: r.error for r in M.judge_corrections(memory, corrections(spark, rows), items, 2).collect()}
    assert {s for s, e in got.items() if e} == {s for s, e in want.items() if e} and set(got) == set(want)


def audit_of(df):
    return {r.seq: (r.memory_id, r.correction_id, r.error) for r in df.collect()}


@pytest.mark.parametrize("sizes", [(9,), (4, 5), (1,) * 9])
def test_the_correction_log_equals_the_batch(spark, memory, items, tmp_path, sizes):
    source, rows = str(tmp_path / "in"), list(ROWS)
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(corrections(spark, rows).schema).option("maxFilesPerTrigger", 1).parquet(source)
    log = CorrectionLog(memory, items, 2, str(tmp_path / "log"), "f" * 64, snapshot_every=3)
    for n in sizes:
        corrections(spark, rows[:n]).coalesce(1).write.mode("append").parquet(source)
        rows = rows[n:]
        log.start(stream).awaitTermination()  # started again for each file, from its checkpoint
    assert audit_of(log.audit()) == audit_of(M.judge_corrections(memory, corrections(spark, ROWS), items, 2))
    assert {s for s, x in audit_of(log.audit()).items() if x[2]} == REJECTED
    accepted = corrections(spark, [r for r in ROWS if r[0] not in REJECTED])
    state = lambda df: {r.memory_id: (r.item_id, r.context_vector, r.strength, r.updated_at, r.correction_count, r.active, r.created_at) for r in df.collect()}
    assert state(log.current()) == state(M.apply_corrections(memory, accepted))
    told = {r.seq: (r.previous_item_id, r.corrected_item_id, r.resulting_count) for r in log.audit().where("error is null").collect()}
    assert told == {r.seq: (r.previous_item_id, r.corrected_item_id, r.resulting_count) for r in M.history(memory, accepted, "f" * 64).collect()}


def test_a_batch_that_is_judged_again_counts_once(spark, memory, items, tmp_path):
    log = CorrectionLog(memory, items, 2, str(tmp_path / "log"), snapshot_every=1)
    for number, part in ((0, ROWS[:4]), (1, ROWS[4:]), (1, ROWS[4:]), (2, [])):
        log.apply(corrections(spark, part), number)
    assert audit_of(log.audit()) == audit_of(M.judge_corrections(memory, corrections(spark, ROWS), items, 2))
    assert {r.memory_id: r.correction_count for r in log.current().collect()} == {"m1": 2, "m2": 1, "m3": 0}
    (tmp_path / "log/records/batch=1/_SUCCESS").unlink()  # a batch that broke off isn't read
    assert {r.memory_id: r.correction_count for r in log._log("records", log_versions, 9).collect()} == {"m1": 2, "m2": 1}


def test_row_errors_of_later_batches_are_those_against_the_start(spark, memory, items, tmp_path):
    rows = [
        (1, "c1", "m1", t(9), "r", "y", None, None),
        (2, "c2", "m1", t(5), " ", None, None, 1.5),  # late only against what the first one changed
        (3, "c1", "m1", t(6), "r", None, None, 0.5),  # late, too, but its id was used
        (4, "c3", "m1", t(7), "r", None, None, 0.5),
        (5, "c4", "m1", t(1) - dt.timedelta(days=1), " ", None, None, 0.5),  # late against the start
    ]
    want = audit_of(M.judge_corrections(memory, corrections(spark, rows), items, 2))
    assert [want[s][2] for s in range(1, 6)] == [None, "blank reason, strength outside (0, 1]", "duplicate correction_id", "before last update", "blank reason, before last update"]
    log = CorrectionLog(memory, items, 2, str(tmp_path / "log"), snapshot_every=2)
    for number, row in enumerate(rows):
        log.apply(corrections(spark, [row]), number)
    assert audit_of(log.audit()) == want


def test_ids_are_forgotten_after_a_while(spark, memory, items, tmp_path):
    log = CorrectionLog(memory, items, 2, str(tmp_path / "log"), forget="2 days", snapshot_every=1)
    log.apply(corrections(spark, [(1, "c1", "m1", t(2), "r", "y", None, None)]), 0)
    log.apply(corrections(spark, [(2, "c2", "m1", t(10), "r", "x", None, None), (3, "c1", "m1", t(11), "r", "x", None, None)]), 1)
    log.apply(corrections(spark, [(4, "c1", "m2", t(11), "r", "x", None, None), (5, "c2", "m2", t(12), "r", "x", None, None)]), 2)
    assert {s for s, x in audit_of(log.audit()).items() if x[2]} == {3, 5}


def test_as_of_and_decoys(spark, memory):
    versions = spark.createDataFrame([("m1", t(1), "a"), ("m1", t(5), "b")], "memory_id string, updated_at timestamp, item_id string")
    q = spark.createDataFrame([("m1", t(4)), ("m1", t(5)), ("m2", t(4))], "memory_id string, as_of timestamp")
    assert sorted((r.memory_id, r.as_of.day, r.item_id or "") for r in M.as_of(versions, q).collect()) == [("m1", 4, "a"), ("m1", 5, "b"), ("m2", 4, "")]
    assert {r.item_id: r.decoy_item_id for r in M.decoys(memory).collect()} == {"x": "y", "y": "z", "z": "x"}
    with pytest.raises(ValueError):
        M.decoys(memory.limit(1))


LIMITS = [("one", True, 1.0, 30.0, 20.0, 1.0), ("two", True, 0.5, 20.0, 25.0, 1.5), ("off", False, 0.0, 0.0, 0.0, 0.0)]
BASE = {"item_id": "one", "concentration_ppm": 0.5, "duration_seconds": 10.0, "environment_volume_m3": 30.0, "ventilation_ach": 2.0, "user_consent": True}
TWO = {"item_id": "two", "concentration_ppm": 0.25, "duration_seconds": 10.0}
NEVER = dict.fromkeys(("concentration_ppm", "duration_seconds", "environment_volume_m3", "ventilation_ach", "user_consent"))
# The published conformance cases, as changes to the base request, with outcome and rule.
CASES = [
    ({}, "ALLOW", "RULE-ALLOW-001"), (TWO, "ALLOW", "RULE-ALLOW-001"),
    ({"concentration_ppm": 1.0, "duration_seconds": 30.0, "environment_volume_m3": 20.0, "ventilation_ach": 1.0}, "ALLOW", "RULE-ALLOW-001"),
    ({"item_id": "two", "concentration_ppm": 0.5, "duration_seconds": 20.0, "environment_volume_m3": 25.0, "ventilation_ach": 1.5}, "ALLOW", "RULE-ALLOW-001"),
    ({"user_consent": False}, "BLOCK", "RULE-CONSENT-001"),
    ({"item_id": "none", "concentration_ppm": 0.1, "duration_seconds": 5.0}, "BLOCK", "RULE-ITEM-001"),
    ({"item_id": "off", "concentration_ppm": 0.0, "duration_seconds": 0.0}, "BLOCK", "RULE-ITEM-002"),
    ({"concentration_ppm": 1.000001}, "BLOCK", "RULE-LIMIT-001"), (TWO | {"concentration_ppm": 0.500001}, "BLOCK", "RULE-LIMIT-001"),
    ({"duration_seconds": 30.000001}, "BLOCK", "RULE-LIMIT-002"), (TWO | {"duration_seconds": 20.000001}, "BLOCK", "RULE-LIMIT-002"),
    ({"environment_volume_m3": 19.999999}, "BLOCK", "RULE-ENV-001"), (TWO | {"environment_volume_m3": 24.999999}, "BLOCK", "RULE-ENV-001"),
    ({"ventilation_ach": 0.999999}, "BLOCK", "RULE-ENV-002"), (TWO | {"ventilation_ach": 1.499999}, "BLOCK", "RULE-ENV-002"),
    ({"concentration_ppm": None}, "REQUIRE_MISSING_INFORMATION", "RULE-MISSING-001"), ({"duration_seconds": None}, "REQUIRE_MISSING_INFORMATION", "RULE-MISSING-001"),
    ({"environment_volume_m3": None}, "REQUIRE_MISSING_INFORMATION", "RULE-MISSING-001"), ({"ventilation_ach": None}, "REQUIRE_MISSING_INFORMATION", "RULE-MISSING-001"),
    ({"user_consent": None}, "REQUIRE_MISSING_INFORMATION", "RULE-MISSING-001"), (NEVER, "REQUIRE_MISSING_INFORMATION", "RULE-MISSING-001"),
    ({"concentration_ppm": None, "user_consent": False}, "REQUIRE_MISSING_INFORMATION", "RULE-MISSING-001"),
    ({"item_id": "none", "concentration_ppm": 0.1, "duration_seconds": 5.0, "user_consent": False}, "BLOCK", "RULE-CONSENT-001"),
    ({"item_id": "off", "concentration_ppm": 100.0, "duration_seconds": 100.0, "environment_volume_m3": 1.0, "ventilation_ach": 0.0}, "BLOCK", "RULE-ITEM-002"),
    ({"concentration_ppm": 2.0, "duration_seconds": 60.0, "environment_volume_m3": 10.0, "ventilation_ach": 0.5}, "BLOCK", "RULE-LIMIT-001"),
    ({"item_id": "two", "concentration_ppm": 1.0, "duration_seconds": 40.0, "environment_volume_m3": 10.0, "ventilation_ach": 0.5}, "BLOCK", "RULE-LIMIT-001"),
]


def test_policy_ladder_and_conformance(spark):
    schema = "request_id string, item_id string, concentration_ppm double, duration_seconds double, environment_volume_m3 double, ventilation_ach double, user_consent boolean, expected_outcome string"
    rows = [(str(k), *(BASE | c).values(), o) for k, (c, o, _) in enumerate(CASES)]
    cases, limits = spark.createDataFrame(rows, schema), policy.limits_table(spark, LIMITS)
    got = {r.request_id: (r.outcome, r.rule_ids) for r in policy.decide(cases, limits, "h").collect()}
    assert got == {str(k): (o, [rule]) for k, (_, o, rule) in enumerate(CASES)}
    row = policy.conformance(policy.decide(cases, limits), cases).first()
    assert row.passed and row.exact == len(CASES) and row.false_allow_rate == 0
    wrong = cases.withColumn("expected_outcome", F.when(F.col("request_id") == "0", "BLOCK").when(F.col("request_id") == "4", "ALLOW").otherwise(F.col("expected_outcome")))
    row = policy.conformance(policy.decide(cases, limits), wrong).first()
    assert (row.false_allows, row.false_blocks, row.passed) == (1, 1, False) and row.false_block_rate == pytest.approx(1 / 4)
    assert policy.decide(cases.where("request_id = '18'"), limits).first().explanation == "missing: ventilation_ach"
    assert len(CASES) == 26 and [o for _, o, _ in CASES].count("ALLOW") == 4 and [o for _, o, _ in CASES].count("BLOCK") == 15
    with pytest.raises(ValueError):
        policy.limits_table(spark, [LIMITS[0], LIMITS[0]])


def test_views_blend_by_tier(spark):
    one, two = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]
    p = spark.createDataFrame([("l", 1, "x", 0, one, one, one, two, two, two)], "latent_event_id string, template_id int, target_item_id string, target_family_id int, id_text array<double>, id_image array<double>, id_audio array<double>, sev_text array<double>, sev_image array<double>, sev_audio array<double>")
    got = {r.tier: r.text_vector for r in E.views(p).collect()}
    assert got["mild"] == pytest.approx([0.75 / np.hypot(0.75, 0.25), 0.25 / np.hypot(0.75, 0.25), 0]) and got["moderate"] == pytest.approx([np.sqrt(0.5)] * 2 + [0]) and got["severe"] == two
    assert E.view_problems(E.views(p)).isEmpty()
    opposite = p.withColumn("sev_text", F.transform("id_text", lambda x: -x))
    assert [r.text_vector for r in E.views(opposite).where("tier = 'moderate'").collect()] == [None]


def test_bootstrap_chunks_equal_the_whole_and_poisson_is_near(spark):
    v = np.random.default_rng(5).normal(size=40)
    whole = v[np.random.default_rng(E.SEED).integers(0, 40, (1000, 40))].mean(1)
    assert np.array_equal(E.resample_means(v, 1000), whole)
    d = spark.createDataFrame([("r", f"l{k:02d}", float(x)) for k, x in enumerate(v)], "ranker string, latent_event_id string, difference double")
    exact, near = E.bootstrap(d, ["ranker"]).first(), E.bootstrap_poisson(d.repartition(3), ["ranker"], resamples=2000).first()
    assert exact.n == near.n == 40 and abs(exact.ci_lower - near.ci_lower) < 0.08 and abs(exact.ci_upper - near.ci_upper) < 0.08
    zero = E.contrasts(spark.createDataFrame([("r", "c", 0.0), ("r", "c", 0.0)], "ranker string, contrast string, difference double")).first()
    assert (zero.better, zero.tied, zero.worse, zero.mean_diff) == (0, 2, 0, 0.0)


# Differences of reciprocal ranks of a published evaluation, mild less moderate and mild less severe, in order of events.
MILD_MODERATE = [0, 5 / 6, 0, 7 / 8, 2 / 3, 2 / 3, 1 / 2, 1, 0, 5 / 6, 3 / 4, 1 / 2, 0, 0, 1 / 2, 2 / 3, 0, 1 / 2, 1 / 2, 1, 0, 1, 2 / 3, 1, 2 / 15, 1 / 2, 0, 1 / 3, 5 / 6, 5 / 6, 2 / 3, 1 / 2, 4 / 5, 0, 3 / 4, 2 / 3, 2 / 5, 0, 0, 2 / 3]
MILD_SEVERE = [1, 1, 0, *[1] * 21, 1 / 3, 1, 1, 1 / 3, *[1] * 5, 4 / 5, 1, 1, 1 / 2, 1, 1, 1]


def test_published_intervals(spark):
    wide = {"mild_minus_moderate": MILD_MODERATE, "mild_minus_severe": MILD_SEVERE, "moderate_minus_severe": [s - m for m, s in zip(MILD_MODERATE, MILD_SEVERE, strict=True)]}
    d = spark.createDataFrame([("ridge", c, f"l{k:02d}", float(x)) for c, v in wide.items() for k, x in enumerate(v)], "ranker string, contrast string, latent_event_id string, difference double").repartition(5)
    got = {r.contrast: (r.ci_lower, r.ci_upper) for r in E.bootstrap(d, ["ranker", "contrast"]).collect()}
    want = {"mild_minus_moderate": (0.3785364583333334, 0.5956302083333334), "moderate_minus_severe": (0.3291666666666667, 0.5477135416666665), "mild_minus_severe": (0.8491666666666667, 0.9833333333333332)}
    assert all(got[c] == pytest.approx(want[c], abs=1e-12) for c in want)
    stats = {r.contrast: (r.mean_diff, r.better, r.tied, r.worse) for r in E.contrasts(d).collect()}
    assert stats["mild_minus_moderate"] == (pytest.approx(0.4885416666666667), 29, 11, 0) and stats["moderate_minus_severe"] == (pytest.approx(0.435625), 34, 6, 0) and stats["mild_minus_severe"] == (pytest.approx(0.9241666666666667), 39, 1, 0)


def test_numbers_by_ranges_equal_a_window(spark):
    from pyspark.sql import Window

    rows = spark.range(500).select((F.col("id") % 3).alias("g"), F.sha2(F.col("id").cast("string"), 256).alias("h"), "id").unionByName(spark.range(1).select(F.lit(9).cast("long").alias("g"), F.lit("x").alias("h"), "id"))
    want = {(r.g, r.id): r.n for r in rows.withColumn("n", F.row_number().over(Window.partitionBy("g").orderBy("h", "id"))).collect()}
    assert {(r.g, r.id): r.n for r in numbered(rows.repartition(3), ["g"], ["h", "id"], 7).collect()} == want


def plain_mmd(v, first):
    d = ((v[:, None] - v[None]) ** 2).sum(2)
    upper = d[np.triu_indices(len(v), 1)]
    width = np.median(upper[upper > 0])
    k = np.exp(-d / (2 * width))
    return k[np.ix_(first, first)].mean() + k[np.ix_(~first, ~first)].mean() - 2 * k[np.ix_(first, ~first)].mean(), width


def test_permutations_tell_a_shift_from_none(spark):
    v = np.random.default_rng(3).normal(size=(60, 4)) / 4
    v[:, 0] += 1
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    w = v.copy()
    w[30:, 1] += 1
    for x, low, high in ((v, 0.05, 1.0), (w / np.linalg.norm(w, axis=1, keepdims=True), 0.0, 0.05)):
        d = spark.createDataFrame([(f"e{k}", "a" if k < 30 else "b", r.tolist()) for k, r in enumerate(x)], "event_id string, split string, v array<double>")
        t = E.mmd_permutation_test(d, "v", "a", "b", 40, block=16).first()
        assert low <= t.p <= high and t.mmd2 == pytest.approx(plain_mmd(x, np.arange(60) < 30)[0], abs=1e-9)


def test_mislabelled_records_and_their_restoration(spark, memory, items):
    wrong = M.decoys(memory)
    bad = M.apply_single(memory, M.corruptions(memory, wrong))
    assert {r.memory_id: r.item_id for r in bad.collect()} == {"m1": "y", "m2": "z", "m3": "x"}
    assert {r.memory_id for r in M.changed_records(memory, bad).collect()} == {"m1", "m2", "m3"}
    back = M.restorations(memory)
    after = M.apply_single(bad, back)
    assert M.changed_records(memory, after).isEmpty() and M.changed_records(memory, after.where("memory_id <> 'm1'")).first().memory_id == "m1"
    audit = {r.memory_id: (r.previous_item_id, r.corrected_item_id, r.resulting_count) for r in M.history(bad, back, "h").collect()}
    assert audit == {"m1": ("y", "x", 2), "m2": ("z", "y", 2), "m3": ("x", "z", 2)}
    assert [(r.memory_id, r.problem) for r in M.build_problems(memory.unionByName(memory.where("memory_id = 'm1'")), 2).collect()] == [("m1", "duplicate memory_id")]
    assert {r.problem for r in M.build_problems(memory, 3).collect()} == {"wrong dimension"}


def test_repeated_ids_across_memories_settle(spark, memory, items):
    # c1 moves m1 to day 5, but repeats an accepted id: so day 3 is in time again
    rows = [(1, "a", "m2", t(11), "r", None, None, 0.5), (2, "a", "m1", t(5), "r", None, None, 0.5), (3, "b", "m1", t(3), "r", None, None, 0.4), (4, "b", "m2", t(12), "r", None, None, 0.4), (5, "c", "m1", t(2), "r", None, None, 0.4)]
    got = {r.seq: r.error for r in M.judge_corrections(memory, corrections(spark, rows), items, 2).collect()}
    assert got == {1: None, 2: "duplicate correction_id", 3: None, 4: "duplicate correction_id", 5: "before last update"}


def test_strict_rows_and_single_cells(spark):
    rows = spark.createDataFrame([(1, []), (2, ["bad"])], "k int, errors array<string>")
    assert validation.strict(rows.where("k = 1")).columns == ["k"] and validation.one_cell(rows, k=2).count() == 1
    with pytest.raises(ValueError):
        validation.strict(rows)
    with pytest.raises(KeyError):
        validation.one_cell(rows, k=3)


def test_repeats_within_the_watermark_are_dropped(spark, tmp_path):
    rows = [(1, "a", "m1", t(2), "r", "y", None, None), (2, "a", "m2", t(2), "r", "y", None, None), (3, "b", "m2", t(2), "r", "y", None, None)]
    corrections(spark, rows).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = jobs.drop_repeats(spark.readStream.schema(corrections(spark, rows).schema).parquet(str(tmp_path / "in")))
    job = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start(str(tmp_path / "out"))
    job.awaitTermination()
    assert sorted(r.correction_id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a", "b"]


@pytest.mark.parametrize("block", [7, 512])
def test_blocked_mmd_equals_all_pairs(spark, block):
    v = np.random.default_rng(8).normal(size=(45, 3))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    v[40:] = v[0]  # distances of 0 are no part of the median
    d = spark.createDataFrame([(f"e{k}", "a" if k % 3 else "b", r.tolist()) for k, r in enumerate(v)], "event_id string, split string, v array<double>")
    got = E.mmd_blocked(d.repartition(3), "v", "a", "b", block).first()
    assert (got.mmd2, got.bandwidth2) == (pytest.approx(plain_mmd(v, np.arange(45) % 3 > 0)[0], abs=1e-11), pytest.approx(plain_mmd(v, np.arange(45) % 3 > 0)[1], abs=1e-11))
    assert E.mmd_blocked(d.where("event_id = 'e1' or event_id = 'e0'").withColumn("v", F.array(F.lit(1.0))), "v", "a", "b").first().bandwidth2 == 1.0


def two_clouds(spark, n=90, dim=4, apart=0.4):
    rng = np.random.default_rng(11)
    v = rng.normal(size=(n, dim)) + apart * (np.arange(n) % 3 > 0)[:, None]
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    return v, spark.createDataFrame([(f"e{k}", "a" if k % 3 else "b", r.tolist()) for k, r in enumerate(v)], "event_id string, split string, v array<double>")


def test_mmd_by_features_is_within_its_error(spark):
    v, d = two_clouds(spark)
    exact = E.mmd_blocked(d, "v", "a", "b").first()
    for seed in range(3):
        r = E.mmd_estimate(d.repartition(3), "v", "a", "b", exact.bandwidth2, 2048, seed).first()
        assert 0 < r.error < 0.1 * exact.mmd2 and abs(r.mmd2 - exact.mmd2) < 4 * r.error
    assert E.mmd_estimate(d.where("split = 'a'"), "v", "a", "b", 1.0).first().mmd2 is None


def test_the_nth_least_hash_of_each_permutation_is_found(spark, monkeypatch):
    v, d = two_clouds(spark)
    ids = [f"e{k}" for k in range(90)]
    order = lambda seed, k: sorted(int.from_bytes(hashlib.sha256(f"{seed}:{k}:{e}".encode()).digest()[:8], "big") >> 1 for e in ids)
    for spread in (8.0, 0.05):  # the second starts with intervals that miss
        monkeypatch.setattr(E, "MMD_SPREAD", spread)
        for m in (1, 60, 89):
            got = E._selected(d.repartition(4), m, 90, 30, 7)
            assert got[1:].tolist() == [order(7, k)[m - 1] for k in range(1, 31)]


def test_permutations_of_shards_equal_all_pairs(spark):
    v, d = two_clouds(spark, apart=0.1)
    p = np.arange(90) % 3 > 0
    _, width = plain_mmd(v, p)
    kernel = np.exp(-((v[:, None] - v[None]) ** 2).sum(2) / (2 * width))
    value = lambda z: kernel[np.ix_(z, z)].mean() + kernel[np.ix_(~z, ~z)].mean() - 2 * kernel[np.ix_(z, ~z)].mean()
    hashes = lambda k: [hashlib.sha256(f"5151:{k}:e{i}".encode()).hexdigest() for i in range(90)]
    sides = [p, *(np.argsort(np.argsort(hashes(k))) < p.sum() for k in range(1, 41))]
    given = value(p)
    want = np.mean([max(0, value(z)) >= given - 1e-12 for z in sides])
    for block in (11, 512):
        r = E.mmd_permutation_test(d.repartition(3), "v", "a", "b", 40, block=block).first()
        assert (r.mmd2, r.p) == (pytest.approx(given, abs=1e-9), pytest.approx(want))
    assert E.mmd_permutation_test(d.where("split = 'a'"), "v", "a", "b", 5).isEmpty()


def test_split_plan(spark):
    f = {r.family_id: r.pool for r in splits.family_pools(spark.range(20).select(F.col("id").alias("family_id")), 1).collect()}
    assert sorted(f.values()).count("ood") == 6 and len(f) == 20
    p = splits.template_pools(spark.range(100).select(F.col("id").alias("template_id")), 1)
    n = {r.pool: r["count"] for r in p.groupBy("pool").count().collect()}
    assert n == {"train": 70, "validation": 10, "ood_test": 20}
    assert p.exceptAll(splits.template_pools(spark.range(100).repartition(7).select(F.col("id").alias("template_id")), 1)).isEmpty()
    for bad in ((0.0, 0.1), (0.6, 0.5)):
        with pytest.raises(ValueError):
            splits.check_fractions(*bad)


@needs_data
def test_the_audit_lists_every_violation(spark):
    vector = F.array(F.lit(1.0))
    events = spark.range(250).select(F.concat(F.lit("e"), F.col("id")).alias("event_id"), F.lit("train").alias("split"), F.col("id").alias("template_id"), F.lit("i").alias("target_item_id"), F.lit(1).alias("target_family_id"), *(vector.alias(f"{m}_vector") for m in ("text", "image", "audio")))
    r = leakage.report(events.unionAll(events), spark.createDataFrame([("i", 1)], "item_id string, family_id int")).first()
    assert r.duplicate_event_ids == sorted(f"e{k}" for k in range(250)) and r.n_duplicate_event_ids == 250 and r.duplicate_item_ids == [] and not r.passed
    items = spark.createDataFrame([("i", 1)], "item_id string, family_id int")
    short = leakage.summary(events.unionAll(events), items).first()
    assert all(short[c] == r[c] for c in short.asDict()) and not set(short.asDict()) & set(leakage._checks(events, items))
    paged = leakage.pages(leakage.violations(events.unionAll(events), items), 100).where(F.col("check") == "duplicate_event_ids").orderBy("page").collect()
    assert [len(p.ids) for p in paged] == [100, 100, 50] and [x for p in paged for x in p.ids] == r.duplicate_event_ids
    assert leakage.pages(leakage.violations(events.limit(0), items.limit(0))).select("check").distinct().collect() == [("missing_splits",)]


def test_features_shared_by_splits(spark):
    rows = [(k, "train" if k % 2 else "validation", k, [float(k)], [1.0], [2.0]) for k in range(40)]
    rows += [(50, "ood_test", 3, [3.0], [1.0], [2.0]), (51, "train", 3, [3.0], [1.0], [2.0]), (52, "train", 5, [5.0], [1.0], [2.0]), (53, "validation", 7, [7.0], [1.0], [2.5]), (54, "validation", 90, None, [1.0], None), (55, "train", 90, None, [1.0], None)]
    e = spark.createDataFrame(rows, "id int, split string, template_id int, text_vector array<double>, image_vector array<double>, audio_vector array<double>")
    assert sorted(r.splits for r in leakage.shared_features(e).collect()) == [2, 2]  # 3 in train and ood_test, and the nulls of 90
    assert leakage.shared_features(e.limit(0)).count() == 0


@needs_data
def test_export_needs_a_clean_audit_and_tampering_shows(spark, tmp_path):
    items, events = tables.items(spark, DATA), tables.events(spark, DATA).drop("fused")
    assert leakage.report(events, items).first().passed
    folder = f"file://{tmp_path}/data"
    exports.export_dataset(items, events, folder, "parquet")
    schemas = [", ".join(f"{f.name} {f.dataType.simpleString()}" for f in x.schema) for x in (items, events)]
    assert exports.verify_export(spark, folder, *schemas) == []
    assert all(x.isEmpty() for x in exports.tampering(spark, folder, "items", schemas[0]))
    with pytest.raises(ValueError, match="already exists"):
        exports.export_dataset(items, events, folder, "parquet")
    data = tmp_path / "data" / exports.read_manifest(spark, folder)["data"] / "items"
    # a table that is changed by hand: one row removed, one changed, one added
    new = items.where("item_no > 0").withColumn("family_id", F.when(F.col("item_no") == 5, 99).otherwise(F.col("family_id"))).unionByName(items.where("item_no = 10").withColumn("item_id", F.lit("added")))
    new.write.parquet(f"file://{tmp_path}/new")
    first = sorted(x for x in data.iterdir() if x.suffix == ".parquet")
    gone = {x.name for x in first}
    for x in first:
        x.unlink()
    for x in (tmp_path / "new").iterdir():
        if x.suffix == ".parquet":
            x.rename(data / x.name)
    assert exports.verify_export(spark, folder, *schemas) == ["items"]
    ranges, files = exports.tampering(spark, folder, "items", schemas[0])
    prefix = lambda x: hashlib.sha256(x.encode()).hexdigest()[: exports.DIGITS]
    got = {r.prefix: (r.rows_kept, r.rows_found) for r in ranges.collect()}
    assert set(got) == {prefix(x) for x in ("item-000000", "item-000005", "added")} and got[prefix("item-000005")][0] == got[prefix("item-000005")][1]
    assert {r.file for r in files.where("rows_found is null").collect()} == gone
    moved = events.unionByName(events.limit(1).withColumn("split", F.lit("ood_test")))
    with pytest.raises(ValueError):
        exports.export_dataset(items, moved, f"file://{tmp_path}/other")
    assert not (tmp_path / "other").exists()


@needs_data
def test_an_export_that_breaks_off_leaves_the_old_one_whole(spark, tmp_path, monkeypatch):
    items, events = tables.items(spark, DATA), tables.events(spark, DATA).drop("fused")
    folder = f"file://{tmp_path}/data"
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in items.schema)
    with pytest.raises(FileNotFoundError):
        exports.read_export(spark, folder, "items", schema)
    exports.export_dataset(items, events, folder, "parquet")
    n, old, plain = items.count(), exports.read_manifest(spark, folder), exports.write

    def breaks(table, path, *more, **named):
        if path.endswith("/events"):
            raise OSError("the disk is full")
        plain(table, path, *more, **named)

    monkeypatch.setattr(exports, "write", breaks)
    fewer = items.join(events.select(F.col("target_item_id").alias("item_id")), "item_id", "left_semi")
    with pytest.raises(OSError):
        exports.export_dataset(fewer, events, folder, "parquet", overwrite=True)
    assert exports.read_manifest(spark, folder) == old and exports.read_export(spark, folder, "items", schema).count() == n
    monkeypatch.setattr(exports, "write", plain)
    exports.export_dataset(fewer, events, folder, "parquet", overwrite=True)
    assert exports.read_manifest(spark, folder)["data"] != old["data"] and not (tmp_path / "data" / old["data"]).exists()
    assert exports.read_export(spark, folder, "items", schema).count() == fewer.count() == exports.read_manifest(spark, folder)["item_count"]
