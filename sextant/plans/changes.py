"""Queries: corrections, audits, point-in-time memory, corrective evaluation, policy."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sextant.operators import evaluation as E
from sextant.operators import memory as M
from sextant.operators import metrics, policy, retrieval
from sextant.plans.ranking import K
from sextant.plans.register import query
from sextant.sources import tables as T
from sextant.sources.scratch import keep, new_folder
from sextant.streaming import jobs
from sextant.streaming.corrections import CorrectionLog

_CHECKED = """checked AS (SELECT c.*, list_filter([CASE WHEN trim(c.reason) = '' THEN 'blank reason' END, CASE WHEN m.memory_id IS NULL THEN 'unknown memory' END, CASE WHEN c.corrected_at < m.updated_at THEN 'before last update' END,
    CASE WHEN c.new_item_id IS NOT NULL AND i.item_id IS NULL THEN 'unknown item' END, CASE WHEN NOT (c.new_strength > 0 AND c.new_strength <= 1) THEN 'strength outside (0, 1]' END, CASE WHEN len(c.new_vector) <> 16 THEN 'bad vector' END], lambda x: x IS NOT NULL) AS errors
    FROM corr c LEFT JOIN mem m USING (memory_id) LEFT JOIN items i ON i.item_id = c.new_item_id)"""
_SINGLE = f"{_CHECKED}, one AS (SELECT * FROM checked WHERE len(errors) = 0 QUALIFY row_number() OVER (PARTITION BY memory_id ORDER BY seq) = 1)"


def _checked(spark: SparkSession, d: str) -> DataFrame:
    return M.correction_errors(T.corrections(spark, d), T.memory(spark, d), T.items(spark, d), T.DIM)


def _first(spark: SparkSession, d: str) -> DataFrame:
    """The first correction of each memory without row errors."""
    return retrieval.first_by(_checked(spark, d).where(F.size("errors") == 0), ["memory_id"], "seq")


@query(f"WITH {_CHECKED} SELECT seq, correction_id, memory_id, errors FROM checked")
def correction_errors(spark: SparkSession, d: str) -> DataFrame:
    return _checked(spark, d).select("seq", "correction_id", "memory_id", "errors")


@query("SELECT count(*) FILTER (WHERE m.memory_id IS NULL) AS unknown, count(*) FILTER (WHERE m.memory_id IS NOT NULL) AS matched FROM corr LEFT JOIN mem m USING (memory_id)")
def correction_targets(spark: SparkSession, d: str) -> DataFrame:
    c, m = T.corrections(spark, d), T.memory(spark, d).select("memory_id")
    return c.join(m, "memory_id", "left_anti").agg(F.count("*").alias("unknown")).join(c.join(m, "memory_id").agg(F.count("*").alias("matched")))


@query(f"WITH {_SINGLE} SELECT m.memory_id, coalesce(c.new_item_id, m.item_id) AS item_id, m.created_at, coalesce(c.corrected_at, m.updated_at) AS updated_at, coalesce(c.new_strength, m.strength) AS strength, CAST(m.correction_count + (c.seq IS NOT NULL)::INT AS INTEGER) AS correction_count, list_transform(coalesce(c.new_vector, m.context_vector), lambda x: round(x, 9) + 0.0) AS context_vector FROM mem m LEFT JOIN one c USING (memory_id)")
def corrected_memory(spark: SparkSession, d: str) -> DataFrame:
    out = M.apply_single(T.memory(spark, d), _first(spark, d))
    return out.select("memory_id", "item_id", F.col("created_at").cast("timestamp_ntz").alias("created_at"), F.col("updated_at").cast("timestamp_ntz").alias("updated_at"), "strength", "correction_count", F.transform("context_vector", lambda x: F.round(x, 9) + F.lit(0.0)).alias("context_vector"))


_HISTORY = f"""WITH {_CHECKED} SELECT correction_id, memory_id, seq, coalesce(last_value(new_item_id IGNORE NULLS) OVER (PARTITION BY memory_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), m.item_id) AS previous_item_id,
    coalesce(last_value(new_item_id IGNORE NULLS) OVER (PARTITION BY memory_id ORDER BY seq ROWS UNBOUNDED PRECEDING), m.item_id) AS corrected_item_id, c.corrected_at, CAST(row_number() OVER (PARTITION BY memory_id ORDER BY seq) AS INTEGER) AS resulting_count
    FROM checked c JOIN mem m USING (memory_id) WHERE len(errors) = 0"""


@query(_HISTORY)
def correction_history(spark: SparkSession, d: str) -> DataFrame:
    """The audit of all corrections without row errors, in order of arrival."""
    accepted = _checked(spark, d).where(F.size("errors") == 0)
    h = M.history(T.memory(spark, d), accepted, "0" * 64)
    return h.select("correction_id", "memory_id", "seq", "previous_item_id", "corrected_item_id", F.col("corrected_at").cast("timestamp_ntz").alias("corrected_at"), "resulting_count")


_JUDGED = f"""WITH RECURSIVE {_CHECKED}, rws AS (SELECT c.seq, c.correction_id, c.memory_id, c.corrected_at, m.updated_at, c.errors, row_number() OVER (ORDER BY seq) AS k FROM checked c LEFT JOIN mem m USING (memory_id)),
    fold(k, error, used, latest) AS (SELECT 0::BIGINT, NULL::VARCHAR, []::VARCHAR[], MAP {{}}::MAP(VARCHAR, TIMESTAMP) UNION ALL
      SELECT k, e, CASE WHEN e IS NULL THEN list_append(used, correction_id) ELSE used END, CASE WHEN e IS NULL THEN map_concat(latest, MAP {{memory_id: corrected_at}}) ELSE latest END
      FROM (SELECT r.k, f.used, f.latest, r.correction_id, r.memory_id, r.corrected_at, CASE WHEN len(r.errors) > 0 THEN array_to_string(r.errors, ', ') WHEN list_contains(f.used, r.correction_id) THEN 'duplicate correction_id' WHEN r.corrected_at < coalesce(f.latest[r.memory_id], r.updated_at) THEN 'before last update' END AS e FROM fold f JOIN rws r ON r.k = f.k + 1))
    SELECT seq, memory_id, correction_id, error FROM fold JOIN rws USING (k)"""


@query(_JUDGED)
def judged_corrections(spark: SparkSession, d: str) -> DataFrame:
    """Accepted and rejected corrections, as if applied one after another."""
    return M.judge_corrections(T.memory(spark, d), T.corrections(spark, d), T.items(spark, d), T.DIM)


#: The fold of the judged corrections over each record: what an accepted one changed.
_STREAMED = _JUDGED.replace("SELECT seq, memory_id, correction_id, error FROM fold JOIN rws USING (k)", """, j AS (SELECT seq, r.memory_id, r.correction_id, error FROM fold JOIN rws r USING (k)),
    acc AS (SELECT c.seq, c.memory_id, coalesce(last_value(c.new_item_id IGNORE NULLS) OVER (PARTITION BY c.memory_id ORDER BY c.seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), m.item_id) AS previous_item_id,
      coalesce(last_value(c.new_item_id IGNORE NULLS) OVER (PARTITION BY c.memory_id ORDER BY c.seq ROWS UNBOUNDED PRECEDING), m.item_id) AS corrected_item_id, CAST(row_number() OVER (PARTITION BY c.memory_id ORDER BY c.seq) AS INTEGER) AS resulting_count
      FROM corr c JOIN j USING (seq) JOIN mem m ON m.memory_id = c.memory_id WHERE error IS NULL)
    SELECT j.seq, j.memory_id, j.correction_id, j.error, previous_item_id, corrected_item_id, resulting_count FROM j LEFT JOIN acc USING (seq)""")


@query(_STREAMED)
def correction_stream(spark: SparkSession, d: str) -> DataFrame:
    """The audit of all corrections as a stream that arrives in four files, each a micro-batch."""
    rows, source = keep(T.corrections(spark, d), "arriving"), new_folder(spark, "arrivals")
    low, high = rows.agg(F.min("seq"), F.max("seq")).first()
    for k in range(4 if low is not None else 0):
        at = F.floor((F.col("seq") - low) * 4 / (high - low + 1))
        rows.where(at == k).coalesce(1).write.mode("append").parquet(source)
    log = CorrectionLog(keep(T.memory(spark, d), "start_memory"), keep(T.items(spark, d), "library_items"), T.DIM, new_folder(spark, "correction-log"), snapshot_every=2)
    if low is not None:
        log.start(spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(source)).awaitTermination()
    return log.audit().select("seq", "memory_id", "correction_id", "error", "previous_item_id", "corrected_item_id", "resulting_count")


@query(f"WITH {_SINGLE} SELECT memory_id, unnest(list_filter([CASE WHEN memory_id LIKE '%1' THEN 'created_at changed' END, CASE WHEN memory_id LIKE '%6' THEN 'count reduced' END], lambda x: x IS NOT NULL)) AS problem FROM mem")
def replacement_violations(spark: SparkSession, d: str) -> DataFrame:
    before = T.memory(spark, d)
    after = M.apply_single(before, _first(spark, d)).withColumn("created_at", F.when(F.col("memory_id").like("%1"), F.col("created_at") - F.expr("interval 1 day")).otherwise(F.col("created_at")))
    after = after.withColumn("correction_count", F.when(F.col("memory_id").like("%6"), -1).otherwise(F.col("correction_count")))
    return M.replacement_violations(before, after)


@query(f"""WITH {_CHECKED}, versions AS (SELECT memory_id, updated_at, item_id FROM mem UNION ALL SELECT memory_id, corrected_at, new_item_id FROM checked WHERE len(errors) = 0 AND new_item_id IS NOT NULL),
    qs AS (SELECT memory_id, day, TIMESTAMP '2024-01-20' + to_days(day) AS as_of FROM mem, (VALUES (0), (15), (25), (40)) AS x(day))
    SELECT q.memory_id, q.as_of, v.updated_at, v.item_id FROM qs q ASOF LEFT JOIN versions v ON q.memory_id = v.memory_id AND q.as_of >= v.updated_at""")
def memory_as_of(spark: SparkSession, d: str) -> DataFrame:
    """The version of each record at four times."""
    accepted = _checked(spark, d).where((F.size("errors") == 0) & F.col("new_item_id").isNotNull())
    versions = T.memory(spark, d).select("memory_id", "updated_at", "item_id").unionByName(accepted.select("memory_id", F.col("corrected_at").alias("updated_at"), F.col("new_item_id").alias("item_id")))
    start = F.lit("2024-01-20 00:00:00").cast("timestamp")
    q = T.memory(spark, d).select("memory_id", F.explode(F.array(*map(F.lit, (0, 15, 25, 40)))).alias("day")).select("memory_id", (start + F.make_dt_interval("day")).alias("as_of"))
    out = M.as_of(versions, q)
    return out.select("memory_id", F.col("as_of").cast("timestamp_ntz").alias("as_of"), F.col("updated_at").cast("timestamp_ntz").alias("updated_at"), "item_id")


@query("WITH t AS (SELECT DISTINCT item_id FROM mem) SELECT item_id, coalesce(lead(item_id) OVER (ORDER BY item_id), min(item_id) OVER ()) AS decoy_item_id FROM t")
def decoys(spark: SparkSession, d: str) -> DataFrame:
    return M.decoys(T.memory(spark, d))


#: Each target's records get its decoy's label at training time (corrupted) and their own again a day later (restored).
_ARMS = """WITH dec AS (SELECT item_id, coalesce(lead(item_id) OVER (ORDER BY item_id), min(item_id) OVER ()) AS decoy FROM (SELECT DISTINCT item_id FROM mem)),
    bad AS (SELECT m.memory_id, m.context_vector, m.item_id AS label, dec.decoy AS item_id FROM mem m JOIN dec USING (item_id)),
    rest AS (SELECT memory_id, context_vector, label AS item_id FROM bad),
    q AS (SELECT event_id AS query_id, fused AS vector, target_item_id AS target FROM ev WHERE split = 'validation' AND target_item_id IN (SELECT item_id FROM dec)),
    sim AS (SELECT 'clean' AS arm, q.query_id, q.target, m.item_id, greatest(0, least(1, list_inner_product(q.vector, m.context_vector))) AS s FROM q, mem m UNION ALL
      SELECT 'restored', q.query_id, q.target, m.item_id, greatest(0, least(1, list_inner_product(q.vector, m.context_vector))) FROM q, rest m UNION ALL
      SELECT 'corrupted', q.query_id, q.target, CASE WHEN m.label = q.target THEN m.item_id ELSE m.label END, greatest(0, least(1, list_inner_product(q.vector, m.context_vector))) FROM q, bad m),
    best AS (SELECT arm, query_id, item_id, max(s) AS s FROM sim GROUP BY ALL),
    full_list AS (SELECT a.arm, q.query_id, q.target, i.item_id, round(coalesce(b.s, 0), 9) AS score FROM q CROSS JOIN items i CROSS JOIN (VALUES ('clean'), ('restored'), ('corrupted')) AS a(arm) LEFT JOIN best b ON b.arm = a.arm AND b.query_id = q.query_id AND b.item_id = i.item_id),
    ranks AS (SELECT *, row_number() OVER (PARTITION BY arm, query_id ORDER BY score DESC, item_id) AS rank FROM full_list QUALIFY rank <= 10),
    r AS (SELECT arm, query_id, target, min(CASE WHEN item_id = target THEN rank END) AS r FROM ranks GROUP BY ALL),
    one AS (SELECT arm, query_id, target, coalesce(1.0::DOUBLE / r, 0) AS rr, CASE WHEN r = 1 THEN 1.0::DOUBLE ELSE 0 END AS r1, CASE WHEN r IS NOT NULL THEN 1.0::DOUBLE ELSE 0 END AS r10, coalesce(1.0::DOUBLE / log2(r + 1), 0) AS gain FROM r),
    old AS (SELECT a.target, count(*) FILTER (WHERE o.arm = 'clean') AS other_queries, avg(o.rr) FILTER (WHERE o.arm = 'clean') AS before, avg(o.rr) FILTER (WHERE o.arm = 'restored') AS after FROM (SELECT DISTINCT target FROM one) a JOIN one o ON o.target <> a.target GROUP BY 1),
    audits AS (SELECT label AS target, count(*) AS restorations FROM bad GROUP BY 1),
    per AS (SELECT target, count(*) FILTER (WHERE arm = 'restored') AS queries, avg(rr) FILTER (WHERE arm = 'corrupted') AS mrr_before, avg(rr) FILTER (WHERE arm = 'restored') AS mrr_after, avg(rr) FILTER (WHERE arm = 'restored') - avg(rr) FILTER (WHERE arm = 'corrupted') AS improvement,
      avg(r1) FILTER (WHERE arm = 'corrupted') AS recall_1_before, avg(r1) FILTER (WHERE arm = 'restored') AS recall_1_after, avg(r10) FILTER (WHERE arm = 'corrupted') AS recall_k_before, avg(r10) FILTER (WHERE arm = 'restored') AS recall_k_after, avg(gain) FILTER (WHERE arm = 'corrupted') AS ndcg_k_before, avg(gain) FILTER (WHERE arm = 'restored') AS ndcg_k_after FROM one GROUP BY target)"""


def _worlds(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(corrupted memory, restored memory, audit of the restorations). A record belongs to one target, so all targets' corrections fit in one batch."""
    memory = keep(T.memory(spark, d), "clean_memory")
    corrupted = M.apply_single(memory, M.corruptions(memory, M.decoys(memory)))
    back = M.restorations(memory)
    return corrupted, keep(M.apply_single(corrupted, back), "restored_memory"), M.history(corrupted, back, "0" * 64)


def _eligible(spark: SparkSession, d: str) -> DataFrame:
    """(query_id, target, vector, projected, as_of) of validation events whose target is represented in training."""
    trained = T.split_of(spark, d, "train").select("target_item_id")
    e = T.split_of(spark, d, "validation").join(trained, "target_item_id", "left_semi")
    return e.select(F.col("event_id").alias("query_id"), F.col("target_item_id").alias("target"), F.col("fused").alias("vector"), F.col("fused").alias("projected"), F.lit(T.AS_OF).cast("timestamp").alias("as_of"))


_RECALL = [{"cell": "memory", "alpha": 0.0, "rate": None, "days": 0}]


def _recalled(spark: SparkSession, d: str, q: DataFrame, memory: DataFrame, k: int) -> DataFrame:
    return retrieval.hybrid_top_k(q, T.items(spark, d), memory, _RECALL, k, 9).select("query_id", "rank", "item_id", "score")


def _corrupted(q: DataFrame, found: DataFrame, memory: DataFrame) -> DataFrame:
    """The rankings of each query while its own target's records carry the decoy's label.

    Only the target's score (now 0) and the decoy's (now the better of both) differ from ``found``,
    rankings of K + 2 items under the right labels, so no query is ranked anew.
    """
    of = q.join(M.decoys(memory).select(F.col("item_id").alias("target"), F.col("decoy_item_id").alias("decoy")), "target").select("query_id", "target", "decoy", "vector")
    labels = retrieval.best_of_label(of.select("query_id", "vector", F.explode(F.array("target", "decoy")).alias("item_id")), memory)
    best = labels.join(of.select("query_id", "decoy"), "query_id").groupBy("query_id", F.col("decoy").alias("item_id")).agg(F.round(F.max("score"), 9).alias("score"))
    others = found.join(of.select("query_id", "target", "decoy"), "query_id").where("item_id <> target and item_id <> decoy").select("query_id", "item_id", "score")
    own = of.select("query_id", F.col("target").alias("item_id"), F.lit(0.0).alias("score"))
    return retrieval.ranked(others.unionByName(own).unionByName(best), ["query_id"], K)


def _arms(spark: SparkSession, d: str, worlds: tuple[DataFrame, DataFrame, DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """(metrics of each query in both arms; rr of each query under the clean and the restored memory)."""
    q, memory = keep(_eligible(spark, d), "eligible"), T.memory(spark, d)
    _, restored, _ = worlds or _worlds(spark, d)
    found = keep(_recalled(spark, d, q, restored, K + 2), "recalled")
    arms = found.where(F.col("rank") <= K).withColumn("arm", F.lit("restored")).unionByName(_corrupted(q, found, restored).withColumn("arm", F.lit("corrupted")))
    wanted = q.select("query_id", F.col("target").alias("item_id"), "target")
    both = metrics.per_query(arms, wanted, K, ("arm", "target"), spark.createDataFrame([("corrupted",), ("restored",)], "arm string"))
    # the clean rankings are those of the restored memory where no record differs
    clean = found if M.changed_records(memory, restored).isEmpty() else _recalled(spark, d, q, memory, K)
    states = clean.where(F.col("rank") <= K).withColumn("state", F.lit("clean")).unionByName(found.where(F.col("rank") <= K).withColumn("state", F.lit("restored")))
    rr = metrics.per_query(states, wanted, K, ("state", "target"), spark.createDataFrame([("clean",), ("restored",)], "state string"))
    return both, rr.select("state", "target", "query_id", "rr")


_METRICS = {"mrr": "rr", "recall_1": "recall_1", "recall_k": "recall_k", "ndcg_k": "ndcg_k"}


def _per_target(both: DataFrame) -> DataFrame:
    at = lambda arm, c: F.avg(F.when(F.col("arm") == arm, F.col(c)))
    columns = [x for name, c in _METRICS.items() for x in (at("corrupted", c).alias(f"{name}_before"), at("restored", c).alias(f"{name}_after"))]
    out = both.groupBy("target").agg(F.count_if(F.col("arm") == "restored").alias("queries"), *columns)
    return out.withColumn("improvement", F.col("mrr_after") - F.col("mrr_before"))


def _others(rr: DataFrame) -> DataFrame:
    """(target, other_queries, before, after): mean rr of all other targets' queries, from sums by target."""
    of = lambda s: F.when(F.col("state") == s, F.col("rr"))
    own = rr.groupBy("target").agg(F.sum(of("clean")).alias("c"), F.sum(of("restored")).alias("r"), F.count(of("clean")).alias("n"))
    total = own.agg(F.sum("c").alias("tc"), F.sum("r").alias("tr"), F.sum("n").alias("tn"))
    rest = F.col("tn") - F.col("n")
    return own.join(F.broadcast(total)).select("target", rest.alias("other_queries"), F.try_divide(F.col("tc") - F.col("c"), rest).alias("before"), F.try_divide(F.col("tr") - F.col("r"), rest).alias("after"))


_ROUNDED = ", ".join(f"round({c}, 9) + 0.0 AS {c}" for name in _METRICS for c in (f"{name}_before", f"{name}_after"))


@query(f"{_ARMS} SELECT target, queries, {_ROUNDED}, round(improvement, 9) + 0.0 AS improvement FROM per")
def corrective_targets(spark: SparkSession, d: str) -> DataFrame:
    """Four metrics of each target's queries, with its records mislabelled and restored."""
    return T.rounded(_per_target(_arms(spark, d)[0]))


RESAMPLES = 200


@query(f"""{_ARMS}, num AS (SELECT improvement, row_number() OVER (ORDER BY target) - 1 AS i, count(*) OVER () AS n FROM per),
    bm AS (SELECT b, avg(improvement) AS m FROM (SELECT DISTINCT n FROM num), unnest(range(0, {RESAMPLES})) AS x(b), unnest(range(0, n)) AS y(k) JOIN num ON num.i = CAST('0x' || substr(sha256(concat_ws(':', '4242', b, k)), 1, 8) AS BIGINT) % num.n GROUP BY b),
    c AS (SELECT quantile_cont(m, 0.025) AS lo, quantile_cont(m, 0.975) AS hi FROM bm)
    SELECT count(*) AS targets, round(avg(improvement), 9) AS mean_improvement, round(stddev_samp(improvement), 9) AS sd_improvement, round(min(improvement), 9) + 0.0 AS min_improvement, round(max(improvement), 9) AS max_improvement, round(any_value(lo), 9) + 0.0 AS ci_lower, round(any_value(hi), 9) + 0.0 AS ci_upper,
      avg(improvement) >= 0.05 AND any_value(lo) > 0 AS correction_passed, round((SELECT avg(before - after) FROM old), 9) + 0.0 AS mean_degradation, round((SELECT max(before - after) FROM old), 9) + 0.0 AS max_degradation, (SELECT avg(before - after) FROM old) <= 0.02 AS degradation_passed, (SELECT sum(restorations)::BIGINT FROM audits) AS restorations FROM per, c""")
def corrective_summary(spark: SparkSession, d: str) -> DataFrame:
    """Improvement over targets with its interval, degradation of other queries, and both rules."""
    worlds = _worlds(spark, d)
    both, rr = _arms(spark, d, worlds)
    per, i = keep(_per_target(both).withColumn("all", F.lit("all")), "corrective_targets"), F.col("improvement")
    means = E.bootstrap_hashed(per, ["all"], "improvement", "target", RESAMPLES)
    interval = means.agg(F.percentile("mean", F.lit(0.025)).alias("lo"), F.percentile("mean", F.lit(0.975)).alias("hi"))
    gone = F.col("before") - F.col("after")
    old = _others(rr).agg(F.avg(gone).alias("mean_degradation"), F.max(gone).alias("max_degradation"))
    audits = worlds[2].agg(F.count("*").alias("restorations"))
    sums = per.agg(F.count("*").alias("targets"), F.avg(i).alias("mean_improvement"), F.stddev_samp(i).alias("sd_improvement"), F.min(i).alias("min_improvement"), F.max(i).alias("max_improvement"))
    out = sums.join(interval).join(old).join(audits)  # one row each
    rules = ((F.col("mean_improvement") >= 0.05) & (F.col("lo") > 0)).alias("correction_passed"), (F.col("mean_degradation") <= 0.02).alias("degradation_passed")
    return T.rounded(out.select("targets", "mean_improvement", "sd_improvement", "min_improvement", "max_improvement", F.col("lo").alias("ci_lower"), F.col("hi").alias("ci_upper"), rules[0], "mean_degradation", "max_degradation", rules[1], "restorations"))


@query(f"{_ARMS} SELECT target, other_queries, round(before, 9) + 0.0 AS mrr_before, round(after, 9) + 0.0 AS mrr_after, round(before - after, 9) + 0.0 AS degradation FROM old")
def corrective_others(spark: SparkSession, d: str) -> DataFrame:
    """MRR of all other eligible queries of each target, under the clean and the restored memory."""
    old = _others(_arms(spark, d)[1])
    return T.rounded(old.select("target", "other_queries", F.col("before").alias("mrr_before"), F.col("after").alias("mrr_after"), (F.col("before") - F.col("after")).alias("degradation")))


@query("WITH dec AS (SELECT item_id, coalesce(lead(item_id) OVER (ORDER BY item_id), min(item_id) OVER ()) AS decoy FROM (SELECT DISTINCT item_id FROM mem)) SELECT 'restore::' || memory_id AS correction_id, memory_id, decoy AS previous_item_id, item_id AS corrected_item_id, updated_at + INTERVAL 1 DAY AS corrected_at, CAST(2 AS INTEGER) AS resulting_count FROM mem JOIN dec USING (item_id)")
def restoration_audits(spark: SparkSession, d: str) -> DataFrame:
    """The audit of the corrections that give mislabelled records their labels back."""
    return _worlds(spark, d)[2].select("correction_id", "memory_id", "previous_item_id", "corrected_item_id", F.col("corrected_at").cast("timestamp_ntz").alias("corrected_at"), "resulting_count")


_MISSING = "list_filter([CASE WHEN concentration_ppm IS NULL THEN 'concentration_ppm' END, CASE WHEN duration_seconds IS NULL THEN 'duration_seconds' END, CASE WHEN environment_volume_m3 IS NULL THEN 'environment_volume_m3' END, CASE WHEN ventilation_ach IS NULL THEN 'ventilation_ach' END, CASE WHEN user_consent IS NULL THEN 'user_consent' END], lambda x: x IS NOT NULL)"
DECIDE = f"""WITH j AS (SELECT rq.*, lim.* EXCLUDE (item_id), {_MISSING} AS missing FROM rq LEFT JOIN lim USING (item_id)),
    r AS (SELECT *, CASE WHEN len(missing) > 0 THEN 'missing_information' WHEN NOT user_consent THEN 'consent' WHEN enabled IS NULL THEN 'unknown_item' WHEN NOT enabled THEN 'disabled_item' WHEN concentration_ppm > max_concentration THEN 'concentration' WHEN duration_seconds > max_duration THEN 'duration'
      WHEN environment_volume_m3 < min_volume THEN 'volume' WHEN ventilation_ach < min_ventilation THEN 'ventilation' ELSE 'allow' END AS rule FROM j),
    rules AS (SELECT * FROM (VALUES {', '.join(f"('{a}', '{b}', '{c}')" for a, b, c in policy.RULES)}) AS x(rule, rule_id, outcome)),
    dec AS (SELECT request_id, outcome, [rule_id] AS rule_ids, CASE WHEN rule = 'missing_information' THEN 'missing: ' || array_to_string(missing, ', ') ELSE 'rule: ' || rule END AS explanation FROM r JOIN rules USING (rule))"""


@query(f"{DECIDE} SELECT * FROM dec")
def policy_decisions(spark: SparkSession, d: str) -> DataFrame:
    return policy.decide(T.requests(spark, d), T.limits(spark)).drop("protocol_hash")


def expected_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """Decisions with some outcomes turned, as a case table with known faults."""
    k = F.expr("cast(substring(request_id, 4) as long)")
    turned = F.when(k % 37 == 0, "BLOCK").when(k % 41 == 0, "ALLOW").otherwise(F.col("outcome"))
    return policy.decide(T.requests(spark, d), T.limits(spark)).select("request_id", turned.alias("expected_outcome"))


EXPECTED = "SELECT request_id, outcome, CASE WHEN k % 37 = 0 THEN 'BLOCK' WHEN k % 41 = 0 THEN 'ALLOW' ELSE outcome END AS expected FROM (SELECT *, CAST(substr(request_id, 4) AS BIGINT) AS k FROM dec)"


@query(f"""{DECIDE}, c AS ({EXPECTED}),
    n AS (SELECT count(*) AS cases, count(*) FILTER (WHERE outcome = expected) AS exact, count(*) FILTER (WHERE outcome = 'ALLOW' AND expected <> 'ALLOW') AS false_allows, count(*) FILTER (WHERE outcome = 'BLOCK' AND expected = 'ALLOW') AS false_blocks, count(*) FILTER (WHERE expected = 'ALLOW') AS ea FROM c)
    SELECT cases, exact, false_allows, false_blocks, exact::DOUBLE / cases AS conformance_rate, false_allows::DOUBLE / cases AS false_allow_rate, coalesce(false_blocks::DOUBLE / nullif(ea, 0), 0) AS false_block_rate, 1.0::DOUBLE AS coverage, exact = cases AND false_allows = 0 AS passed FROM n""")
def policy_conformance(spark: SparkSession, d: str) -> DataFrame:
    return policy.conformance(policy_decisions(spark, d), expected_outcomes(spark, d))


@query(f"{DECIDE} SELECT request_id, outcome, rule_ids FROM dec")
def policy_stream(spark: SparkSession, d: str) -> DataFrame:
    """Decisions on the orders as a stream, run until all that is there is read."""
    out = new_folder(spark, "decisions")
    schema = T.table(spark, d, "orders").schema
    stream = spark.readStream.schema(schema).parquet(f"{d}/orders.parque[t]")  # a pattern: the table may be one file
    job = jobs.decide_stream(T.requests_from(stream), T.limits(spark)).writeStream.format("parquet").option("checkpointLocation", new_folder(spark, "decisions-log")).trigger(availableNow=True).start(out)
    job.awaitTermination()
    return spark.read.parquet(out).select("request_id", "outcome", "rule_ids")

