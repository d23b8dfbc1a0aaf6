"""Queries: graded views, paired contrasts, intervals, shift diagnostics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sextant.functions import vectors as V
from sextant.operators import evaluation as E
from sextant.operators import metrics, retrieval, ridge
from sextant.plans.ranking import SEED, K, _training, fitted_sql, fixed_ridge, metrics_sql, predicted_sql, projected_sql, random_sql, rank_sql, rounded_metrics, TRAINING
from sextant.plans.register import query
from sextant.sources import tables as T
from sextant.sources.scratch import keep

RESAMPLES = 20


@query("SELECT latent_event_id, observed_event_id, tier, strength, tier_seed, template_id, list_transform(text_vector, lambda x: round(x, 9) + 0.0) AS text_vector, list_transform(audio_vector, lambda x: round(x, 9) + 0.0) AS audio_vector FROM vw")
def graded_views(spark: SparkSession, d: str) -> DataFrame:
    v = T.views(spark, d)
    return v.select("latent_event_id", "observed_event_id", "tier", "strength", "tier_seed", "template_id", V.rounded(F.col("text_vector")).alias("text_vector"), V.rounded(F.col("audio_vector")).alias("audio_vector"))


@query("SELECT 'latent-' || event_id AS id, 'first' AS side FROM ev WHERE split = 'ood_test' AND vec_id % 4 = 3 UNION ALL SELECT 'latent-' || event_id, 'second' FROM ev WHERE split = 'ood_test' AND vec_id % 4 = 3")
def severe_differences(spark: SparkSession, d: str) -> DataFrame:
    """Severe views against their source vectors, some of which are turned."""
    views = T.views(spark, d).where("tier = 'severe'").select(F.col("latent_event_id").alias("id"), F.col("text_vector").alias("v"))
    source = T.split_of(spark, d, "ood_test").select(F.concat(F.lit("latent-"), "event_id").alias("id"), F.when(F.col("vec_id") % 4 == 3, F.transform("text_vector", lambda x: -x)).otherwise(F.reverse("text_vector")).alias("v"))
    return E.vector_differences(views, source, ["id", "v"]).select("id", "side")


GRADED = f"""WITH g AS (SELECT x.*, vq.tier, vq.latent_event_id FROM (SELECT 'mean_fusion' AS ranker, query_id, rank, item_id FROM {rank_sql('vq')} UNION ALL
    SELECT 'text_only', query_id, rank, item_id FROM {rank_sql('(SELECT observed_event_id AS query_id, text_vector AS vector FROM vw)')} UNION ALL
    SELECT 'ridge', query_id, rank, item_id FROM {rank_sql(projected_sql('vq', 'query_id', 'vector'))} UNION ALL
    SELECT 'random', * FROM {random_sql('vq', 'latent_event_id')}) x JOIN vq USING (query_id)),
    rr AS (SELECT ranker, tier, latent_event_id, coalesce(max(CASE WHEN g.item_id = t.item_id THEN 1.0::DOUBLE / rank END), 0) AS rr FROM g JOIN (SELECT query_id, item_id FROM vq) t USING (query_id) GROUP BY ALL),
    diff AS (SELECT a.ranker, a.tier || '_minus_' || b.tier AS contrast, a.latent_event_id, a.rr - b.rr AS difference FROM rr a JOIN rr b USING (ranker, latent_event_id) WHERE (a.tier, b.tier) IN (('mild', 'moderate'), ('moderate', 'severe'), ('mild', 'severe')))"""


RANKERS = ("mean_fusion", "text_only", "ridge", "random")


def _graded(spark: SparkSession, d: str) -> DataFrame:
    """(ranker, query_id, rank, item_id): four rankers on three tiers; the random one is keyed by the
    latent event, so that its ranking is the same in all tiers."""
    views, items = keep(T.view_queries(spark, d), "views"), retrieval.prepare(T.items(spark, d))
    text = T.views(spark, d).select(F.col("observed_event_id").alias("query_id"), F.col("text_vector").alias("vector"))
    rankers = {
        "mean_fusion": lambda q: retrieval.cosine_top_k(q, items, K, 9),
        "text_only": lambda q: retrieval.cosine_top_k(text, items, K, 9),
        "ridge": lambda q: retrieval.cosine_top_k(q.withColumn("vector", fixed_ridge().predict(F.col("vector"))), items, K, 9),
        "random": lambda q: retrieval.random_top_k(q, T.items(spark, d), K, SEED, "latent_event_id"),
    }
    return retrieval.all_rankers(views, rankers)


def _per_view(spark: SparkSession, d: str, groups: tuple[str, ...]) -> DataFrame:
    wanted = T.view_queries(spark, d).select("query_id", "item_id", "tier", "latent_event_id")
    return metrics.per_query(_graded(spark, d), wanted, K, groups, spark.createDataFrame([(r,) for r in RANKERS], "ranker string"))


def _graded_rr(spark: SparkSession, d: str) -> DataFrame:
    return _per_view(spark, d, ("ranker", "tier", "latent_event_id")).select("ranker", "tier", "latent_event_id", "rr")


@query(f"{GRADED} {metrics_sql('g', '(SELECT query_id, item_id FROM vq)', 'ranker, tier')}")
def graded_metrics(spark: SparkSession, d: str) -> DataFrame:
    return metrics.summary(_per_view(spark, d, ("ranker", "tier")), ("ranker", "tier"), 9)


@query(f"{GRADED} SELECT ranker, contrast, latent_event_id, round(difference, 9) + 0.0 AS difference FROM diff")
def paired_differences(spark: SparkSession, d: str) -> DataFrame:
    return E.paired(_graded_rr(spark, d)).withColumn("difference", F.round("difference", 9) + F.lit(0.0))


@query(f"{GRADED} SELECT ranker, contrast, count(*) AS n, round(avg(difference), 9) + 0.0 AS mean_diff, round(stddev_samp(difference), 9) AS sd_diff, count(*) FILTER (WHERE difference > 1e-15) AS better, count(*) FILTER (WHERE abs(difference) <= 1e-15) AS tied, count(*) FILTER (WHERE difference < -1e-15) AS worse FROM diff GROUP BY ALL")
def paired_contrasts(spark: SparkSession, d: str) -> DataFrame:
    return E.contrasts(E.paired(_graded_rr(spark, d)), 9).withColumn("mean_diff", F.col("mean_diff") + F.lit(0.0))


@query(f"{GRADED} SELECT ranker, latent_event_id FROM (SELECT * FROM rr WHERE NOT (tier = 'mild' AND latent_event_id LIKE '%4')) GROUP BY ALL HAVING count(*) <> 3")
def unpaired_events(spark: SparkSession, d: str) -> DataFrame:
    return E.unpaired(_graded_rr(spark, d).where("not (tier = 'mild' and latent_event_id like '%4')"))


@query(f"""{GRADED}, num AS (SELECT ranker, contrast, difference, row_number() OVER (PARTITION BY ranker, contrast ORDER BY latent_event_id) - 1 AS i, count(*) OVER (PARTITION BY ranker, contrast) AS n FROM diff),
    draws AS (SELECT ranker, contrast, b, CAST('0x' || substr(sha256(concat_ws(':', '4242', b, k)), 1, 8) AS BIGINT) % n AS i FROM (SELECT DISTINCT ranker, contrast, n FROM num), unnest(range(0, {RESAMPLES})) AS bb(b), unnest(range(0, n)) AS kk(k))
    SELECT ranker, contrast, CAST(b AS INTEGER) AS b, round(avg(difference), 9) + 0.0 AS mean FROM draws JOIN num USING (ranker, contrast, i) GROUP BY ALL""")
def bootstrap_means(spark: SparkSession, d: str) -> DataFrame:
    """Bootstrap means whose draws are hashes."""
    return E.bootstrap_hashed(E.paired(_graded_rr(spark, d)), ["ranker", "contrast"], resamples=RESAMPLES).withColumn("mean", F.round("mean", 9) + F.lit(0.0))


@query()
def bootstrap_intervals(spark: SparkSession, d: str) -> DataFrame:
    """Percentile intervals of 10,000 resamples."""
    return E.bootstrap(E.paired(_graded_rr(spark, d)), ["ranker", "contrast"])


POISSON_RESAMPLES = 80
_POISSON = f"""{GRADED}, e AS (SELECT ranker, contrast, difference, j, sha256(concat_ws(':', '4242', j, latent_event_id)) AS h FROM diff, unnest(range(0, {POISSON_RESAMPLES // 8})) AS r(j)),
    w AS (SELECT ranker, contrast, 8 * j + i AS b, difference AS d, len(list_filter([{', '.join(map(str, E.POISSON))}], lambda t: t <= CAST('0x' || substr(h, 8 * CAST(i AS INTEGER) + 1, 8) AS BIGINT))) AS w FROM e, unnest(range(0, 8)) AS r(i)),
    m AS (SELECT ranker, contrast, b, count(*) AS n, sum(w * d) / nullif(sum(w), 0) AS mean FROM w GROUP BY ALL)"""


@query(f"{_POISSON} SELECT ranker, contrast, max(n) AS n, round(quantile_cont(mean, 0.025), 9) + 0.0 AS ci_lower, round(quantile_cont(mean, 0.975), 9) + 0.0 AS ci_upper FROM m GROUP BY ALL")
def bootstrap_poisson_intervals(spark: SparkSession, d: str) -> DataFrame:
    out = E.bootstrap_poisson(E.paired(_graded_rr(spark, d)), ["ranker", "contrast"], resamples=POISSON_RESAMPLES)
    return out.select("ranker", "contrast", "n", (F.round("ci_lower", 9) + F.lit(0.0)).alias("ci_lower"), (F.round("ci_upper", 9) + F.lit(0.0)).alias("ci_upper"))


@query(f"""{GRADED}, e AS (SELECT ranker, contrast, b, CASE WHEN b = 0 OR substr(sha256(concat_ws(':', '4242', b, latent_event_id)), 1, 1) < '8' THEN difference ELSE -difference END AS d FROM diff, unnest(range(0, 101)) AS bb(b)),
    m AS (SELECT ranker, contrast, b, count(*) AS n, avg(d) AS m FROM e GROUP BY ALL), o AS (SELECT ranker, contrast, m AS mean_diff FROM m WHERE b = 0),
    t AS (SELECT ranker, contrast, any_value(n) AS n, any_value(mean_diff) AS mean_diff, avg(CASE WHEN abs(m) >= abs(mean_diff) - 1e-12 THEN 1.0::DOUBLE ELSE 0 END) AS p FROM m JOIN o USING (ranker, contrast) GROUP BY ALL),
    h AS (SELECT *, (count(*) OVER (PARTITION BY ranker) - row_number() OVER w + 1) * p AS s FROM t WINDOW w AS (PARTITION BY ranker ORDER BY p, contrast))
    SELECT ranker, contrast, n, round(mean_diff, 9) + 0.0 AS mean_diff, round(p, 9) AS p, round(least(1, max(s) OVER (PARTITION BY ranker ORDER BY p, contrast ROWS UNBOUNDED PRECEDING)), 9) AS p_holm FROM h""")
def permutation_tests(spark: SparkSession, d: str) -> DataFrame:
    """Paired sign-flip tests of the contrasts, corrected within each ranker."""
    tests = E.sign_flip_test(E.paired(_graded_rr(spark, d)), ["ranker", "contrast"], permutations=100)
    out = E.holm(tests, ["ranker"], ["contrast"])
    return out.select("ranker", "contrast", "n", (F.round("mean_diff", 9) + F.lit(0.0)).alias("mean_diff"), F.round("p", 9).alias("p"), F.round("p_holm", 9).alias("p_holm"))


_SHIFT = """WITH x AS (SELECT split, i, fused[i] AS v, event_id FROM ev, unnest(range(1, 17)) AS r(i) WHERE split IN ('validation', 'ood_test')),
    mu AS (SELECT i, avg(v) FILTER (WHERE split = 'validation') AS a, avg(v) FILTER (WHERE split = 'ood_test') AS b FROM x GROUP BY i),
    cv AS (SELECT p.i, q.i AS j, covar_samp(p.v, q.v) FILTER (WHERE p.split = 'validation') - covar_samp(p.v, q.v) FILTER (WHERE p.split = 'ood_test') AS d FROM x p JOIN x q USING (event_id) GROUP BY 1, 2)"""


@query(f"{_SHIFT} SELECT (SELECT count(*) FROM ev WHERE split = 'validation') AS validation_count, (SELECT count(*) FROM ev WHERE split = 'ood_test') AS ood_count, 16 AS dim, round(sqrt(sum((a - b) * (a - b))), 9) AS mean_shift_l2, round((SELECT sqrt(sum(d * d)) FROM cv), 9) AS cov_shift_fro, round(sum(a * b) / sqrt(sum(a * a) * sum(b * b)), 9) AS centroid_cosine FROM mu")
def distribution_shift(spark: SparkSession, d: str) -> DataFrame:
    return E.shift(T.events(spark, d), "fused", T.DIM)


_MMD = """WITH h AS (SELECT event_id, split = 'validation' AS p, fused AS v FROM ev WHERE split IN ('validation', 'ood_test')),
    d AS (SELECT a.event_id AS i, b.event_id AS j, a.p AS pa, b.p AS pb, list_sum(list_transform(list_zip(a.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM h a, h b),
    m AS (SELECT quantile_cont(d, 0.5) AS bw FROM d WHERE i < j AND d > 0)"""


@query(f"{_MMD} SELECT round(greatest(0, avg(exp(-d / (2 * bw))) FILTER (WHERE pa AND pb) + avg(exp(-d / (2 * bw))) FILTER (WHERE NOT pa AND NOT pb) - 2 * avg(exp(-d / (2 * bw))) FILTER (WHERE pa AND NOT pb)), 9) AS mmd2, round(any_value(bw), 9) AS bandwidth2 FROM d, m")
def mmd(spark: SparkSession, d: str) -> DataFrame:
    return E.mmd_blocked(T.events(spark, d), "fused", "validation", "ood_test", digits=9)


@query(f"{_MMD} SELECT round(greatest(0, avg(exp(-d / (2 * bw))) FILTER (WHERE pa AND pb) + avg(exp(-d / (2 * bw))) FILTER (WHERE NOT pa AND NOT pb) - 2 * avg(exp(-d / (2 * bw))) FILTER (WHERE pa AND NOT pb)), 3) AS mmd2, round(any_value(bw), 2) AS bandwidth2 FROM d, m")
def mmd_by_blocks(spark: SparkSession, d: str) -> DataFrame:
    """The same with blocks of a few rows and a bandwidth from one pass."""
    return E.mmd_blocked(T.events(spark, d), "fused", "validation", "ood_test", 32, 1).select(F.round("mmd2", 3).alias("mmd2"), F.round("bandwidth2", 2).alias("bandwidth2"))


@query("SELECT event_id, split, CASE WHEN (row_number() OVER (PARTITION BY split ORDER BY event_id) - 1) % 2 = 0 THEN 'even' ELSE 'odd' END AS half FROM ev WHERE split = 'ood_test'")
def even_and_odd(spark: SparkSession, d: str) -> DataFrame:
    return E.halves(T.split_of(spark, d, "ood_test")).select("event_id", "split", "half")


@query("SELECT CAST(seed AS INTEGER) AS seed, event_id, CASE WHEN row_number() OVER (PARTITION BY seed ORDER BY sha256(concat_ws(':', seed, event_id)), event_id) <= round_even(count(*) OVER (PARTITION BY seed) * 0.5::DOUBLE, 0) THEN 'calibration' ELSE 'evaluation' END AS part FROM ev, (VALUES (1), (2), (3)) AS s(seed) WHERE split = 'ood_test'")
def random_half_splits(spark: SparkSession, d: str) -> DataFrame:
    return E.random_halves(T.split_of(spark, d, "ood_test"), [1, 2, 3]).select("seed", "event_id", "part")


PERMUTATIONS = 20


@query(f"""{_MMD}, z AS (SELECT k, event_id, row_number() OVER (PARTITION BY k ORDER BY sha256(concat_ws(':', '5151', k, event_id)), event_id) <= (SELECT count(*) FROM h WHERE p) AS z FROM h, unnest(range(1, {PERMUTATIONS + 1})) AS r(k) UNION ALL SELECT 0, event_id, p FROM h),
    v AS (SELECT a.k, avg(exp(-d / (2 * bw))) FILTER (WHERE a.z AND b.z) + avg(exp(-d / (2 * bw))) FILTER (WHERE NOT a.z AND NOT b.z) - 2 * avg(exp(-d / (2 * bw))) FILTER (WHERE a.z AND NOT b.z) AS mmd2 FROM d JOIN z a ON a.event_id = d.i JOIN z b ON b.event_id = d.j AND b.k = a.k, m GROUP BY a.k)
    SELECT round((SELECT greatest(0, mmd2) FROM v WHERE k = 0), 3) AS mmd2, avg(CASE WHEN mmd2 >= (SELECT mmd2 FROM v WHERE k = 0) - 1e-12 THEN 1.0::DOUBLE ELSE 0 END) AS p FROM v""")
def mmd_permutation_test(spark: SparkSession, d: str) -> DataFrame:
    """Whether the shifted events differ from the validation events more than random divisions do."""
    return E.mmd_permutation_test(T.events(spark, d), "fused", "validation", "ood_test", PERMUTATIONS).select(F.round("mmd2", 3).alias("mmd2"), "p")


#: The number of permutations that the protocol declares.
DECLARED_PERMUTATIONS = 10_000


@query()
def mmd_declared_test(spark: SparkSession, d: str) -> DataFrame:
    """The permutation test at its declared number; no SQL, as it would pair all events in each permutation."""
    return E.mmd_permutation_test(T.events(spark, d), "fused", "validation", "ood_test", DECLARED_PERMUTATIONS)


@query()
def mmd_by_features(spark: SparkSession, d: str) -> DataFrame:
    """The discrepancy and its standard error by random features, at the bandwidth of the exact form."""
    e = T.events(spark, d)
    width = E.mmd_blocked(e, "fused", "validation", "ood_test").first().bandwidth2
    return E.mmd_estimate(e, "fused", "validation", "ood_test", width)


def _oracle_mrr(spark: SparkSession, d: str, train: DataFrame, test: DataFrame, seed: str) -> DataFrame:
    """(seed, query_id, rr): a ridge for each seed, fitted on train and judged on test, all in one pass."""
    models = ridge.fit_each(train, "fused", "item_vector", T.DIM, seed)
    predicted = F.coalesce(*(F.when(F.col(seed) == s, m.predict(F.col("fused"))) for s, m in sorted(models.items())))
    q = test.select(F.concat_ws("|", F.col(seed).cast("string"), "event_id").alias("query_id"), F.col(seed).alias("seed"), predicted.alias("vector"), F.col("target_item_id").alias("item_id"))
    rankings = retrieval.cosine_top_k(q, T.items(spark, d), K, 9)
    return metrics.per_query(rankings, q, K, ("seed",)).select("seed", "query_id", "rr")


def _with_items(spark: SparkSession, d: str) -> DataFrame:
    items = T.items(spark, d).select(F.col("item_id").alias("target_item_id"), "item_vector")
    return T.split_of(spark, d, "ood_test").join(items, "target_item_id")


def _oracle_sql(halves: str) -> str:
    """rr (seed, query_id, rr) of a ridge for each seed; ``halves``: (seed, event_id, train)."""
    asked = "(SELECT seed || '|' || h.event_id AS query_id, seed, fused FROM hv h JOIN ev USING (event_id) WHERE NOT train)"
    return f"""WITH RECURSIVE hv AS ({halves}), tr AS (SELECT seed, ev.fused AS x, items.item_vector AS y FROM hv JOIN ev USING (event_id) JOIN items ON items.item_id = ev.target_item_id WHERE train), {fitted_sql('tr')},
    pq AS (SELECT * FROM {predicted_sql(asked, 'w_fit', 'query_id')}), rk AS (SELECT * FROM {rank_sql('pq')}),
    rr AS (SELECT h.seed, h.event_id, coalesce(max(CASE WHEN rk.item_id = ev.target_item_id THEN 1.0::DOUBLE / rank END), 0) AS rr FROM hv h JOIN ev USING (event_id) LEFT JOIN rk ON rk.query_id = h.seed || '|' || h.event_id WHERE NOT train GROUP BY ALL)"""


_EVEN = "SELECT 0 AS seed, event_id, (row_number() OVER (ORDER BY event_id) - 1) % 2 = 0 AS train FROM ev WHERE split = 'ood_test'"


@query(f"{_oracle_sql(_EVEN)} SELECT count(*) AS evaluation_count, round(avg(rr), 6) AS oracle_mrr FROM rr")
def shift_oracle(spark: SparkSession, d: str) -> DataFrame:
    """A ridge fitted on one half of the shifted events and judged on the other."""
    e = E.halves(_with_items(spark, d)).withColumn("seed", F.lit(0))
    rr = _oracle_mrr(spark, d, e.where("half = 'even'"), e.where("half = 'odd'"), "seed")
    return rr.agg(F.count("*").alias("evaluation_count"), F.round(F.avg("rr"), 6).alias("oracle_mrr"))


_RANDOM_HALVES = "SELECT CAST(seed AS INTEGER) AS seed, event_id, row_number() OVER (PARTITION BY seed ORDER BY sha256(concat_ws(':', seed, event_id)), event_id) <= round_even(count(*) OVER (PARTITION BY seed) * 0.5::DOUBLE, 0) AS train FROM ev, unnest(range(1, 6)) AS s(seed) WHERE split = 'ood_test'"


@query(f"""{_oracle_sql(_RANDOM_HALVES)}, runs AS (SELECT seed, avg(rr) AS mrr FROM rr GROUP BY 1), num AS (SELECT mrr, row_number() OVER (ORDER BY seed) - 1 AS i FROM runs),
    bm AS (SELECT b, avg(mrr) AS m FROM unnest(range(0, {RESAMPLES * 10})) AS x(b), unnest(range(0, 5)) AS y(k) JOIN num ON num.i = CAST('0x' || substr(sha256(concat_ws(':', '4242', b, k)), 1, 8) AS BIGINT) % 5 GROUP BY b)
    SELECT count(*) AS runs, round(avg(mrr), 6) AS mean, round(stddev_samp(mrr), 6) AS sd, round(min(mrr), 6) AS low, round(max(mrr), 6) AS high, (SELECT round(quantile_cont(m, 0.025), 6) FROM bm) AS ci_lower, (SELECT round(quantile_cont(m, 0.975), 6) FROM bm) AS ci_upper FROM runs""")
def repeated_oracle(spark: SparkSession, d: str) -> DataFrame:
    """The oracle over several random halves: mean, spread and interval of its MRR."""
    e = _with_items(spark, d)
    parts = E.random_halves(e, [1, 2, 3, 4, 5]).join(e, "event_id")
    runs = _oracle_mrr(spark, d, parts.where("part = 'calibration'"), parts.where("part = 'evaluation'"), "seed").groupBy("seed").agg(F.avg("rr").alias("mrr")).withColumn("all", F.lit("all"))
    means = E.bootstrap_hashed(runs, ["all"], "mrr", "seed", RESAMPLES * 10)
    interval = means.groupBy("all").agg(F.round(F.percentile("mean", F.lit(0.025)), 6).alias("ci_lower"), F.round(F.percentile("mean", F.lit(0.975)), 6).alias("ci_upper"))
    r = lambda c: F.round(c, 6)
    return runs.groupBy("all").agg(F.count("*").alias("runs"), r(F.avg("mrr")).alias("mean"), r(F.stddev_samp("mrr")).alias("sd"), r(F.min("mrr")).alias("low"), r(F.max("mrr")).alias("high")).join(interval, "all").drop("all")


_VIEWED = predicted_sql("(SELECT query_id, 0 AS seed, vector AS fused FROM vq)", "w_fit", "query_id")


@query(f"WITH RECURSIVE tr AS (SELECT * FROM {TRAINING}), {fitted_sql('tr')}, pq AS (SELECT * FROM {_VIEWED}), rk AS (SELECT x.*, tier FROM {rank_sql('pq')} x JOIN vq USING (query_id)) {rounded_metrics(metrics_sql('rk', '(SELECT query_id, item_id FROM vq)', 'tier'), 'tier')}")
def graded_ridge_metrics(spark: SparkSession, d: str) -> DataFrame:
    """The fitted ridge ranker on the three tiers."""
    model = ridge.fit(_training(spark, d), "fused", "item_vector", T.DIM)
    views = T.view_queries(spark, d).select("query_id", "vector", "item_id", "tier")
    q = views.select("query_id", model.predict(F.col("vector")).alias("vector"))
    rankings = retrieval.cosine_top_k(q, T.items(spark, d), K, 9)
    return metrics.summary(metrics.per_query(rankings, views, K, ("tier",)), ("tier",), 6)
