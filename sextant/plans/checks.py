"""Queries: row validation, selections, joins, splits, leakage and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sextant.functions import vectors as V
from sextant.operators import evaluation as E
from sextant.operators import leakage, metrics, splits, validation
from sextant.operators import memory as M
from sextant.plans.ranking import THREE_SHUFFLED, _three
from sextant.plans.register import query
from sextant.sources import tables as T


def _err(*tests: tuple[str, str]) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN {t} THEN '{n}' END" for t, n in tests) + "], lambda x: x IS NOT NULL)"


_BROKEN = """broken AS (SELECT event_id, vec_id, split, template_id, target_item_id, target_family_id, CASE WHEN vec_id % 3 = 0 THEN NULL WHEN vec_id % 11 = 0 THEN text_vector[1:4] ELSE text_vector END AS t, CASE WHEN vec_id % 6 <> 0 THEN image_vector END AS i,
    CASE WHEN vec_id % 3 = 0 AND vec_id % 4 = 0 THEN NULL WHEN vec_id % 13 = 0 THEN list_transform(audio_vector, lambda x: 'nan'::DOUBLE) ELSE audio_vector END AS a FROM ev)"""


def _broken(spark: SparkSession, d: str) -> DataFrame:
    e, k = T.events(spark, d), F.col("vec_id")
    return e.select(
        "event_id", "vec_id", "split", "template_id", "target_item_id", "target_family_id", F.when(k % 3 != 0, F.when(k % 11 == 0, F.slice("text_vector", 1, 4)).otherwise(F.col("text_vector"))).alias("t"), F.when(k % 6 != 0, F.col("image_vector")).alias("i"),
        F.when(~((k % 3 == 0) & (k % 4 == 0)), F.when(k % 13 == 0, F.transform("audio_vector", lambda _: F.lit(float("nan")))).otherwise(F.col("audio_vector"))).alias("a"),
    )


@query(f"""WITH {_BROKEN}, s AS (SELECT *, list_filter([t, i, a], lambda v: v IS NOT NULL) AS vs FROM broken)
    SELECT event_id, {_err(("len(vs) = 0", "no modality"), ("len(list_distinct(list_transform(vs, lambda v: len(v)))) > 1", "dimensions differ"), ("list_bool_or(list_transform(vs, lambda v: list_bool_or(list_transform(v, lambda x: isnan(x) OR isinf(x)))))", "not finite"))} AS errors FROM s""")
def context_errors(spark: SparkSession, d: str) -> DataFrame:
    return _broken(spark, d).select("event_id", validation.context_errors(F.col("t"), F.col("i"), F.col("a")).alias("errors"))


@query("SELECT vec_id, abs(sqrt(list_inner_product(f, f)) - 1) <= 1e-10 AS unit FROM (SELECT vec_id, CASE WHEN vec_id % 5 = 1 THEN list_transform(fused, lambda x: 2 * x) ELSE fused END AS f FROM ev)")
def unit_norms(spark: SparkSession, d: str) -> DataFrame:
    f = F.when(F.col("vec_id") % 5 == 1, F.transform("fused", lambda x: 2 * x)).otherwise(F.col("fused"))
    return T.events(spark, d).select("vec_id", V.is_unit(f).alias("unit"))


@query(f"""SELECT k, {_err(("trim(memory_id) = ''", "blank memory_id"), ("item_id IS NULL", "blank item_id"), ("updated_at < created_at", "updated before created"), ("NOT (strength > 0 AND strength <= 1)", "strength outside (0, 1]"), ("correction_count < 0", "negative correction count"))} AS errors
    FROM (SELECT event_id AS k, CASE WHEN event_id % 5 = 0 THEN ' ' ELSE 'm' || event_id END AS memory_id, CASE WHEN event_id % 7 <> 0 THEN 'item' END AS item_id, ts AS created_at, CASE WHEN event_id % 11 = 0 THEN ts - INTERVAL 1 DAY ELSE ts END AS updated_at, (value % 3)::DOUBLE / 2 AS strength, event_id % 4 - 1 AS correction_count FROM events)""")
def memory_errors(spark: SparkSession, d: str) -> DataFrame:
    e, k = T.table(spark, d, "events"), F.col("event_id")
    return e.select(k.alias("k"), validation.memory_errors(
        F.when(k % 5 == 0, " ").otherwise(F.concat(F.lit("m"), k.cast("string"))), F.when(k % 7 != 0, "item"), F.col("ts"), F.when(k % 11 == 0, F.col("ts") - F.expr("interval 1 day")).otherwise(F.col("ts")), (F.col("value") % 3) / 2, k % 4 - 1).alias("errors"))


@query(f"""SELECT k, {_err(("FALSE", "blank request_id"), ("item_id IS NULL", "blank item_id"), ("a IS NOT NULL AND (isnan(a) OR a < 0)", "number 1"), ("b IS NOT NULL AND b < 0", "number 2"))} AS errors FROM
    (SELECT o_orderkey AS k, CASE WHEN o_custkey % 9 <> 0 THEN 'unit' END AS item_id, CASE WHEN o_orderkey % 6 = 0 THEN 'nan'::DOUBLE WHEN o_orderkey % 5 <> 0 THEN o_totalprice - 100000 END AS a, CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice - 200000 END AS b FROM orders)""")
def request_errors(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    a = F.when(k % 6 == 0, F.lit(float("nan"))).when(k % 5 != 0, F.col("o_totalprice") - 100000)
    b = F.when(k % 7 != 0, F.col("o_totalprice") - 200000)
    return T.table(spark, d, "orders").select(k.alias("k"), validation.request_errors(k.cast("string"), F.when(F.col("o_custkey") % 9 != 0, "unit"), a, b).alias("errors"))


@query(f"""SELECT event_id, {_err(("FALSE", "blank event_id"), ("s NOT IN ('train', 'validation', 'ood_test')", "unknown split"), ("t < 0", "negative template"), ("trim(x) = ''", "blank target"), ("f < 0", "negative family"))} AS errors
    FROM (SELECT event_id, CASE WHEN vec_id % 7 = 0 THEN 'dev' ELSE split END AS s, template_id - 1 AS t, CASE WHEN vec_id % 9 = 0 THEN '' ELSE target_item_id END AS x, target_family_id - 1 AS f FROM ev)""")
def event_errors(spark: SparkSession, d: str) -> DataFrame:
    e, k = T.events(spark, d), F.col("vec_id")
    return e.select("event_id", validation.event_errors(F.col("event_id"), F.when(k % 7 == 0, "dev").otherwise(F.col("split")), F.col("template_id") - 1, F.when(k % 9 == 0, "").otherwise(F.col("target_item_id")), F.col("target_family_id") - 1).alias("errors"))


@query("SELECT event_id, template_id, target_item_id FROM ev WHERE split = 'validation'")
def select_split(spark: SparkSession, d: str) -> DataFrame:
    return T.split_of(spark, d, "validation").select("event_id", "template_id", "target_item_id")


@query("SELECT observed_event_id, latent_event_id, list_transform(text_vector, lambda x: round(x, 9) + 0.0) AS text_vector FROM vw WHERE tier = 'moderate'")
def select_tier(spark: SparkSession, d: str) -> DataFrame:
    return T.views(spark, d).where("tier = 'moderate'").select("observed_event_id", "latent_event_id", V.rounded(F.col("text_vector")).alias("text_vector"))


@query("SELECT observed_event_id AS event_id, 'ood_test' AS split, template_id, target_item_id, target_family_id FROM vw")
def views_as_events(spark: SparkSession, d: str) -> DataFrame:
    return E.as_events(T.views(spark, d)).select("event_id", "split", "template_id", "target_item_id", "target_family_id")


@query("SELECT vec_id, day, ts + to_days(day) AS as_of FROM (SELECT event_id AS vec_id, ts FROM events) t, (VALUES (0), (1), (7), (30), (90)) AS x(day)")
def displaced_times(spark: SparkSession, d: str) -> DataFrame:
    return E.displaced(T.table(spark, d, "events").select(F.col("event_id").alias("vec_id"), "ts"), "ts", [0, 1, 7, 30, 90]).select("vec_id", "day", "as_of")


@query("SELECT q.event_id AS query_id, ts AS as_of, latest FROM ev q JOIN events t ON t.event_id = q.vec_id, (SELECT max(updated_at) AS latest FROM mem WHERE memory_id NOT LIKE '%1') WHERE split = 'validation' AND ts < latest")
def early_queries(spark: SparkSession, d: str) -> DataFrame:
    """Queries before the last update of an active record; some records are switched off."""
    q = T.split_of(spark, d, "validation").join(T.times(spark, d), "vec_id").select(F.col("event_id").alias("query_id"), F.col("ts").alias("as_of"))
    memory = T.memory(spark, d).withColumn("active", ~F.col("memory_id").like("%1"))
    out = M.early_queries(q, memory)
    return out.select("query_id", F.col("as_of").cast("timestamp_ntz").alias("as_of"), F.col("latest").cast("timestamp_ntz").alias("latest"))


@query("SELECT count(*) AS total, count(*) FILTER (WHERE memory_id NOT LIKE '%1') AS active FROM mem")
def memory_sizes(spark: SparkSession, d: str) -> DataFrame:
    return M.sizes(T.memory(spark, d).withColumn("active", ~F.col("memory_id").like("%1")))


@query("""WITH r AS (SELECT o_custkey % 50 AS query_id, o_orderkey, row_number() OVER (PARTITION BY o_custkey % 50 ORDER BY o_orderkey) AS rank, o_orderkey % 40 AS item FROM orders),
    k AS (SELECT query_id::VARCHAR AS query_id, CASE WHEN query_id % 4 = 0 AND rank = 2 THEN 3 ELSE rank END AS rank, CASE WHEN query_id % 5 = 0 AND rank = 1 THEN ' ' ELSE 'i' || item END AS item_id FROM r WHERE rank <= 8 + query_id % 5),
    p AS (SELECT query_id, count(*) AS n, count(DISTINCT item_id) AS items, count(DISTINCT rank) AS ranks, min(rank) AS low, max(rank) AS high, count(*) FILTER (WHERE trim(item_id) = '') AS blanks FROM k GROUP BY 1),
    l AS (SELECT query_id, unnest(list_filter([CASE WHEN items < n - blanks THEN 'duplicate item' END, CASE WHEN low <> 1 OR high <> n OR ranks <> n THEN 'ranks not consecutive' END, CASE WHEN n > 10 THEN 'longer than k' END, CASE WHEN blanks > 0 THEN 'blank item' END], lambda x: x IS NOT NULL)) AS problem FROM p)
    SELECT * FROM l UNION ALL SELECT DISTINCT query_id, 'no relevant item' FROM k WHERE query_id::INT % 6 = 0 UNION ALL SELECT x::VARCHAR, 'empty ranking' FROM range(50, 55) AS y(x) WHERE x % 6 <> 0""")
def ranking_problems(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    q = F.col("o_custkey") % 50
    r = T.table(spark, d, "orders").select(q.alias("q"), F.row_number().over(Window.partitionBy(q).orderBy("o_orderkey")).alias("rank"), (F.col("o_orderkey") % 40).alias("item")).where("rank <= 8 + q % 5")
    k = r.select(F.col("q").cast("string").alias("query_id"), F.when((F.col("q") % 4 == 0) & (F.col("rank") == 2), 3).otherwise(F.col("rank")).alias("rank"), F.when((F.col("q") % 5 == 0) & (F.col("rank") == 1), " ").otherwise(F.concat(F.lit("i"), F.col("item").cast("string"))).alias("item_id"))
    wanted = spark.range(55).where("id % 6 <> 0").select(F.col("id").cast("string").alias("query_id"), F.lit("i0").alias("item_id"))
    # queries that no order ranks are those of the given range only
    wanted = wanted.join(k.select("query_id").distinct().unionByName(spark.range(50, 55).select(F.col("id").cast("string").alias("query_id"))), "query_id", "left_semi")
    return validation.ranking_problems(k, wanted, 10)


@query("SELECT ev.event_id, i.item_id, round(list_inner_product(ev.fused, i.item_vector), 9) AS agreement FROM ev JOIN items i ON i.item_id = ev.target_item_id WHERE split = 'train'")
def training_targets(spark: SparkSession, d: str) -> DataFrame:
    items = T.items(spark, d).select("item_id", "item_vector")
    e = T.split_of(spark, d, "train").join(items, F.col("target_item_id") == F.col("item_id"))
    return e.select("event_id", "item_id", F.round(V.dot(F.col("fused"), F.col("item_vector")), 9).alias("agreement"))


@query("SELECT DISTINCT target_item_id FROM ev WHERE split = 'train' AND target_item_id NOT IN (SELECT item_id FROM items WHERE item_no % 3 <> 0)")
def targets_without_item(spark: SparkSession, d: str) -> DataFrame:
    items = T.items(spark, d).where("item_no % 3 <> 0").select(F.col("item_id").alias("target_item_id"))
    return T.split_of(spark, d, "train").select("target_item_id").distinct().join(items, "target_item_id", "left_anti")


@query("SELECT event_id, CASE WHEN i.family_id IS NULL THEN 'unknown target' ELSE 'family differs' END AS problem FROM ev LEFT JOIN (SELECT item_id, CASE WHEN item_no % 20 = 0 THEN family_id + 1 ELSE family_id END AS family_id FROM items WHERE item_no % 15 <> 0) i ON i.item_id = ev.target_item_id WHERE i.family_id IS NULL OR i.family_id <> target_family_id")
def unknown_targets(spark: SparkSession, d: str) -> DataFrame:
    items = T.items(spark, d).where("item_no % 15 <> 0").withColumn("family_id", F.when(F.col("item_no") % 20 == 0, F.col("family_id") + 1).otherwise(F.col("family_id")))
    return validation.unknown_targets(T.events(spark, d), items)


@query("""WITH a AS (SELECT 'latent-' || event_id AS id, vec_id AS v, target_family_id AS f FROM ev WHERE split = 'ood_test' AND vec_id % 4 <> 0), b AS (SELECT 'latent-' || event_id AS id, vec_id AS v, CASE WHEN vec_id % 3 = 0 THEN 0 ELSE target_family_id END AS f FROM ev WHERE split = 'ood_test' AND vec_id % 6 <> 0)
    SELECT coalesce(a.id, b.id) AS latent_event_id, unnest(list_filter([CASE WHEN a.id IS NULL OR b.id IS NULL THEN 'unpaired' END, CASE WHEN a.f <> b.f THEN 'family differs' END, CASE WHEN a.v IS NOT NULL AND b.v IS NOT NULL AND a.v % 7 = 0 THEN 'dimensions differ' END], lambda x: x IS NOT NULL)) AS problem FROM a FULL JOIN b ON a.id = b.id""")
def pair_problems(spark: SparkSession, d: str) -> DataFrame:
    e = T.split_of(spark, d, "ood_test").withColumn("latent_event_id", F.concat(F.lit("latent-"), "event_id"))
    severe = e.where("vec_id % 6 <> 0").withColumn("target_family_id", F.when(F.col("vec_id") % 3 == 0, 0).otherwise(F.col("target_family_id"))).withColumn("audio_vector", F.when(F.col("vec_id") % 7 == 0, F.slice("audio_vector", 1, 3)).otherwise(F.col("audio_vector")))
    return E.pair_problems(e.where("vec_id % 4 <> 0"), severe)


@query("SELECT event_id FROM ev WHERE split = 'validation' AND target_item_id IN (SELECT target_item_id FROM ev WHERE split = 'train')")
def eligible_queries(spark: SparkSession, d: str) -> DataFrame:
    e = T.events(spark, d)
    return e.where("split = 'validation'").join(e.where("split = 'train'").select("target_item_id"), "target_item_id", "left_semi").select("event_id")


@query("SELECT DISTINCT target_item_id FROM ev WHERE split = 'validation' AND target_item_id NOT IN (SELECT target_item_id FROM ev WHERE split = 'train')")
def excluded_targets(spark: SparkSession, d: str) -> DataFrame:
    e = T.events(spark, d)
    return e.where("split = 'validation'").select("target_item_id").distinct().join(e.where("split = 'train'").select("target_item_id"), "target_item_id", "left_anti")


#: Events with faults for the audit: every 40th once more in another split, every 50th twice.
_FAULTY = """faulty AS (SELECT event_id, split, template_id, target_item_id, target_family_id, vec_id, text_vector, image_vector, audio_vector FROM ev UNION ALL SELECT event_id || '-x', 'ood_test', template_id, target_item_id, target_family_id, vec_id, text_vector, image_vector, audio_vector FROM ev WHERE vec_id % 40 = 1
    UNION ALL SELECT event_id, split, template_id, target_item_id, target_family_id, vec_id, text_vector, image_vector, audio_vector FROM ev WHERE vec_id % 50 = 2)"""


def _faulty(spark: SparkSession, d: str) -> DataFrame:
    e = T.events(spark, d).select("event_id", "split", "template_id", "target_item_id", "target_family_id", "vec_id", "text_vector", "image_vector", "audio_vector")
    moved = e.where("vec_id % 40 = 1").withColumn("event_id", F.concat("event_id", F.lit("-x"))).withColumn("split", F.lit("ood_test"))
    return e.unionByName(moved).unionByName(e.where("vec_id % 50 = 2"))


@query("SELECT s.split, count(ev.event_id) AS n FROM (VALUES ('train'), ('validation'), ('ood_test'), ('calibration')) AS s(split) LEFT JOIN ev ON ev.split = s.split GROUP BY 1")
def split_counts(spark: SparkSession, d: str) -> DataFrame:
    return leakage.split_counts(T.events(spark, d), (*validation.SPLITS, "calibration"))


@query("SELECT t.tier, count(v.tier) AS n FROM tiers t LEFT JOIN (SELECT * FROM vw WHERE tier <> 'mild') v ON v.tier = t.tier GROUP BY 1")
def tier_counts(spark: SparkSession, d: str) -> DataFrame:
    return leakage.split_counts(T.views(spark, d).where("tier <> 'mild'"), tuple(t for t, _, _ in E.TIERS), "tier")


@query("SELECT s.split FROM (VALUES ('train'), ('validation'), ('ood_test')) AS s(split) WHERE s.split NOT IN (SELECT split FROM ev WHERE split <> 'validation')")
def missing_splits(spark: SparkSession, d: str) -> DataFrame:
    return leakage.missing_splits(T.events(spark, d).where("split <> 'validation'"))


@query(f"WITH {_FAULTY} SELECT event_id, count(*) AS n FROM faulty GROUP BY 1 HAVING count(*) > 1")
def duplicate_events(spark: SparkSession, d: str) -> DataFrame:
    return validation.duplicates(_faulty(spark, d), "event_id")


@query(f"WITH {_FAULTY} SELECT count(*) AS shared FROM (SELECT template_id, text_vector, image_vector, audio_vector FROM faulty GROUP BY ALL HAVING count(DISTINCT split) > 1)")
def shared_features(spark: SparkSession, d: str) -> DataFrame:
    return leakage.shared_features(_faulty(spark, d)).agg(F.count("*").alias("shared"))


@query(f"WITH {_FAULTY} SELECT DISTINCT target_family_id FROM faulty WHERE split <> 'ood_test' INTERSECT SELECT target_family_id FROM faulty WHERE split = 'ood_test'")
def family_overlap(spark: SparkSession, d: str) -> DataFrame:
    return leakage.family_overlap(_faulty(spark, d))


@query(f"WITH {_FAULTY} SELECT template_id FROM faulty GROUP BY 1 HAVING count(DISTINCT split) > 1")
def template_overlap(spark: SparkSession, d: str) -> DataFrame:
    return leakage.template_overlap(_faulty(spark, d))


@query("SELECT event_id FROM ev WHERE split = 'train' INTERSECT SELECT CASE WHEN vec_id % 9 = 0 THEN replace(event_id, '3', '1') ELSE event_id END FROM ev WHERE split = 'validation'")
def shared_event_ids(spark: SparkSession, d: str) -> DataFrame:
    e = T.events(spark, d)
    renamed = F.when((F.col("split") == "validation") & (F.col("vec_id") % 9 == 0), F.replace("event_id", F.lit("3"), F.lit("1"))).otherwise(F.col("event_id"))
    return leakage.shared_ids(e.withColumn("event_id", renamed), "train", "validation")


@query(f"""WITH {_FAULTY}, dup AS (SELECT event_id FROM faulty GROUP BY 1 HAVING count(*) > 1), fam AS (SELECT DISTINCT target_family_id AS f FROM faulty WHERE split <> 'ood_test' INTERSECT SELECT target_family_id FROM faulty WHERE split = 'ood_test'), tem AS (SELECT template_id FROM faulty GROUP BY 1 HAVING count(DISTINCT split) > 1),
    feat AS (SELECT 1 FROM faulty GROUP BY template_id, text_vector, image_vector, audio_vector HAVING count(DISTINCT split) > 1)
    SELECT (SELECT count(*) FROM faulty) AS event_count, (SELECT count(*) FROM items) AS target_count, (SELECT count(*) FROM dup) AS n_duplicate_event_ids, (SELECT list(event_id ORDER BY event_id) FROM dup) AS duplicate_event_ids, (SELECT count(*) FROM feat) AS n_cross_split_features,
    (SELECT list(f ORDER BY f) FROM fam) AS ood_family_overlap, (SELECT list(template_id ORDER BY template_id) FROM tem) AS template_overlap, 0::BIGINT AS n_inconsistent_targets, 0::BIGINT AS n_missing_splits, FALSE AS passed""")
def leakage_report(spark: SparkSession, d: str) -> DataFrame:
    r = leakage.report(_faulty(spark, d), T.items(spark, d))
    return r.select("event_count", "target_count", "n_duplicate_event_ids", "duplicate_event_ids", "n_cross_split_features", "ood_family_overlap", "template_overlap", "n_inconsistent_targets", "n_missing_splits", "passed")


_CHECKED = f"""WITH {_FAULTY}, fam AS (SELECT DISTINCT target_family_id AS f FROM faulty WHERE split <> 'ood_test' INTERSECT SELECT target_family_id FROM faulty WHERE split = 'ood_test'), known AS (SELECT item_id, CASE WHEN item_id LIKE '%7' THEN family_id + 1 ELSE family_id END AS family FROM items WHERE item_id NOT LIKE '%9'),
    found AS (SELECT 'duplicate_event_ids' AS "check", event_id AS id FROM faulty GROUP BY event_id HAVING count(*) > 1 UNION ALL SELECT 'ood_family_overlap', CAST(f AS VARCHAR) FROM fam UNION ALL SELECT 'template_overlap', CAST(template_id AS VARCHAR) FROM faulty GROUP BY template_id HAVING count(DISTINCT split) > 1
    UNION ALL SELECT 'inconsistent_targets', event_id FROM faulty LEFT JOIN known ON item_id = target_item_id WHERE family IS NULL OR family <> target_family_id UNION ALL SELECT 'cross_split_features', NULL FROM faulty GROUP BY template_id, text_vector, image_vector, audio_vector HAVING count(DISTINCT split) > 1)"""


def _known(spark: SparkSession, d: str) -> DataFrame:
    """Items of which some are gone and some moved to another family."""
    i = T.items(spark, d).where("item_id not like '%9'")
    return i.withColumn("family_id", F.when(F.col("item_id").like("%7"), F.col("family_id") + 1).otherwise(F.col("family_id")))


@query(_CHECKED + """ SELECT (SELECT count(*) FROM faulty) AS event_count, (SELECT count(*) FROM known) AS target_count, count(*) FILTER (WHERE "check" = 'duplicate_event_ids') AS n_duplicate_event_ids, 0::BIGINT AS n_duplicate_item_ids, count(*) FILTER (WHERE "check" = 'cross_split_features') AS n_cross_split_features,
    count(*) FILTER (WHERE "check" = 'ood_family_overlap') AS n_ood_family_overlap, count(*) FILTER (WHERE "check" = 'template_overlap') AS n_template_overlap, count(*) FILTER (WHERE "check" = 'inconsistent_targets') AS n_inconsistent_targets, 0::BIGINT AS n_missing_splits, FALSE AS passed FROM found""")
def leakage_summary(spark: SparkSession, d: str) -> DataFrame:
    """The audit's counts without lists."""
    return leakage.summary(_faulty(spark, d), _known(spark, d)).drop("split_counts")


@query(_CHECKED + """ SELECT "check", (n + 4) // 5 AS page, list(id ORDER BY n) AS ids FROM (SELECT "check", id, row_number() OVER (PARTITION BY "check" ORDER BY id) AS n FROM found WHERE "check" <> 'cross_split_features') GROUP BY 1, 2""")
def leakage_pages(spark: SparkSession, d: str) -> DataFrame:
    """The audit's violations, five ids on a page; fingerprints aside, as engines print numbers differently."""
    return leakage.pages(leakage.violations(_faulty(spark, d), _known(spark, d)).where(F.col("check") != "cross_split_features"), 5)


_WHOLE = ", ".join(f"'{m}_vector': list_transform({m}_vector, lambda x: CAST(floor(1000 * x) AS BIGINT))" for m in ("text", "image", "audio"))


@query(f"SELECT event_id, sha256(CAST(to_json({{'template_id': template_id, {_WHOLE}}}) AS VARCHAR)) AS fingerprint FROM ev")
def feature_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    """The fingerprint of each event's features, in whole thousandths, which all engines print alike."""
    names = ("text_vector", "image_vector", "audio_vector")
    whole = T.events(spark, d).withColumns({v: F.transform(v, lambda x: F.floor(1000 * x)) for v in names})
    return whole.select("event_id", leakage.feature_key(*names).alias("fingerprint"))


_PLACE = "row_number() OVER (ORDER BY sha256(concat_ws(':', '5', {g})), {g})"


@query(f"SELECT family_id, CASE WHEN k <= greatest(1, least(n - 1, round_even(n * 0.3::DOUBLE, 0))) THEN 'ood' ELSE 'development' END AS pool FROM (SELECT family_id, {_PLACE.format(g='family_id')} AS k, count(*) OVER () AS n FROM (SELECT DISTINCT label AS family_id FROM embeddings))")
def family_pools(spark: SparkSession, d: str) -> DataFrame:
    return splits.family_pools(T.table(spark, d, "embeddings").select(F.col("label").alias("family_id")), 5)


_TEMPLATES = f"SELECT template_id, CASE WHEN k <= o THEN 'ood_test' WHEN k <= o + v THEN 'validation' ELSE 'train' END AS pool FROM (SELECT *, greatest(1, least(n - 1, round_even(n * 0.2::DOUBLE, 0))) AS o, greatest(1, least(n - 1, round_even(n * 0.1::DOUBLE, 0))) AS v FROM (SELECT template_id, {_PLACE.format(g='template_id')} AS k, count(*) OVER () AS n FROM (SELECT DISTINCT vec_id % 20 AS template_id FROM embeddings)))"


@query(_TEMPLATES)
def template_pools(spark: SparkSession, d: str) -> DataFrame:
    return splits.template_pools(T.table(spark, d, "embeddings").select((F.col("vec_id") % 20).alias("template_id")), 5)


@query(f"""WITH f AS (SELECT family_id, CASE WHEN k <= greatest(1, least(n - 1, round_even(n * 0.3::DOUBLE, 0))) THEN 'ood' ELSE 'development' END AS pool FROM (SELECT family_id, {_PLACE.format(g='family_id')} AS k, count(*) OVER () AS n FROM (SELECT DISTINCT label AS family_id FROM embeddings))), t AS ({_TEMPLATES})
    SELECT event_id, CASE WHEN f.pool = 'ood' AND t.pool = 'ood_test' THEN 'ood_test' WHEN f.pool = 'development' AND t.pool <> 'ood_test' THEN t.pool END AS split FROM all_events e JOIN f ON f.family_id = e.target_family_id JOIN t USING (template_id)""")
def planned_splits(spark: SparkSession, d: str) -> DataFrame:
    return splits.assign(T.all_events(spark, d).drop("split"), family_pools(spark, d), template_pools(spark, d)).select("event_id", "split")


@query("SELECT l_suppkey, count(*) - CAST(round_even(count(*) * 0.1::DOUBLE, 0) AS BIGINT) - CAST(round_even(count(*) * 0.25::DOUBLE, 0) AS BIGINT) AS train, CAST(round_even(count(*) * 0.1::DOUBLE, 0) AS BIGINT) AS validation, CAST(round_even(count(*) * 0.25::DOUBLE, 0) AS BIGINT) AS ood_test FROM lineitem GROUP BY 1")
def split_sizes(spark: SparkSession, d: str) -> DataFrame:
    n = T.table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n"))
    return n.select("l_suppkey", *(c.alias(k) for k, c in splits.split_sizes(F.col("n"), 0.1, 0.25).items()))


@query(f"SELECT query_id, ranker, list(item_id ORDER BY rank) AS ranking FROM {THREE_SHUFFLED} GROUP BY ALL")
def nested_rankings(spark: SparkSession, d: str) -> DataFrame:
    """Rankings as arrays; the random ranker orders the whole library for each query."""
    return metrics.nested(_three(spark, d, shuffled=True), ("ranker", "query_id"))


@query("SELECT latent_event_id, unnest(list_filter([CASE WHEN n <> 3 THEN 'number of views' END, CASE WHEN tiers <> ['mild', 'moderate', 'severe'] THEN 'tiers' END, CASE WHEN labels <> 1 THEN 'labels differ' END], lambda x: x IS NOT NULL)) AS problem FROM (SELECT latent_event_id, count(*) AS n, list_sort(list_distinct(list(tier))) AS tiers, count(DISTINCT f) AS labels FROM (SELECT *, CASE WHEN template_id % 8 = 4 AND tier = 'severe' THEN 0 ELSE target_family_id END AS f FROM vw WHERE NOT (target_item_id LIKE '%5' AND tier = 'mild')) GROUP BY 1)")
def view_problems(spark: SparkSession, d: str) -> DataFrame:
    v = T.views(spark, d).where("not (target_item_id like '%5' and tier = 'mild')")
    v = v.withColumn("target_family_id", F.when((F.col("template_id") % 8 == 4) & (F.col("tier") == "severe"), 0).otherwise(F.col("target_family_id")))
    return E.view_problems(v)


@query("SELECT item_id, list(memory_id ORDER BY memory_id) AS memory_ids FROM mem GROUP BY 1")
def memories_by_target(spark: SparkSession, d: str) -> DataFrame:
    return M.grouped_by_target(T.memory(spark, d))


@query("SELECT memory_id, item_id, created_at, strength, list_transform(context_vector, lambda x: round(x, 9) + 0.0) AS context_vector FROM mem")
def memory_build(spark: SparkSession, d: str) -> DataFrame:
    return T.memory(spark, d).select("memory_id", "item_id", F.col("created_at").cast("timestamp_ntz").alias("created_at"), "strength", V.rounded(F.col("context_vector")).alias("context_vector"))

