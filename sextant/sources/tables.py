"""The evaluation tables as views over the given star schema and embeddings, in Spark and as SQL.

``SQL`` is the same set of views as common table expressions for DuckDB. Embeddings give items
(every fifth vector) and labelled events (the others): three modalities and the item's vector are
slices of one embedding. Event times, corrections and requests come from events and orders.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sextant.functions import scalars as S
from sextant.functions import vectors as V
from sextant.operators import evaluation as E
from sextant.operators import memory as M
from sextant.operators import policy

DIM = 16
HELD_OUT_FAMILIES = (7, 8, 9)
AS_OF = "2024-02-01 00:00:00"
#: Fixed limits of the request views: (item, enabled, concentration, duration, volume, ventilation).
LIMITS = [("unit-0", True, 1.0, 30.0, 20.0, 1.0), ("unit-1", True, 0.5, 20.0, 25.0, 1.5), ("unit-2", False, 0.0, 0.0, 0.0, 0.0)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _slice(start: int) -> Column:
    return V.normalise(F.slice(F.col("embedding").cast(V.DOUBLES), start, DIM))


def item_name(number: Column) -> Column:
    return F.format_string("item-%06d", number)


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item_id, item_no, family_id, item_vector)"""
    e = table(spark, sf_dir, "embeddings").where("vec_id % 5 = 0")
    return e.select(item_name(F.col("vec_id")).alias("item_id"), F.col("vec_id").alias("item_no"), F.col("label").alias("family_id"), _slice(49).alias("item_vector"))


def all_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event with its target, and the split that its groups allow (null: none)."""
    e = table(spark, sf_dir, "embeddings").where("vec_id % 5 <> 0")
    e = e.select("vec_id", F.format_string("ev-%06d", "vec_id").alias("event_id"), (F.col("vec_id") - F.col("vec_id") % 5).alias("item_no"), (F.col("vec_id") % 20).cast("int").alias("template_id"), _slice(1).alias("text_vector"), _slice(17).alias("image_vector"), _slice(33).alias("audio_vector"))
    families = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item_no"), F.col("label").alias("target_family_id"))
    held, t = F.col("target_family_id").isin(*HELD_OUT_FAMILIES), F.col("template_id") % 5
    split = F.when(~held & t.isin(1, 2) & (F.col("item_no") % 35 != 0), "train").when(~held & (t == 3), "validation").when(held & (t == 4), "ood_test")
    return e.join(families, "item_no").select("vec_id", "event_id", split.alias("split"), "template_id", item_name(F.col("item_no")).alias("target_item_id"), "target_family_id", "text_vector", "image_vector", "audio_vector")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events that have a split, with their fused vector."""
    e = all_events(spark, sf_dir).where("split is not null")
    return e.withColumn("fused", V.fuse([F.col("text_vector"), F.col("image_vector"), F.col("audio_vector")], strict=True))


def split_of(spark: SparkSession, sf_dir: str, split: str) -> DataFrame:
    return events(spark, sf_dir).where(F.col("split") == split)


def queries_of(spark: SparkSession, sf_dir: str, split: str, vector: str = "fused") -> DataFrame:
    return split_of(spark, sf_dir, split).select(F.col("event_id").alias("query_id"), F.col(vector).alias("vector"))


def relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select(F.col("event_id").alias("query_id"), F.col("target_item_id").alias("item_id"))


def times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, ts): a UTC timestamp for each vector."""
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("vec_id"), F.col("ts").cast("timestamp").alias("ts"))


def memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record for each training event."""
    return M.build(split_of(spark, sf_dir, "train").join(times(spark, sf_dir), "vec_id"))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identity and severe vectors of each out-of-distribution event; severe: reversed."""
    m = ("text", "image", "audio")
    return split_of(spark, sf_dir, "ood_test").select(S.latent_id(F.col("event_id")).alias("latent_event_id"), "template_id", "target_item_id", "target_family_id", *(F.col(f"{x}_vector").alias(f"id_{x}") for x in m), *(F.reverse(f"{x}_vector").alias(f"sev_{x}") for x in m))


def views(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.views(pairs(spark, sf_dir))


def view_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, tier, latent_event_id, vector: fused, item_id: the target)"""
    fused = V.fuse([F.col("text_vector"), F.col("image_vector"), F.col("audio_vector")], strict=True)
    return views(spark, sf_dir).select(F.col("observed_event_id").alias("query_id"), "tier", "latent_event_id", fused.alias("vector"), F.col("target_item_id").alias("item_id"))


def corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error events as corrections in arrival order, some of them faulty by modulus."""
    e = table(spark, sf_dir, "events").where("event_type = 'error'").withColumn("ts", F.col("ts").cast("timestamp"))
    k = F.col("event_id")
    return e.select(
        k.alias("seq"), F.when(k % 17 == 0, F.concat(F.lit("dup-"), (k % 3).cast("string"))).otherwise(F.concat(F.lit("c-"), k.cast("string"))).alias("correction_id"), F.format_string("memory::ev-%06d", k % 500).alias("memory_id"),
        (F.col("ts") + F.make_dt_interval(F.when(k % 13 == 0, 11).otherwise(31))).alias("corrected_at"), F.when(k % 23 == 0, "").otherwise("review").alias("reason"),
        F.when(k % 4 != 0, item_name(k * 5 % 505)).alias("new_item_id"), F.when(k % 3 == 0, F.array_repeat(F.lit(0.25), F.when(k % 31 == 0, 4).otherwise(DIM).cast("int"))).alias("new_vector"),
        F.when(k % 29 == 0, 1.5).when(k % 5 != 0, 0.5 + (k % 5) / 10.0).alias("new_strength"),
    )


def requests_from(orders: DataFrame) -> DataFrame:
    """Orders as output requests: numbers from prices, nulls by modulus, consent from the status."""
    k, p = F.col("o_orderkey"), F.col("o_totalprice")
    return orders.select(
        F.concat(F.lit("rq-"), k.cast("string")).alias("request_id"), F.concat(F.lit("unit-"), (F.col("o_custkey") % 4).cast("string")).alias("item_id"),
        F.when(k % 11 != 0, F.floor(p % 13) / 10.0).alias("concentration_ppm"), F.when(k % 19 != 0, F.floor(p % 37).cast("double")).alias("duration_seconds"), F.when(k % 29 != 0, 15.0 + F.floor(p % 17)).alias("environment_volume_m3"),
        F.when(k % 31 != 0, F.floor(p % 7) / 2.0).alias("ventilation_ach"), F.when(F.col("o_orderstatus") == "P", None).otherwise(F.col("o_orderstatus") == "F").alias("user_consent"),
    )


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return requests_from(table(spark, sf_dir, "orders"))


def limits(spark: SparkSession) -> DataFrame:
    return policy.limits_table(spark, LIMITS)


def rounded(df: DataFrame, digits: int = 9) -> DataFrame:
    """Doubles rounded, with -0.0 as 0.0, for comparisons between engines."""
    return df.select(*((F.round(f.name, digits) + F.lit(0.0)).alias(f.name) if f.dataType.simpleString() == "double" else F.col(f.name) for f in df.schema))


def unit_sql(x: str) -> str:
    return f"list_transform({x}, lambda z: z / sqrt(list_inner_product({x}, {x})))"


_FUSED = "list_transform(range(1, 17), lambda k: ({t}[k] + {i}[k] + {a}[k]) / 3.0)"
_LIMITS = ", ".join(f"('{i}', {str(e).upper()}, {c}::DOUBLE, {d}::DOUBLE, {v}::DOUBLE, {n}::DOUBLE)" for i, e, c, d, v, n in LIMITS)

SQL = f"""
vecs AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
cut AS (SELECT vec_id, label, e[1:16] AS t0, e[17:32] AS i0, e[33:48] AS a0, e[49:64] AS r0 FROM vecs),
items AS (SELECT printf('item-%06d', vec_id) AS item_id, vec_id AS item_no, label AS family_id, {unit_sql('r0')} AS item_vector FROM cut WHERE vec_id % 5 = 0),
raw_events AS (SELECT c.vec_id, printf('ev-%06d', c.vec_id) AS event_id, c.vec_id - c.vec_id % 5 AS item_no, CAST(c.vec_id % 20 AS INTEGER) AS template_id, f.label AS target_family_id,
    {unit_sql('c.t0')} AS text_vector, {unit_sql('c.i0')} AS image_vector, {unit_sql('c.a0')} AS audio_vector
    FROM cut c JOIN embeddings f ON f.vec_id = c.vec_id - c.vec_id % 5 WHERE c.vec_id % 5 <> 0),
all_events AS (SELECT vec_id, event_id, printf('item-%06d', item_no) AS target_item_id, target_family_id, template_id, text_vector, image_vector, audio_vector,
    CASE WHEN target_family_id NOT IN (7, 8, 9) AND template_id % 5 IN (1, 2) AND item_no % 35 <> 0 THEN 'train' WHEN target_family_id NOT IN (7, 8, 9) AND template_id % 5 = 3 THEN 'validation'
         WHEN target_family_id IN (7, 8, 9) AND template_id % 5 = 4 THEN 'ood_test' END AS split FROM raw_events),
mixed AS (SELECT *, {_FUSED.format(t='text_vector', i='image_vector', a='audio_vector')} AS f0 FROM all_events WHERE split IS NOT NULL),
ev AS (SELECT * EXCLUDE (f0), {unit_sql('f0')} AS fused FROM mixed),
mem AS (SELECT 'memory::' || ev.event_id AS memory_id, ev.fused AS context_vector, ev.target_item_id AS item_id, t.ts AS created_at, t.ts AS updated_at, 1.0::DOUBLE AS strength, 0 AS correction_count, TRUE AS active
    FROM ev JOIN events t ON t.event_id = ev.vec_id WHERE ev.split = 'train'),
tiers AS (SELECT * FROM (VALUES ('mild', 0.25::DOUBLE, 7001), ('moderate', 0.5::DOUBLE, 8001), ('severe', 1.0::DOUBLE, 9001)) AS x(tier, strength, tier_seed)),
blended AS (SELECT 'latent-' || event_id AS latent_event_id, tier, strength, tier_seed, template_id, target_item_id, target_family_id,
    list_transform(range(1, 17), lambda k: (1 - strength) * text_vector[k] + strength * text_vector[17 - k]) AS t0, list_transform(range(1, 17), lambda k: (1 - strength) * image_vector[k] + strength * image_vector[17 - k]) AS i0,
    list_transform(range(1, 17), lambda k: (1 - strength) * audio_vector[k] + strength * audio_vector[17 - k]) AS a0 FROM ev, tiers WHERE split = 'ood_test'),
vw AS (SELECT latent_event_id, latent_event_id || '::' || tier AS observed_event_id, tier, strength, tier_seed, template_id, target_item_id, target_family_id, {unit_sql('t0')} AS text_vector, {unit_sql('i0')} AS image_vector, {unit_sql('a0')} AS audio_vector FROM blended),
vw_mixed AS (SELECT *, {_FUSED.format(t='text_vector', i='image_vector', a='audio_vector')} AS f0 FROM vw),
vq AS (SELECT observed_event_id AS query_id, tier, latent_event_id, {unit_sql('f0')} AS vector, target_item_id AS item_id FROM vw_mixed),
corr AS (SELECT event_id AS seq, CASE WHEN event_id % 17 = 0 THEN 'dup-' || (event_id % 3) ELSE 'c-' || event_id END AS correction_id, printf('memory::ev-%06d', event_id % 500) AS memory_id,
    ts + to_days(CASE WHEN event_id % 13 = 0 THEN 11 ELSE 31 END) AS corrected_at, CASE WHEN event_id % 23 = 0 THEN '' ELSE 'review' END AS reason, CASE WHEN event_id % 4 <> 0 THEN printf('item-%06d', event_id * 5 % 505) END AS new_item_id,
    CASE WHEN event_id % 3 = 0 THEN list_transform(range(CASE WHEN event_id % 31 = 0 THEN 4 ELSE 16 END), lambda x: 0.25::DOUBLE) END AS new_vector,
    CASE WHEN event_id % 29 = 0 THEN 1.5::DOUBLE WHEN event_id % 5 <> 0 THEN 0.5::DOUBLE + (event_id % 5) / 10.0::DOUBLE END AS new_strength FROM events WHERE event_type = 'error'),
rq AS (SELECT 'rq-' || o_orderkey AS request_id, 'unit-' || (o_custkey % 4) AS item_id, CASE WHEN o_orderkey % 11 <> 0 THEN floor(o_totalprice % 13) / 10.0::DOUBLE END AS concentration_ppm, CASE WHEN o_orderkey % 19 <> 0 THEN floor(o_totalprice % 37) END AS duration_seconds,
    CASE WHEN o_orderkey % 29 <> 0 THEN 15.0::DOUBLE + floor(o_totalprice % 17) END AS environment_volume_m3, CASE WHEN o_orderkey % 31 <> 0 THEN floor(o_totalprice % 7) / 2.0::DOUBLE END AS ventilation_ach, CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus = 'F' END AS user_consent FROM orders),
lim AS (SELECT * FROM (VALUES {_LIMITS}) AS x(item_id, enabled, max_concentration, max_duration, min_volume, min_ventilation))
"""
