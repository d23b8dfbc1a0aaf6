"""Queries: exports read back, manifests and fingerprints."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sextant.functions import vectors as V
from sextant.operators import evaluation as E
from sextant.operators import leakage
from sextant.plans.changes import DECIDE, EXPECTED, expected_outcomes, policy_decisions
from sextant.plans.evaluation import GRADED, _graded_rr
from sextant.plans.ranking import THREE, _three
from sextant.plans.register import query
from sextant.sources import exports
from sextant.sources import tables as T
from sextant.sources.scratch import keep, new_folder


@query("SELECT item_id, family_id, list_transform(item_vector, lambda x: round(x, 9) + 0.0) AS item_vector FROM items")
def items_as_json(spark: SparkSession, d: str) -> DataFrame:
    """The item library written as JSON lines in order of item_id and read back."""
    path = new_folder(spark, "items")
    exports.write(T.items(spark, d).select("item_id", "family_id", V.rounded(F.col("item_vector")).alias("item_vector")), path, "json", order="item_id")
    return spark.read.schema("item_id string, family_id int, item_vector array<double>").json(path)


@query("SELECT event_id, split, template_id, target_item_id, target_family_id, list_transform(text_vector, lambda x: round(x, 9) + 0.0) AS text_vector FROM ev")
def events_as_json(spark: SparkSession, d: str) -> DataFrame:
    path = new_folder(spark, "events")
    e = T.events(spark, d).select("event_id", "split", "template_id", "target_item_id", "target_family_id", V.rounded(F.col("text_vector")).alias("text_vector"))
    exports.write(e, path, "json", order="event_id")
    return spark.read.schema("event_id string, split string, template_id int, target_item_id string, target_family_id int, text_vector array<double>").json(path)


@query("SELECT event_id, split, target_family_id, template_id FROM ev")
def split_manifest_as_csv(spark: SparkSession, d: str) -> DataFrame:
    path = new_folder(spark, "splits")
    exports.split_manifest(T.events(spark, d), path)
    return exports.read_split_manifest(spark, path)


@query("""SELECT count(*) AS rows, CAST(sum(CAST(CAST('0x' || substr(sha256(CAST(to_json({'o_custkey': o_custkey, 'o_orderkey': o_orderkey, 'o_orderpriority': o_orderpriority, 'o_orderstatus': o_orderstatus}) AS VARCHAR)), 1, 15) AS BIGINT) AS HUGEINT)) AS VARCHAR) AS fingerprint FROM orders""")
def table_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    return exports.fingerprint(T.table(spark, d, "orders"), ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"])


_COLUMNS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"]
_LEAVES = """SELECT substr(sha256(CAST(o_orderkey AS VARCHAR)), 1, 3) AS prefix, count(*) AS rows, CAST(sum(CAST(CAST('0x' || substr(sha256(CAST(to_json({{'o_custkey': o_custkey, 'o_orderkey': o_orderkey, 'o_orderpriority': o_orderpriority, 'o_orderstatus': o_orderstatus}}) AS VARCHAR)), 1, 15) AS BIGINT) AS HUGEINT)) AS VARCHAR) AS total FROM {0} GROUP BY 1"""


@query(_LEAVES.format("orders"))
def table_hash_tree(spark: SparkSession, d: str) -> DataFrame:
    """The leaves of the hash tree of orders."""
    return exports.leaves(T.table(spark, d, "orders").select(*_COLUMNS), "o_orderkey")


_TAMPERED = "(SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 997 = 5 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, o_orderpriority FROM orders WHERE o_orderkey % 991 <> 7 UNION ALL SELECT o_orderkey + 100000000, o_custkey, o_orderstatus, o_orderpriority FROM orders WHERE o_orderkey % 983 = 3)"


@query(f"WITH a AS ({_LEAVES.format('orders')}), b AS ({_LEAVES.format(_TAMPERED)}) SELECT prefix, coalesce(a.rows, 0) AS rows_kept, coalesce(b.rows, 0) AS rows_found FROM a FULL JOIN b USING (prefix) WHERE a.total IS DISTINCT FROM b.total OR a.rows IS DISTINCT FROM b.rows")
def tampered_ranges(spark: SparkSession, d: str) -> DataFrame:
    """The ranges of key hashes in which orders were changed, removed or added."""
    orders = T.table(spark, d, "orders").select(*_COLUMNS)
    k = F.col("o_orderkey")
    other = orders.where(k % 991 != 7).withColumn("o_orderstatus", F.when(k % 997 == 5, "X").otherwise(F.col("o_orderstatus")))
    other = other.unionByName(orders.where(k % 983 == 3).withColumn("o_orderkey", k + 100_000_000))
    kept, found = (keep(exports.leaves(x, "o_orderkey"), "leaves") for x in (orders, other))
    return exports.changed_ranges(kept, found)


@query("SELECT (SELECT count(*) FROM ev) AS event_count, (SELECT count(*) FROM items) AS item_count, (SELECT count(*) FROM ev WHERE split = 'train') AS train, (SELECT count(*) FROM ev WHERE split = 'validation') AS validation, (SELECT count(*) FROM ev WHERE split = 'ood_test') AS ood_test, TRUE AS passed")
def dataset_manifest(spark: SparkSession, d: str) -> DataFrame:
    m = exports.manifest(T.items(spark, d), T.events(spark, d).drop("fused"))
    n = lambda s: F.col("split_counts")[s].alias(s)
    return m.select("event_count", "item_count", *map(n, leakage.SPLITS), "passed")


@query(f"{GRADED} SELECT ranker, contrast, count(*) AS n, round(avg(difference), 9) + 0.0 AS mean_diff, round(stddev_samp(difference), 9) AS sd_diff, count(*) FILTER (WHERE difference > 1e-15) AS better, count(*) FILTER (WHERE abs(difference) <= 1e-15) AS tied, count(*) FILTER (WHERE difference < -1e-15) AS worse, list(latent_event_id ORDER BY latent_event_id) AS latent_event_ids, list(round(difference, 9) + 0.0 ORDER BY latent_event_id) AS differences FROM diff GROUP BY ALL")
def statistics_as_json(spark: SparkSession, d: str) -> DataFrame:
    """Paired statistics with each event's difference, written as JSON lines and read back."""
    path = new_folder(spark, "statistics")
    differences = E.paired(_graded_rr(spark, d)).withColumn("rounded", F.round("difference", 9) + F.lit(0.0))
    each = F.sort_array(F.collect_list(F.struct("latent_event_id", "rounded")))
    listed = differences.groupBy("ranker", "contrast").agg(F.transform(each, lambda x: x["latent_event_id"]).alias("latent_event_ids"), F.transform(each, lambda x: x["rounded"]).alias("differences"))
    table = E.contrasts(differences, 9).withColumn("mean_diff", F.col("mean_diff") + F.lit(0.0)).join(listed, ["ranker", "contrast"])
    exports.export_statistics(table, path)
    return spark.read.schema(table.schema).json(path)


@query(f"{DECIDE}, c AS ({EXPECTED}) SELECT request_id, outcome, rule_ids, explanation, expected AS expected_outcome, outcome = expected AS conforms FROM c JOIN dec USING (request_id, outcome)")
def decisions_as_json(spark: SparkSession, d: str) -> DataFrame:
    """The audit of decisions, written as JSON lines and read back."""
    path = new_folder(spark, "decisions")
    exports.export_decisions(policy_decisions(spark, d), expected_outcomes(spark, d), path)
    return spark.read.schema("request_id string, outcome string, rule_ids array<string>, explanation string, expected_outcome string, conforms boolean").json(path)


@query(f"SELECT ranker, query_id, list(item_id ORDER BY rank) AS ranking FROM {THREE} WHERE split = 'validation' GROUP BY ALL")
def rankings_as_parquet(spark: SparkSession, d: str) -> DataFrame:
    """Nested rankings, written in a folder for each ranker and read back."""
    path = new_folder(spark, "rankings")
    asked = T.queries_of(spark, d, "validation").select("query_id")
    exports.export_rankings(_three(spark, d).join(asked, "query_id", "left_semi"), path, ("ranker", "query_id"))
    return spark.read.parquet(path).select("ranker", "query_id", "ranking")
