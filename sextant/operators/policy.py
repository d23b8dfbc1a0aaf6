"""Rule gate for output requests: the first rule that matches decides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sextant.functions import scalars as S

LIMITS = "item_id string, enabled boolean, max_concentration double, max_duration double, min_volume double, min_ventilation double"
# Rule ids of the decision table, in order of precedence.
RULES = (
    ("missing_information", "RULE-MISSING-001", "REQUIRE_MISSING_INFORMATION"),
    ("consent", "RULE-CONSENT-001", "BLOCK"),
    ("unknown_item", "RULE-ITEM-001", "BLOCK"),
    ("disabled_item", "RULE-ITEM-002", "BLOCK"),
    ("concentration", "RULE-LIMIT-001", "BLOCK"),
    ("duration", "RULE-LIMIT-002", "BLOCK"),
    ("volume", "RULE-ENV-001", "BLOCK"),
    ("ventilation", "RULE-ENV-002", "BLOCK"),
    ("allow", "RULE-ALLOW-001", "ALLOW"),
)
REQUIRED = ("concentration_ppm", "duration_seconds", "environment_volume_m3", "ventilation_ach", "user_consent")


def limits_table(spark: SparkSession, limits: list[tuple]) -> DataFrame:
    """Item limits as a table; equal ids are an error."""
    if len({x[0] for x in limits}) < len(limits):
        raise ValueError("an item has several limits")
    return spark.createDataFrame(limits, LIMITS)


def missing_fields() -> Column:
    return S.missing_names({c: F.col(c) for c in REQUIRED})


def _rule() -> Column:
    """Name of the first rule that matches a request joined with its limits; equal to a limit passes."""
    missing = F.lit(False)
    for c in REQUIRED:
        missing = missing | F.col(c).isNull()
    return (
        F.when(missing, "missing_information").when(~F.col("user_consent"), "consent").when(F.col("enabled").isNull(), "unknown_item").when(~F.col("enabled"), "disabled_item")
        .when(F.col("concentration_ppm") > F.col("max_concentration"), "concentration").when(F.col("duration_seconds") > F.col("max_duration"), "duration")
        .when(F.col("environment_volume_m3") < F.col("min_volume"), "volume").when(F.col("ventilation_ach") < F.col("min_ventilation"), "ventilation").otherwise("allow")
    )


def decide(requests: DataFrame, limits: DataFrame, protocol_hash: str = "") -> DataFrame:
    """(request_id, outcome, rule_ids, explanation, protocol_hash) of each request.

    The same expression serves batch tables and streams (a stream joins the static limits). Spark
    broadcasts the limits where they are small.
    """
    joined = requests.join(limits, "item_id", "left").withColumn("rule", _rule())
    pick = lambda k: F.element_at(F.create_map(*(F.lit(x) for r in RULES for x in (r[0], r[k]))), F.col("rule"))
    why = F.when(F.col("rule") == "missing_information", F.concat(F.lit("missing: "), missing_fields())).otherwise(F.concat(F.lit("rule: "), F.col("rule")))
    return joined.select("request_id", pick(2).alias("outcome"), F.array(pick(1)).alias("rule_ids"), why.alias("explanation"), F.lit(protocol_hash).alias("protocol_hash"))


def conformance(decisions: DataFrame, cases: DataFrame) -> DataFrame:
    """One row of conformance metrics against (request_id, expected_outcome).

    False allows count against all cases, false blocks against the cases that expect ALLOW.
    """
    j = cases.select("request_id", "expected_outcome").join(decisions.select("request_id", "outcome"), "request_id", "left")
    false_allow = (F.col("outcome") == "ALLOW") & (F.col("expected_outcome") != "ALLOW")
    false_block = (F.col("outcome") == "BLOCK") & (F.col("expected_outcome") == "ALLOW")
    counted = j.agg(
        F.count("*").alias("cases"), F.count_if(F.col("outcome") == F.col("expected_outcome")).alias("exact"), F.count_if(false_allow).alias("false_allows"), F.count_if(false_block).alias("false_blocks"),
        F.count_if(F.col("outcome").isNotNull()).alias("decided"), F.count_if(F.col("expected_outcome") == "ALLOW").alias("expected_allows"),
    )
    rate = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0))
    return counted.select(
        "cases", "exact", "false_allows", "false_blocks", rate("exact", "cases").alias("conformance_rate"), rate("false_allows", "cases").alias("false_allow_rate"), rate("false_blocks", "expected_allows").alias("false_block_rate"),
        rate("decided", "cases").alias("coverage"), ((F.col("exact") == F.col("cases")) & (F.col("false_allows") == 0)).alias("passed"),
    )
