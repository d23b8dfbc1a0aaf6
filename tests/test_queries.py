"""Every registered query runs, and those with SQL equal DuckDB on the smallest tables."""

import hashlib
import math
import os
from decimal import Decimal

import duckdb
import pytest

from sextant.plans import catalog
from sextant.sources import tables

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables aren't there")
#: A part of the queries, one of each kind; the driver compares all of them.
CHOSEN = "mean_fusion_validation_metrics hybrid_ranking memory_ranking ridge_gram random_ranking correction_history policy_conformance memory_as_of leakage_report paired_contrasts bootstrap_means distribution_shift table_fingerprint split_manifest_as_csv metrics_with_gaps ridge_metrics judged_corrections corrective_summary corrective_others ablation_mrr mmd_permutation_test bootstrap_poisson_intervals statistics_as_json correction_stream fitted_ablation_mrr table_hash_tree tampered_ranges corrective_targets decoys leakage_summary leakage_pages feature_fingerprints metrics_of_one_cell".split()


def plain(v):
    if isinstance(v, Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.8g}")
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", CHOSEN)
def test_equals_sql(spark, name):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    frame = catalog.QUERIES[name](spark, DATA)
    found = db.execute(catalog.SQL[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(frame.columns)
    want = sorted((tuple(plain(r[columns.index(c)]) for c in sorted(columns)) for r in found.fetchall()), key=repr)
    got = sorted((tuple(plain(r[c]) for c in sorted(columns)) for r in frame.collect()), key=repr)
    assert got == want


def test_names():
    assert set(catalog.SQL) <= set(catalog.QUERIES)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 1 and set(catalog.QUERIES) <= set(__spark_entry__.queries())


def test_random_nested_rankings_order_the_whole_library(spark):
    test_equals_sql(spark, "nested_rankings")
    items = [r.item_id for r in tables.items(spark, DATA).select("item_id").collect()]
    rows = catalog.QUERIES["nested_rankings"](spark, DATA).where("ranker = 'random'").collect()
    assert rows and all(r.ranking == sorted(items, key=lambda x: hashlib.sha256(f"2026:{r.query_id}:{x}".encode()).digest())[:10] for r in rows)
