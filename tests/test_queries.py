"""Registered queries against DuckDB on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from tools.parity import compare, connect

SMALL = "/root/testdata/sf0.001"
NAMES = ("weighted_ratio_score", "feed_verdict_variants", "percentile_tier_table", "score_quantiles", "zone_profile", "verdict_layer_report",
         "budget_yield_curve", "fit_baseline_curve", "formula_grid", "lorenz_gini_zipf", "latest_snapshot_merge", "review_batch", "greedy_diverse_picks",
         "layer_novelty", "pool_merge", "frontier_three_hops", "normalize_item", "catalog_fingerprint", "naive_bayes_predict", "title_number_flag", "stream_feed_verdict",
         "backfill_incomplete", "new_item_antijoin", "caliper_candidates", "caliper_matching", "daily_new_items", "verdict_cache_ttl", "reference_overlap",
         "neighbourhood_vs_band_percentile", "two_level_chain", "user_flow_strength", "backfill_targets", "catalog_build", "noise_interval_check", "paired_effect",
         "matched_audit_report", "pooled_hop_summary", "published_pages", "capture_files_until", "topic_name_flag")


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() == 5


@pytest.mark.parametrize("name", NAMES)
def test_matches_duckdb(spark, con, name):
    df = entry.queries()[name](spark, SMALL)
    assert compare(df.collect(), df.columns, con.sql(entry.oracle_sql()[name])) is None
