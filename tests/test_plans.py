"""Plans that must hold at scale."""

import pytest

from foretrace.plans import catalogue

FOLDER = "/root/testdata/sf0.001"
LAZY = (
    "flagship scan_project scan_filter_union pa_filter event_flags mode_opponent opponent_rollup primary_pick mix_counts mix_share bucket_prefix "
    "dim_lookup dim_join join_audit semi_join anti_join nearest_hour recent_games slate_expand outer_combine dedup_last slate_percentile "
    "topk_per_group rerank upsert_history upsert_replace recover_pending settle archive_dates name_cascade unique_key_check identity_audit "
    "coverage_audit chrono_split expanding_folds fold_missingness rolling_holdouts threshold_sweep top_lift score_deciles ranked_output tier_policy"
).split()


def plan(spark, name):
    return catalogue.QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", LAZY)
def test_no_cross_products_and_no_python(spark, name):
    text = plan(spark, name)
    for bad in ("CartesianProduct", "NestedLoopJoin", "Python", "InPandas"):
        assert bad not in text


def test_filters_and_columns_reach_the_scan(spark):
    text = plan(spark, "scan_filter_union")
    assert "GreaterThanOrEqual(value,95.0)" in text and "EqualTo(event_type,purchase)" in text
    assert "props" not in text
    text = plan(spark, "flagship")
    assert "value" not in text.split("ReadSchema")[1].split("\n")[0]


@pytest.mark.parametrize("name", ["dedup_last", "topk_per_group", "mode_opponent"])
def test_top_rows_are_limited_before_the_shuffle(spark, name):
    text = plan(spark, name)
    assert "WindowGroupLimit" in text and "Partial" in text


def test_windows_over_everything_see_bounded_tables_only(spark):
    """A window without partition keys may only follow an aggregate (days, blocks, thresholds)."""
    for name in ("slate_percentile", "expanding_folds", "chrono_split", "rolling_holdouts", "threshold_sweep"):
        lines = plan(spark, name).split("\n")
        for i, line in enumerate(lines):
            if "Exchange SinglePartition" in line:
                below = "\n".join(lines[i + 1 : i + 6])
                assert "Aggregate" in below or "Range" in below or "Project" in below or "Join" in below, (name, below)


@pytest.mark.parametrize("name", ["entity_game_rollup", "opponent_rollup", "canonical_record", "tier_summary"])
def test_rollups_combine_by_hashing(spark, name):
    text = plan(spark, name)
    assert "HashAggregate" in text and "SortAggregate" not in text
