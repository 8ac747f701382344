"""Every registered query against its SQL, and the driver contract."""

from __future__ import annotations

import pytest
from compare import connect, differences, spark_rows, sql_rows

import __spark_entry__ as entry_point
from tidemark.registry import QUERIES, SQL

# The operator inventory: every key must be registered.
INVENTORY = """
scan_series blank_to_null dot_to_null parse_day as_series save_model
select_cols row_range time_range drop_null finite_or_null complete_cases rename_cols add_intercept scale_const cast_numeric
threshold_filter extreme_filter binary_flag any_null series_bounds
merge_outer align_inner merge_predictions merge_self_lag calendar_densify broadcast_params weights_apply
agg_minmax agg_mean_sd agg_sse hit_rate jarque_bera histogram_density histogram_counts normal_overlay calibration calibration_ref
conditional_return selective_accuracy hits_by_year accuracy_tstat
lag_k diff_1 pct_change log_return roc_n sma_n wma_n label_next_up cum_sum cum_abs_error sma_spread sma_signal ema_n wilder_n rsi_n
macd macd_signal cci_n minmax_scale
time_order chrono_split three_way_split best_trial append_curves
sigmoid sigmoid_grad log_exp_abs_pow round_even is_null_finite bin_label hit_flag predicted_class residual squared_error seq_dates
indexed_name
plr_fit plr_modes mlp_fit batch_gradient mlp_score plr_score restart_search param_grid staged_fit random_init epoch_curve weight_trace
weights_unchanged rescoring_check learning_scores principal_component mlp_score_30 score_by_key_30
technical_features macro_features design_table train_test_eval train_test_weights train_test_curve evaluation_report
read_series histogram_density_100 histogram_counts_20
""".split()
# No day of the smallest tables has orders of all five priorities.
EMPTY_IN_THE_SMALLEST = {"complete_cases"}


def test_inventory_is_complete():
    assert set(INVENTORY) <= set(QUERIES) <= set(entry_point.queries())
    assert set(QUERIES) == set(SQL) and all(entry_point.oracle_sql()[n] == SQL[n] for n in SQL)


def test_flagship(spark):
    rows = {r["signal"]: (r["n"], r["share_up"]) for r in entry_point.entry(spark).collect()}
    assert set(rows) == {0, 1} and all(0 <= share <= 1 for _, share in rows.values())


@pytest.fixture(scope="module")
def database(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, sf, database, name):
    actual = spark_rows(entry_point.queries()[name](spark, sf))
    expected = sql_rows(database, entry_point.oracle_sql()[name])
    assert not differences(expected, actual)
    assert expected[1] or name in EMPTY_IN_THE_SMALLEST
