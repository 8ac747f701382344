from __future__ import annotations

import pytest
from helpers import LONG, close, column, columns, make_panel, walk

from tidemark.functions import rolling as R
from tidemark.panel import ROW_NUMBER, SERIES_ROWS


@pytest.mark.parametrize("options", [{}, {"max_series_rows": 2, "segment_rows": 3}])
def test_means_need_a_full_gap_free_window(spark, options):
    panel = make_panel(spark, {"a": [1.0, 2.0, 3.0, None, 5.0, 6.0, 7.0], "b": [4.0], "c": [1.0, 3.0]}, **options)
    panel = panel.roll({"sma": R.sma_n("x", 3), "wma": R.wma_n("x", 3)})
    assert column(panel, "sma") == [None, None, 2.0, None, None, None, 6.0]
    assert close(column(panel, "wma"), [None, None, 14 / 6, None, None, None, 38 / 6])
    assert column(panel, "sma", "b") == [None] and column(panel, "sma", "c") == [None, None]


def test_average_of_a_constant_is_the_constant(spark):
    panel = make_panel(spark, {"a": [3.36] * 20}).roll(
        {"wma": R.wma_n("x", 10), "ret": R.log_return(R.wma_n("x", 10)), "cci": R.cci_n("x", 15), "signal": R.sma_signal("x")}
    )
    assert close(column(panel, "wma"), [None] * 9 + [3.36] * 11)
    assert close(column(panel, "ret"), [None] * 10 + [0.0] * 10)
    assert column(panel, "cci") == [None] * 20
    assert column(panel, "signal") == [None] * 9 + [0] * 11


def test_label_looks_at_the_next_row(spark):
    panel = make_panel(spark, {"a": [1.0, 2.0, 2.0, 1.0, None, 3.0, 4.0], "b": [5.0]})
    panel = panel.roll({"up": R.label_next_up("x"), "next": R.forward_change("x")})
    assert column(panel, "up") == [1.0, 0.0, 0.0, None, None, 1.0, None]
    assert column(panel, "up", "b") == [None]
    assert close(column(panel, "next"), [1.0, 0.0, -0.5, None, None, 1 / 3, None])


def test_changes_avoid_zero_and_negative(spark):
    panel = make_panel(spark, {"a": [1.0, 0.0, 2.0, -1.0, 4.0]})
    panel = panel.roll({"pct": R.pct_change("x"), "ret": R.log_return("x"), "d": R.diff_1("x"), "lag2": R.lag_k("x", 2)})
    assert column(panel, "pct") == [None, -1.0, None, -1.5, -5.0]
    assert column(panel, "ret") == [None] * 5
    assert column(panel, "d") == [None, -1.0, 2.0, -3.0, 5.0]
    assert column(panel, "lag2") == [None, None, 1.0, 0.0, 2.0]


def test_cci_by_hand(spark):
    values = walk(40, 1)
    panel = make_panel(spark, {"a": values}).roll({"cci": R.cci_n("x", 15)})
    expected: list[float | None] = [None] * 14
    for i in range(14, 40):
        window = values[i - 14 : i + 1]
        mean = sum(window) / 15
        expected.append((values[i] - mean) / (0.015 * sum(abs(v - mean) for v in window) / 15))
    assert close(column(panel, "cci"), expected)


def test_tie_breaker_orders_equal_times(spark):
    from tidemark.panel import Panel

    df = spark.createDataFrame([("a", 0, 2, 20.0), ("a", 0, 1, 10.0), ("a", 0, 3, 30.0)], "s string, t int, tie int, x double")
    rows = Panel(df, "s", "t", "tie").roll({"before": R.lag_k("x")}).df.orderBy("tie").collect()
    assert [r["before"] for r in rows] == [None, 10.0, 20.0]


def test_slices_give_what_whole_series_give(spark):
    series = {"a": walk(57, 1), "b": walk(5, 2), "c": walk(1, 3), "d": walk(20, 4)}
    indicators = {
        "sma": R.sma_n("x", 5), "wma": R.wma_n("x", 10), "ret": R.log_return(R.sma_n("x", 10)), "cci": R.cci_n("x"),
        "up": R.label_next_up("x"), "spread": R.sma_spread("x"),
    }
    whole = columns(make_panel(spark, series).roll(indicators), *indicators)
    sliced = columns(make_panel(spark, series, **LONG).roll(indicators), *indicators)
    for s in series:
        for name, (a, b) in enumerate(zip(zip(*whole[s]), zip(*sliced[s]))):
            assert close(list(a), list(b)), (s, name)


def test_numbering_of_long_series(spark):
    series = {"a": walk(57, 1), "b": walk(5, 2), "c": walk(1, 3)}
    whole = columns(make_panel(spark, series).numbered().rows, ROW_NUMBER, SERIES_ROWS)
    sliced = columns(make_panel(spark, series, **LONG).numbered().rows, ROW_NUMBER, SERIES_ROWS)
    assert whole == sliced
    assert whole["b"] == [(i, 5) for i in range(1, 6)]


@pytest.mark.parametrize("options", [{}, LONG])
def test_signal_at_any_scale(spark, options):
    panel = make_panel(spark, {"a": [1e-10 * (i + 1) for i in range(60)], "b": [0.1] * 30}, **options).roll({"sig": R.sma_signal("x")})
    got = columns(panel, "sig")
    assert [v for v, in got["a"]] == [None] * 9 + [1] * 51 and [v for v, in got["b"]] == [None] * 9 + [0] * 21
