from __future__ import annotations

import pytest
from helpers import LONG, close, column, make_panel, serial_average, walk
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.operators import smoothing as S
from tidemark.operators.smoothing import Smoothing

CASES = {
    "a": walk(120, 1),
    "lead": [None, None, *walk(40, 2)],
    "gap": [*walk(20, 3), None, *walk(20, 4)],
    "short": walk(4, 5),
    "exact": walk(5, 6),
    "none": [None] * 8,
    "early_gap": [1.0, None, *walk(20, 7)],
}


@pytest.mark.parametrize("options,span", [({}, None), ({}, 16), (LONG, None), (LONG, 16)])
def test_average_equals_the_loop(spark, options, span):
    panel = S.smooth(make_panel(spark, CASES, **options), {"ema": Smoothing("x", 5), "wilder": Smoothing("x", 5, "wilder")}, span)
    for name, values in CASES.items():
        assert close(column(panel, "ema", name), serial_average(values, 5, 2 / 6)), name
        assert close(column(panel, "wilder", name), serial_average(values, 5, 1 / 5)), name


def test_several_default_spans(spark):
    """Window frames carry the level from span to span; nothing is joined."""
    values = walk(9000, 21)
    panel = S.smooth(make_panel(spark, {"a": values, "b": values[:100]}), {"ema": Smoothing("x", 9), "slow": Smoothing("x", 26)})
    assert close(column(panel, "ema"), serial_average(values, 9, 0.2))
    assert close(column(panel, "slow"), serial_average(values, 26, 2 / 27))
    assert close(column(panel, "ema", "b"), serial_average(values[:100], 9, 0.2))
    plan = panel.df._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange") == 1


def test_long_memory_survives_many_spans(spark):
    """After a burst the input is zero: only what is handed from span to span is left."""
    values = [1e6] * 5 + [0.0] * 1500
    panel = S.ema_n(make_panel(spark, {"a": values}), "ema", "x", 5, span=100)
    expected = serial_average(values, 5, 2 / 6)
    got = column(panel, "ema")
    for i in (5, 99, 100, 101, 500, 999, 1400):
        assert got[i] == pytest.approx(expected[i], rel=1e-9, abs=1e-320)


def test_window_of_one_is_the_input(spark):
    panel = S.ema_n(make_panel(spark, {"a": [1.0, 2.0, 4.0]}), "ema", "x", 1)
    assert column(panel, "ema") == [1.0, 2.0, 4.0]


@pytest.mark.parametrize("options", [{}, LONG])
def test_rsi(spark, options):
    series = {"up": [float(i) for i in range(1, 25)], "flat": [2.0] * 24, "a": walk(60, 9), "down": [float(-i) for i in range(24)]}
    panel = S.rsi_n(make_panel(spark, series, **options), "rsi", "x", 15)
    assert close(column(panel, "rsi", "up"), [None] * 15 + [100.0] * 9)
    assert close(column(panel, "rsi", "down"), [None] * 15 + [0.0] * 9)
    assert column(panel, "rsi", "flat") == [None] * 24
    moves = [None, *(b - a for a, b in zip(series["a"], series["a"][1:]))]
    gain = serial_average([None if m is None else max(m, 0.0) for m in moves], 15, 1 / 15)
    loss = serial_average([None if m is None else max(-m, 0.0) for m in moves], 15, 1 / 15)
    assert close(column(panel, "rsi"), [None if g is None else 100 * g / (g + l) for g, l in zip(gain, loss)])


@pytest.mark.parametrize("options", [{}, LONG])
def test_macd_and_signal_line(spark, options):
    values = walk(80, 11)
    panel = S.momentum_indicators(make_panel(spark, {"a": values, "b": walk(30, 12)}, **options), "x", macd="m", signal="line")
    fast, slow = serial_average(values, 12, 2 / 13), serial_average(values, 26, 2 / 27)
    macd = [None if s is None else 100 * (f / s - 1) for f, s in zip(fast, slow)]
    assert close(column(panel, "m"), macd)
    assert close(column(panel, "line"), serial_average(macd, 9, 0.2))
    assert column(panel, "m").index(next(v for v in column(panel, "m") if v is not None)) == 25
    assert sum(v is None for v in column(panel, "line")) == 33


@settings(max_examples=8, deadline=None)
@given(st.lists(st.one_of(st.none(), st.floats(-1e6, 1e6, allow_nan=False)), min_size=1, max_size=30), st.integers(2, 6))
def test_average_of_anything(spark, values, n):
    panel = S.ema_n(make_panel(spark, {"a": values}), "ema", "x", n, span=7)
    assert close(column(panel, "ema"), serial_average(values, n, 2 / (n + 1)), 1e-7)
