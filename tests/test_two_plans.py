"""Both plans of every ordered operator: same rows, same columns, with NULL keys, a column ``rn``, filters and second splits."""

from __future__ import annotations

import math

import pytest
from helpers import walk
from pyspark.sql import functions as F

from tidemark.functions import rolling as R
from tidemark.operators import running, scaling, selection, smoothing, summaries
from tidemark.panel import Panel
from tidemark.plans import evaluate, features

LONG = {"max_series_rows": 20, "segment_rows": 25}
MACRO = {"change_gold": "m"}


@pytest.fixture(scope="module")
def table(spark):
    rows = [(s, t, (t * 7) % 3, v, abs(v) + 1, 1000 - t) for s, seed in (("a", 1), (None, 2), ("c", 3)) for t, v in enumerate(walk(60, seed))]
    rows += [("gap", t, 0, None if t in (3, 40) else float(t), 1.0 + t % 5, t) for t in range(60)]
    return spark.createDataFrame(rows, "s string, t int, tie int, x double, m double, rn int").repartition(5).cache()


def resplit(panel):
    first = selection.chrono_split(panel, {"train": 0.5}, name="first")
    kept = first.replace(first.df.filter("first = 'train'"), same_rows=False)
    return selection.chrono_split(kept, {"train": 0.3}, name="second")


def smoothed_after_filter(panel):
    split = selection.chrono_split(panel, {"train": 0.5})
    return smoothing.ema_n(split.replace(split.df.filter("split = 'test'"), same_rows=False), "e", "x", 5)


def scored(panel):
    rows = panel.df.withColumns({"p": F.abs(F.sin("t")), "y": (F.col("t") % 2).cast("double")})
    return evaluate.error_series(panel.replace(rows)).roll({"before": R.lag_k("cum_d")})


CASES = {
    "roll": lambda p: p.roll({"sma": R.sma_n("x", 5), "up": R.label_next_up("x"), "rn_before": R.lag_k("rn"), "cci": R.cci_n("x"), "sig": R.sma_signal("x")}),
    "cum_sum": lambda p: running.cum_sum(p, {"c": "x", "r": "rn"}),
    "cum_sum_skip": lambda p: running.cum_sum(p, {"c": "x"}, na="skip"),
    "ema": lambda p: smoothing.smooth(p, {"e": smoothing.Smoothing("x", 5), "w": smoothing.Smoothing("rn", 4, "wilder")}, span=16),
    "momentum": lambda p: smoothing.momentum_indicators(p, "x", rsi="rsi", macd="macd", signal="line"),
    "minmax": lambda p: scaling.minmax_scale(p, {"z": "x"}),
    "params": lambda p: scaling.broadcast_params(p, {"lo": F.min("x")}),
    "split": lambda p: selection.chrono_split(p, {"setup": 0.1, "train": 0.4}),
    "resplit": resplit,
    "smoothed_after_filter": smoothed_after_filter,
    "row_range": lambda p: p.replace(selection.row_range(p, 3, 9), same_rows=False),
    "technical": lambda p: features.technical_features(p, "x"),
    "macro": lambda p: features.macro_features(p, MACRO),
    "design": lambda p: features.design_table(p, "x", MACRO),
    "errors_then_roll": scored,
}


def same(a, b):
    if a is None or b is None or not isinstance(a, float):
        return a == b
    return math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)


@pytest.mark.parametrize("name", sorted(CASES))
def test_same_rows_and_columns(table, name):
    short, long = (CASES[name](Panel(table, "s", "t", "tie", **options)).df for options in ({}, LONG))
    assert short.columns == long.columns and not any(c.startswith("_") for c in short.columns)

    def sort(df):
        return sorted(df.collect(), key=lambda r: (r["s"] or "", r["t"]))

    one, other = sort(short), sort(long)
    assert len(one) == len(other) > 0
    for a, b in zip(one, other, strict=True):
        assert all(same(x, y) for x, y in zip(a, b, strict=True)), (a, b)
    if name in ("roll", "minmax", "split", "ema", "cum_sum"):
        assert len(one) == 240 and [r["rn"] for r in one if r["s"] == "a"] == [1000 - t for t in range(60)]


@pytest.mark.parametrize("limit", ["broadcast", "frames", "slices"])
@pytest.mark.parametrize("name", ["roll", "cum_sum", "ema", "minmax", "split"])
def test_other_limits_change_no_row(table, monkeypatch, name, limit):
    """Shuffle joins for broadcasts, a join for window frames, and short slices, on NULL keys and gaps."""
    def rows():
        df = CASES[name](Panel(table, "s", "t", "tie", **({} if limit == "frames" else LONG))).df
        return df.columns, sorted(df.collect(), key=lambda r: (r["s"] or "", r["t"]))

    columns, before = rows()
    if limit == "broadcast":
        monkeypatch.setattr("tidemark.panel.BROADCAST_SERIES", 0)
    elif limit == "frames":
        monkeypatch.setattr("tidemark.operators.smoothing.MAX_FRAMES", 0)
    else:
        monkeypatch.setattr("tidemark.panel.SLICE_ROWS", 10)
    again, after = rows()
    assert again == columns and len(after) == len(before) == 240
    for a, b in zip(before, after, strict=True):
        assert all(same(x, y) for x, y in zip(a, b, strict=True)), (a, b)


def test_as_series_numbers(table):
    for options in ({}, LONG):
        rows = selection.as_series(Panel(table, "s", "t", "tie", **options), ["x"]).collect()
        assert len(rows) == 240 and all(r["rn"] == r["t"] + 1 for r in rows)


def test_histogram_keeps_every_value(spark):
    import random

    rng = random.Random(4)
    groups = [(i if i else None, v) for i in range(60) for a in [rng.random() * 10 ** rng.randint(-3, 3)] for v in [0.0, a / 2, a, a * rng.random(), None]]
    groups += [(99, v) for v in (0.0, 1.6527635528529094 / 2, 1.6527635528529094)]
    df = spark.createDataFrame(groups, "g int, v double")
    for bins in (5, 8, 20, 50, 100):
        rows = summaries.histogram(df, "v", bins, ["g"]).collect()
        for g in {g for g, _ in groups}:
            mine = [r for r in rows if r["g"] == g]
            assert len(mine) == bins and sum(r["n"] for r in mine) == sum(1 for k, v in groups if k == g and v is not None)
            assert math.isclose(sum(r["density"] * (r["bin_high"] - r["bin_low"]) for r in mine), 1, rel_tol=1e-9)
    alone = summaries.histogram(df.filter("g = 99"), "v", 20).collect()
    assert sum(r["n"] for r in alone) == 3 and alone[-1]["n"] == 1


def test_labels_of_many_bins_differ(spark):
    from tidemark.functions.scalars import bin_label

    for bins in (20, 100, 250, 1000):
        labels = spark.range(1, bins + 1).select(bin_label("id", bins).alias("l")).distinct().count()
        assert labels == bins
