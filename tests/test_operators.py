from __future__ import annotations

import datetime as dt

import pytest
from helpers import LONG, close, column, columns, make_panel, walk
from pyspark.sql import functions as F

from tidemark.functions import scalars as C
from tidemark.operators import alignment, evaluation, running, scaling, selection, summaries


@pytest.mark.parametrize("options", [{}, {"max_series_rows": 2, "segment_rows": 2}])
def test_running_sums(spark, options):
    panel = make_panel(spark, {"a": [None, 1.0, 2.0, None, 4.0], "b": [1.0, 2.0, 3.0, 4.0, 5.0]}, **options)
    panel = running.cum_sum(panel, {"strict": "x"})
    panel = running.cum_sum(panel, {"loose": "x"}, na="skip")
    assert column(panel, "strict") == [None] * 5
    assert column(panel, "loose") == [None, 1.0, 3.0, 3.0, 7.0]
    assert column(panel, "strict", "b") == column(panel, "loose", "b") == [1.0, 3.0, 6.0, 10.0, 15.0]


@pytest.mark.parametrize("options", [{}, LONG])
def test_minmax(spark, options):
    panel = make_panel(spark, {"a": [1.0, 3.0, 2.0, 5.0] * 3, "flat": [2.0] * 9}, **options)
    panel = selection.chrono_split(panel, {"train": 0.25})
    panel = scaling.minmax_scale(panel, {"all_rows": "x"})
    panel = scaling.minmax_scale(panel, {"train_rows": "x"}, fit_on=F.col("split") == "train")
    assert close(column(panel, "all_rows")[:4], [0.0, 0.5, 0.25, 1.0])
    assert close(column(panel, "train_rows")[:4], [0.0, 1.0, 0.5, 2.0])
    assert column(panel, "all_rows", "flat") == [None] * 9


@pytest.mark.parametrize("options", [{}, {"max_series_rows": 2, "segment_rows": 2}])
def test_splits_round_half_to_even(spark, options):
    panel = make_panel(spark, {"a": walk(5, 1), "b": walk(7, 2)}, **options)
    half = selection.chrono_split(panel, {"train": 0.5})
    assert column(half, "split").count("train") == 2 and column(half, "split", "b").count("train") == 4
    three = selection.chrono_split(panel, {"setup": 0.2, "train": 0.6})
    assert column(three, "split") == ["setup", "train", "train", "test", "test"]


def _scan_plan(spark, selection) -> str:
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("ts", "value")
    return selection.time_range(events, "ts", dt.datetime(2024, 1, 11))._jdf.queryExecution().executedPlan().toString()


def test_row_range_and_time_range(spark):
    panel = make_panel(spark, {"a": walk(6, 1), "b": walk(2, 2)})
    assert [r[0] for r in columns(selection.row_range(panel, 2, 4), "t")["a"]] == [1, 2, 3]
    assert selection.time_range(panel.df, "t", 3).count() == 3
    assert selection.time_range(panel.df, "t", 1, 1).count() == 2
    assert selection.time_range(panel.df, "t").count() == 8
    days = spark.range(10).select(F.expr("date'2020-01-01' + cast(id AS int)").alias("day"), F.expr("timestamp_ntz'2020-01-01 12:00:00' + make_dt_interval(cast(id AS int))").alias("at"))
    since = selection.time_range(days, "day", dt.date(2020, 1, 5), warmup=dt.timedelta(days=2))
    assert since.agg(F.min("day")).first()[0] == dt.date(2020, 1, 3)
    until = selection.time_range(days, "at", dt.datetime(2020, 1, 3, 12), dt.datetime(2020, 1, 4, 11, 59))
    assert [r["at"] for r in until.collect()] == [dt.datetime(2020, 1, 3, 12)]
    assert "PushedFilters: [IsNotNull" in _scan_plan(spark, selection)


def test_missing_values(spark):
    df = spark.createDataFrame([(1, 1.0), (2, float("nan")), (3, float("inf")), (4, float("-inf")), (5, None)], "k int, v double")
    clean = selection.normalise_missing(df, ["v"])
    assert [r["v"] for r in clean.orderBy("k").collect()] == [1.0, None, None, None, None]
    assert selection.complete_cases(df).count() == 3
    assert selection.drop_null(df, "v").count() == 4
    assert selection.any_null(df, ["k"]).first()[0] is False and selection.any_null(df, ["k", "v"]).first()[0] is True


def test_scalars(spark):
    row = spark.range(1).select(
        C.sigmoid(F.lit(-800.0)), C.sigmoid(F.lit(800.0)), C.round_even(F.lit(2.5)), C.safe_ln(F.lit(0.0)), C.safe_ln(F.lit(-1.0)),
        C.ratio(F.lit(1.0), F.lit(0.0)), C.hit_flag(F.lit(0.5), F.lit(1.0)), C.predicted_class(F.lit(0.5)), C.binary_flag(F.lit(0.0)),
        C.binary_flag(F.lit(None).cast("double")), C.bin_label(F.lit(20), 20), C.bin_index(F.lit(0.0), 20), C.bin_index(F.lit(0.05), 20),
        C.bin_index(F.lit(1.0), 20), C.indexed_name("w", F.lit(3)), C.cast_numeric(F.lit("x")),
    ).first()
    assert tuple(row) == (0.0, 1.0, 2.0, None, None, None, 1, 1, 0, None, "0.95 to 1.00", 1, 1, 20, "w3", None)


def test_merge_outer_matches_chained_joins_and_refuses_duplicates(spark):
    a = spark.createDataFrame([(1, 1.0), (2, 2.0)], "k int, a double")
    b = spark.createDataFrame([(2, 20.0), (3, None)], "k int, b double")
    c = spark.createDataFrame([(3, "x"), (4, "y")], "k int, c string")
    rows = sorted(tuple(r) for r in alignment.merge_outer([a, b, c], ["k"]).collect())
    assert rows == [(1, 1.0, None, None), (2, 2.0, 20.0, None), (3, None, None, "x"), (4, None, None, "y")]
    with pytest.raises(Exception, match="repeated index row"):
        alignment.merge_outer([a, b.union(b)], ["k"]).collect()


def test_calendar(spark):
    day = lambda d: dt.date(2020, 2, d)
    df = spark.createDataFrame([("a", day(27), 1.0), ("a", day(29), 2.0), ("b", day(1), 3.0)], "s string, day date, x double")
    rows = sorted(tuple(r) for r in alignment.calendar_densify(df, ["s"], "day").collect())
    assert rows == [("a", day(27), 1.0), ("a", day(28), None), ("a", day(29), 2.0), ("b", day(1), 3.0)]


def test_histograms_cover_every_value(spark):
    df = spark.createDataFrame([("a", float(v)) for v in range(11)] + [("b", 2.0)] * 3 + [("c", None)], "s string, v double")
    bins = {(r["s"], r["bin"]): r["n"] for r in summaries.histogram(df, "v", 5, ["s"]).collect()}
    assert [bins["a", i] for i in range(1, 6)] == [3, 2, 2, 2, 2]
    assert [bins["b", i] for i in range(1, 6)] == [3, 0, 0, 0, 0]
    whole = summaries.histogram(df.filter("s = 'a'"), "v", 5)
    assert [r["n"] for r in whole.orderBy("bin").collect()] == [3, 2, 2, 2, 2]
    assert sum(r["density"] * 2.0 for r in whole.collect()) == pytest.approx(1.0)


def scored(spark, rows):
    return spark.createDataFrame(rows, "p double, y double, r double")


def test_calibration_edges(spark):
    df = scored(spark, [(0.0, 0.0, 0.0), (0.05, 1.0, 0.0), (0.06, 1.0, 0.0), (0.07, 0.0, 0.0), (1.0, 1.0, 0.0)])
    right = {r["bin"]: (r["total"], r["occurences"], r["probability"]) for r in evaluation.calibration(df).collect()}
    assert len(right) == 20
    assert right[1] == (2, 1.0, 0.5) and right[2] == (2, 1.0, 0.5) and right[20] == (1, 1.0, 1.0) and right[3] == (0, 0.0, None)
    inside = evaluation.calibration(df, edges="open", drop_empty=True).collect()
    assert [(r["bin"], r["label"], r["total"], r["comparison"]) for r in inside] == [(2, "0.05 to 0.10", 2, 0.1)]


def test_regimes_partition_the_rows(spark):
    df = scored(spark, [(p / 100, 1.0, float(p)) for p in range(101)])
    regimes = {r["regime"]: r["n"] for r in evaluation.conditional_return(df, "p", "r", 0.8).collect()}
    assert sum(regimes.values()) == 101 and regimes["up"] == 20
    sure = evaluation.selective_accuracy(df, extreme=0.2).first()
    assert sure["bets"] == 40 and sure["total"] == 101
    assert evaluation.accuracy_tstat(scored(spark, [(0.9, 1.0, 0.0)] * 3)).first()["t_stat"] is None


def test_jarque_bera_of_a_symmetric_sample(spark):
    df = spark.createDataFrame([(float(v),) for v in (-1, 0, 0, 1)], "v double")
    row = summaries.jarque_bera(df, "v").first()
    assert row["statistic"] == pytest.approx(4 / 6 * (2 - 3) ** 2 / 4)
