from __future__ import annotations

import datetime as dt
import re

import pytest
from helpers import LONG, close, columns, make_panel, walk
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.models.scoring import score
from tidemark.plans import evaluate, features
from tidemark.sources import series_csv as src
from tidemark.streaming.scoring import score_files

MACRO = {name: f"m{i}" for i, name in enumerate(features.MACRO)}


def macro_panel(spark, series, **options):
    panel = make_panel(spark, series, **options)
    return panel.with_columns({c: F.col("x") + F.pmod(F.col("t") * (i + 3), F.lit(7 + i)) + 1 for i, c in enumerate(MACRO.values())})


def executed(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_design_table_keeps_all_but_26_rows(spark):
    panel = macro_panel(spark, {"a": walk(60, 1), "b": walk(27, 2), "c": walk(26, 3)})
    design = features.design_table(panel, "x", MACRO).df
    assert design.columns == ["s", "t", "tie", *features.FEATURES, features.LABEL]
    counts = {r["s"]: r["count"] for r in design.groupBy("s").count().collect()}
    # Scaling divides by a range: with a single value of MACD there is none.
    assert counts["a"] == 60 - 26 and "c" not in counts
    bounds = design.agg(*(F.min(c).alias(f"lo{c}") for c in features.FEATURES), *(F.max(c).alias(f"hi{c}") for c in features.FEATURES)).first()
    assert min(bounds) >= 0 and max(bounds) <= 1


def test_design_table_in_slices(spark):
    series = {"a": walk(60, 1), "b": walk(33, 2)}
    names = [*features.FEATURES, features.LABEL]
    whole = columns(features.design_table(macro_panel(spark, series), "x", MACRO), *names)
    sliced = columns(features.design_table(macro_panel(spark, series, **LONG), "x", MACRO), *names)
    for s in series:
        assert len(whole[s]) == len(sliced[s])
        for a, b in zip(whole[s], sliced[s]):
            assert close(list(a), list(b))


def test_design_table_shuffles_and_sorts_once(spark):
    panel = macro_panel(spark, {"a": walk(60, 1), "b": walk(33, 2)})
    plan = executed(features.design_table(panel, "x", MACRO).df)
    assert len(re.findall(r"Exchange hashpartitioning", plan)) == 1
    assert len(re.findall(r"\+- Sort ", plan)) == 1
    assert "SinglePartition" not in plan and "Python" not in plan and "Pandas" not in plan


def test_filter_on_series_reaches_the_scan(spark, sf):
    from tidemark.functions.rolling import sma_n
    from tidemark.registry.inputs import panel_events

    df = panel_events(spark, sf).roll({"m": sma_n("x", 5)}).df.filter("user_id = 3").select("event_id", "m")
    plan = executed(df)
    assert "EqualTo(user_id,3)" in plan
    assert "event_type" not in plan and "props" not in plan


def test_a_third_of_all_rows_in_one_series(spark):
    """The rows of a long series are split over tasks, whatever its share."""
    from tidemark.functions.rolling import sma_n

    series = {"hot": walk(3000, 1), **{f"s{i:03}": walk(30, i) for i in range(200)}}
    hot = make_panel(spark, series, max_series_rows=100, segment_rows=200)
    assert hot.is_long
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sliced = hot.roll({"m": sma_n("x", 10)}).df
        by_task = sliced.groupBy(F.spark_partition_id()).agg(F.count_if(F.col("s") == "hot").alias("n")).collect()
        assert max(r["n"] for r in by_task) < 1500
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    whole = make_panel(spark, series).roll({"m": sma_n("x", 10)})
    assert columns(sliced, "m") == columns(whole, "m")


def test_train_score_report(spark):
    panel = macro_panel(spark, {"a": walk(120, 1), "b": walk(90, 2)})
    panel = evaluate.with_returns(panel, "x")
    prices = panel.df.select("s", "t", "change")
    design = features.design_table(panel, "x", MACRO)
    scored, weights, curve = evaluate.train_test_eval(
        design, features.FEATURES, features.LABEL, trials=3, neurons=2, search_epochs=2,
        stages=({"epochs": 3, "momentum": 0.7}, {"epochs": 2, "momentum": 0.0}),
    )
    assert weights.count() == 2 * (14 * 2 + 3)
    # Two epochs of the search winner, then the stages.
    assert {(r["s"], r["step"], r["stage"]) for r in curve.collect()} == {
        (s, i, 1 if i < 3 else 2 if i < 6 else 3) for s in "ab" for i in range(1, 8)}
    rows = scored.df.join(prices, ["s", "t"])
    report = evaluate.evaluation_report(scored.replace(rows))
    n = report.rows.count()
    assert n == (94 - 28) + (64 - 19)
    assert report.calibration.agg(F.sum("total")).first()[0] == n
    assert report.conditional_returns.agg(F.sum("n")).first()[0] == n
    for part in (report.residuals, report.absolute_residuals, report.squared_errors, report.scores, report.returns, report.returns_by_regime):
        assert part.agg(F.sum("n")).first()[0] == n
    assert report.hits_by_year is None and report.summary.first()["n"] == n


def test_read_files(spark, tmp_path):
    (tmp_path / "gaps.csv").write_text("DATE,INDEX\n2013-01-02,99.5\n2013-01-03,.\n2013-01-07,100.25\n")
    df = src.read_series(spark, f"{tmp_path}/gaps.csv", "DATE date, INDEX double", null_value=".")
    assert [tuple(r) for r in df.orderBy("DATE").collect()] == [
        (dt.date(2013, 1, 2), 99.5), (dt.date(2013, 1, 3), None), (dt.date(2013, 1, 7), 100.25)
    ]
    (tmp_path / "wide.csv").write_text('Time;P;Note\n31.12.10;1.5;"  "\n03.01.2011;;ok\n')
    wide = src.read_series(spark, f"{tmp_path}/wide.csv", "Time string, P double, Note string", sep=";")
    rows = wide.select(src.parse_day("Time").alias("day"), "P", "Note").orderBy("day").collect()
    assert [tuple(r) for r in rows] == [(dt.date(2010, 12, 31), 1.5, None), (dt.date(2011, 1, 3), None, "ok")]


@pytest.mark.parametrize("text,day", [
    ("31.12.10", dt.date(2010, 12, 31)), ("01.02.68", dt.date(2068, 2, 1)), ("01.02.69", dt.date(1969, 2, 1)),
    ("1.2.2003", dt.date(2003, 2, 1)), ("31.02.2003", None), ("2003-01-01", None), ("", None), (None, None),
])
def test_days(spark, text, day):
    df = spark.createDataFrame([(text,)], "d string")
    assert df.select(src.parse_day("d")).first()[0] == day


def test_scoring_a_stream(spark, tmp_path):
    net = {("output", 0, 0): 0.5, ("output", 1, 0): -1.0}
    schema = T.StructType().add("k", "long").add("x_0", "double").add("x_1", "double")
    rows = spark.range(20).select(F.col("id").alias("k"), F.lit(1.0).alias("x_0"), (F.col("id") / 10).alias("x_1"))
    rows.repartition(3).write.parquet(f"{tmp_path}/in")
    places = (f"{tmp_path}/out", f"{tmp_path}/checkpoint")
    for start in (0, 100):
        # The second call scores what came since the first.
        more = rows.withColumn("k", F.col("k") + start)
        if start:
            more.repartition(2).write.mode("append").parquet(f"{tmp_path}/in")
        score_files(spark, f"{tmp_path}/in", schema, ["x_0", "x_1"], net, *places).awaitTermination(60)
        wanted = score(spark.read.schema(schema).parquet(f"{tmp_path}/in"), ["x_0", "x_1"], net)
        assert sorted(map(tuple, spark.read.parquet(places[0]).collect())) == sorted(map(tuple, wanted.collect()))
        assert wanted.count() == (40 if start else 20)


def test_cluster_needs_a_shared_folder(spark, monkeypatch):
    from tidemark import session

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Conf:
        def get(self, key, default=None):
            return default

    class Remote:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(ValueError):
        session.shared_dir(Remote())


def test_tables_of_a_job_can_be_removed(spark):
    from pathlib import Path

    from tidemark import session

    path = session.shared_path(spark, "test")
    spark.range(3).write.parquet(path)
    assert Path(path).exists() and session.clean(spark) >= 1 and not Path(path).exists() and session.clean(spark) == 0
