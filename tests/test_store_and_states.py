"""Panel store, averages that go on, moments that merge, coverage at every threshold, components by series, files of differing headers."""

from __future__ import annotations

import re

import numpy as np
import pytest
from helpers import close, column, columns, make_panel, serial_average, walk
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.rolling import label_next_up, sma_n
from tidemark.models import batch_series, components, online, search, weights as wt
from tidemark.operators import coverage, moments, resume, smoothing, summaries
from tidemark.panel import ROW_NUMBER, SERIES_ROWS, Panel
from tidemark.plans.evaluate import walk_forward
from tidemark.session import shared_path
from tidemark.sources.ledger import read_ledger
from tidemark.sources.store import PanelStore

SERIES = {"a": walk(43, 1), "b": walk(7, 2), None: walk(12, 3), "c": [5.0]}


def rows_of(spark, series, first=0, last=None):
    rows = [(s, t, 1000 + t % 3, v) for s, values in series.items() for t, v in enumerate(values) if first <= t and (last is None or t < last)]
    return spark.createDataFrame(rows, "s string, t int, tie int, x double").repartition(5)


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_store_numbers_rows(spark):
    panel = Panel(rows_of(spark, SERIES, last=20), "s", "t", "tie")
    store = PanelStore.create(panel, shared_path(spark, "store"), range_rows=6)
    assert store.append(rows_of(spark, SERIES, first=20), range_rows=6) == 1
    manifest = store.manifest.collect()
    assert sum(r["rows"] for r in manifest) == 63 and len(manifest) > 8
    assert all(r["first"] <= r["last"] for r in manifest)
    for long in ({}, {"max_series_rows": 5, "segment_rows": 4}):
        read = store.panel(**long)
        found = {(r["s"], r["t"]): (r[ROW_NUMBER], r[SERIES_ROWS]) for r in read.rows.collect()}
        assert found == {(s, t): (t + 1, len(v)) for s, v in SERIES.items() for t in range(len(v))}
        assert set(read.df.columns) == {"s", "t", "tie", "x"}
        assert read.stats.series == 4 and read.stats.rows == 63 and read.stats.longest == 43
        rolled = columns(read.roll({"m": sma_n("x", 5), "up": label_next_up("x")}).df.filter("s is not null"), "m", "up")
        expected = columns(Panel(rows_of(spark, SERIES), "s", "t", "tie").roll({"m": sma_n("x", 5), "up": label_next_up("x")}).df.filter("s is not null"), "m", "up")
        for s in ("a", "b", "c"):
            assert close([v for row in rolled[s] for v in row], [v for row in expected[s] for v in row])


def test_reading_a_store_needs_no_sort_and_no_checkpoint(spark, monkeypatch):
    store = PanelStore.create(Panel(rows_of(spark, SERIES), "s", "t", "tie"), shared_path(spark, "store"), range_rows=6)
    stored = []
    from pyspark.sql import DataFrame

    kind = type(spark.range(1))
    checkpoint = kind.checkpoint
    monkeypatch.setattr(kind, "checkpoint", lambda self, *a: stored.append(self) or checkpoint(self, *a))
    panel = store.panel(["x"], max_series_rows=5, segment_rows=4)
    plan = plan_of(panel.rows)
    assert "rangepartitioning" not in plan and isinstance(panel.df, DataFrame)
    smoothing.macd_signal(panel, "signal", "x", fast=2, slow=3, n=2).df.count()
    assert not stored


def test_appended_rows_must_be_later(spark):
    store = PanelStore.create(Panel(rows_of(spark, SERIES, last=20), "s", "t", "tie"), shared_path(spark, "store"))
    with pytest.raises(ValueError, match="before the end"):
        store.append(rows_of(spark, SERIES, first=19))
    # A batch whose manifest was never written is not there.
    path = store.path
    rows_of(spark, SERIES, first=30).withColumns({"__range": F.lit(0), "__place": F.lit(0).cast("long")}).write.parquet(f"{path}/rows/__batch=7")
    assert store.panel().rows.count() == sum(min(20, len(v)) for v in SERIES.values())


def test_a_batch_reads_its_own_files(spark):
    store = PanelStore.create(Panel(rows_of(spark, SERIES, last=20), "s", "t", "tie"), shared_path(spark, "store"), range_rows=6)
    store.append(rows_of(spark, SERIES, first=20), range_rows=6)
    _, state = resume.ema_append(store.panel(batch=0), "y", "x", 4)
    newer, _ = resume.ema_append(store.panel(batch=1), "y", "x", 4, state.checkpoint())
    scans = [line for line in plan_of(newer.df).splitlines() if "FileScan" in line and "x#" in line]
    assert scans and all(re.search(r"PartitionFilters: \[isnotnull\(__batch#\d+\), \(__batch#\d+ = 1\)\]", line) for line in scans), scans


GAPPY = {
    "plain": walk(30, 4), "late": [None, None, None, *walk(20, 5)], "hole": [*walk(9, 6), None, *walk(12, 7)], "few": walk(2, 8), "none": [None] * 5,
    "new": [], None: walk(17, 9),
}


@pytest.mark.parametrize("cuts", [(1,), (3, 10), (5, 6, 7, 20)])
@pytest.mark.parametrize("long", [{}, {"max_series_rows": 2, "segment_rows": 4}])
def test_averages_go_on(spark, cuts, long):
    n = 4
    series = GAPPY | {"new": [None] * 8 + walk(9, 3)}
    whole = Panel(rows_of(spark, series), "s", "t", "tie")
    expected = smoothing.rsi_n(smoothing.ema_n(whole, "e", "x", n), "r", "x", n).df
    expected = {(r["s"], r["t"]): (r["e"], r["r"]) for r in expected.collect()}
    averages, strengths, found = None, None, {}
    for first, last in zip((0, *cuts), (*cuts, None)):
        panel = Panel(rows_of(spark, series, first, last), "s", "t", "tie", **long)
        panel, averages = resume.ema_append(panel, "e", "x", n, averages)
        panel, strengths = resume.rsi_append(panel, "r", "x", n, strengths)
        averages, strengths = averages.checkpoint(), strengths.checkpoint()
        found |= {(r["s"], r["t"]): (r["e"], r["r"]) for r in panel.df.collect()}
        assert set(panel.df.columns) == {"s", "t", "tie", "x", "e", "r"}
    assert found.keys() == expected.keys()
    for i in (0, 1):
        keys = sorted(found, key=str)
        assert close([found[k][i] for k in keys], [expected[k][i] for k in keys])
    assert close([found["hole", t][0] for t in range(22)], serial_average(series["hole"], n, 2 / (n + 1)))


def test_moments_merge(spark):
    rng = np.random.default_rng(1)
    rows = [(s, int(rng.integers(0, 30)), float(v)) for s, size in (("a", 4000), ("b", 1), ("c", 50), (None, 20)) for v in 1e9 + rng.gamma(2.0, 1.0, size)]
    rows += [("same", i, 7.0) for i in range(9)] + [("nulls", 1, None)] * 3 + [("a", 77, None)]
    df = spark.createDataFrame(rows, "s string, part int, x double")
    for salt in (1, 3):
        states = moments.merge_moments(moments.moments(df, "x", ["s", "part"]), ["s"], salt=salt)
        found = {r["s"]: r for r in moments.jarque_bera_of(states, ["s"]).collect()}
        sums = {r["s"]: r for r in moments.mean_sd_of(states, ["s"]).collect()}
        for r in summaries.jarque_bera(df, "x", ["s"]).collect():
            own = found[r["s"]]
            assert own["n"] == r["n"]
            if r["s"] in ("a", "c", None):
                assert own["statistic"] == pytest.approx(r["statistic"], rel=1e-5) and own["p_value"] == pytest.approx(r["p_value"], rel=1e-4, abs=1e-12)
        # The sums keep their digits although the mean is far larger than the spread.
        values = np.array([v for s, _, v in rows if s == "a" and v is not None]) - 1e9
        d = values - values.mean()
        own = {r["s"]: r for r in states.collect()}["a"]
        for k, name in ((2, "m2"), (3, "m3"), (4, "m4")):
            assert own[name] == pytest.approx((d**k).sum(), rel=1e-6)
        assert found["same"]["statistic"] is None and found["b"]["statistic"] is None and found["nulls"]["n"] == 0
        assert sums["a"]["sd"] == pytest.approx(values.std(ddof=1), rel=1e-7) and sums["b"]["sd"] is None and sums["nulls"]["mean"] is None


@pytest.mark.parametrize("range_rows", [3, 100])
def test_coverage_curve(spark, range_rows):
    rng = np.random.default_rng(6)
    rows = [(float(rng.integers(0, 21)) / 20, float(rng.integers(0, 2))) for _ in range(400)] + [(None, 1.0), (0.5, None)]
    df = spark.createDataFrame(rows, "p double, y double").repartition(6)
    curve = coverage.coverage_curve(df, confidence=F.round(F.abs(F.col("p") - 0.5), 6), range_rows=range_rows)
    known = [(round(abs(p - 0.5), 6), (p >= 0.5) == (y >= 0.5)) for p, y in rows if p is not None and y is not None]
    expected = {}
    for c in {c for c, _ in known}:
        hits = [h for d, h in known if d >= c]
        expected[c] = (len(hits), sum(hits) / len(hits), len(hits) / len(known))
    assert {r["confidence"]: (r["bets"], r["hit_rate"], r["coverage"]) for r in curve.collect()} == expected
    assert "SinglePartition" not in plan_of(curve).split("BroadcastExchange")[0]
    assert coverage.coverage_curve(df.filter("false")).count() == 0


def test_components_by_series(spark):
    rng = np.random.default_rng(2)
    rows = []
    for s, size, mean in (("a", 300, 0.0), ("b", 40, 1e8), (None, 25, 3.0), ("one", 1, 0.0)):
        base = rng.normal(size=size)
        for v in base.tolist():
            rows.append((s, mean + v, mean - 2 * v + float(rng.normal(0, 0.1)), mean + float(rng.normal(0, 0.5))))
    rows += [("flat", 1.0, 2.0, 3.0)] * 5 + [("a", None, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "s string, u double, v double, w double").repartition(7)
    found = {r["s"]: r["loadings"] for r in components.principal_loadings_by(df, ["u", "v", "w"], ["s"]).collect()}
    assert set(found) == {"a", "b", None, "one", "flat"} and found["one"] is None and found["flat"] is None
    for s in ("a", "b", None):
        x = np.array([r[1:] for r in rows if r[0] == s and r[1] is not None])
        vector = np.linalg.eigh(np.cov(x.T))[1][:, -1]
        vector *= np.sign(vector[np.abs(vector).argmax()])
        assert np.allclose(found[s], vector, atol=1e-6)
    scored = components.principal_component_by(df, ["u", "v", "w"], ["s"]).collect()
    assert len(scored) == len(rows)
    for r in scored:
        own = found[r["s"]]
        expected = None if own is None or r["u"] is None else float(np.dot(own, (r["u"], r["v"], r["w"])))
        assert r["pc1"] is None if expected is None else r["pc1"] == pytest.approx(expected)


def test_files_of_differing_headers(spark, tmp_path):
    (tmp_path / "old.csv").write_text('day,"price",volume\n01.02.99,1.5,10\n02.02.99,.,x\n\n03.02.99,abc,\n31.31.99,2.5,4,9,8\n')
    (tmp_path / "new.csv").write_text("volume;other;Date;close\n5;?;2001-03-04;7.25\n6\n")
    schema = T.StructType([T.StructField("day", T.DateType()), T.StructField("price", T.DoubleType()), T.StructField("volume", T.LongType()), T.StructField("note", T.StringType())])
    old = read_ledger(spark, str(tmp_path / "old.csv"), schema)
    assert sorted((r["line"], str(r["day"]), r["price"], r["volume"], r["note"]) for r in old.rows.collect()) == [
        (2, "1999-02-01", 1.5, 10, None), (3, "1999-02-02", None, None, None), (5, "1999-02-03", None, None, None), (6, "None", 2.5, 4, None)]
    assert sorted((r["line"], str(r["column"]), r["text"]) for r in old.rejected.collect()) == [
        (3, "volume", "x"), (5, "price", "abc"), (6, "None", "8"), (6, "None", "9"), (6, "day", "31.31.99")]
    assert {r["column"]: (r["good"], r["gaps"], r["bad"]) for r in old.counts.collect()} == {"day": (3, 0, 1), "price": (2, 1, 1), "volume": (2, 1, 1)}
    new = read_ledger(spark, str(tmp_path / "new.csv"), schema, {"day": ["Date"], "price": ["open", "close"]}, sep=";")
    assert [(r["line"], str(r["day"]), r["price"], r["volume"]) for r in sorted(new.rows.collect(), key=lambda r: r["line"])] == [(2, "2001-03-04", 7.25, 5), (3, "None", None, 6)]
    assert sorted((r["line"], r["column"], r["text"]) for r in new.rejected.collect()) == [(3, "day", None), (3, "price", None)]


def test_lines_of_large_files_are_numbered_over_blocks(spark, tmp_path):
    lines = ["k;v", *(f"{i};{'bad' if i % 50 == 0 else i}" for i in range(1, 4001))]
    (tmp_path / "big.csv").write_text("\n".join(lines))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        schema = T.StructType([T.StructField("k", T.LongType()), T.StructField("v", T.DoubleType())])
        read = read_ledger(spark, str(tmp_path), schema, sep=";")
        assert read.rows.filter(F.col("line") != F.col("k") + 1).count() == 0 and read.rows.count() == 4000
        assert sorted(r["line"] for r in read.rejected.collect()) == [i + 1 for i in range(50, 4001, 50)]
        assert read.rows.inputFiles()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def design(spark, lengths, seed=0, **options):
    rng = np.random.default_rng(seed)
    rows = [(s, t, 1.0, float(rng.normal()), float(rng.integers(0, 2))) for s, n in lengths.items() for t in range(n)]
    df = spark.createDataFrame(rows, "s string, t int, x_0 double, x_1 double, y double").repartition(4)
    return Panel(df, "s", "t", **options), rows


@pytest.mark.parametrize("neurons", [0, 2])
def test_full_batch_by_series(spark, neurons):
    """Against a loop over models, for series in one place and in several; models of a series without rows keep their weights."""
    panel, rows = design(spark, {"a": 90, "b": 8, None: 20})
    nets = search.trials_of(panel.df.select("s").distinct().unionByName(spark.createDataFrame([("none",)], "s string")), 2)
    settings = {"eta": 0.5 * F.col("model_id"), "momentum": F.lit(0.5), "epochs": F.col("model_id").cast("int") + 1}
    init = wt.random_init(nets, 2, neurons, seed=3).withColumns(settings).cache()
    key = lambda r: (r["s"], r["model_id"], r["layer"], r["src"], r["dst"])
    start = {key(r): r["weight"] for r in init.collect()}
    results = []
    for rows_per_place in (16, 1000):
        fit = batch_series.fit_batch_by_series(panel, ["x_0", "x_1"], "y", init, eta=None, momentum=None, epochs=None, rows_per_place=rows_per_place)
        results.append(({key(r): r["weight"] for r in fit.weights.collect()}, {(r["s"], r["model_id"], r["epoch"]): (r["sse"], r["success"]) for r in fit.curve.collect()}))
    sig = lambda z: 1 / (1 + np.exp(-z))
    for found, curve in results:
        assert found.keys() == start.keys()
        for s in ("a", "b", None, "none"):
            x = np.array([r[2:4] for r in rows if r[0] == s]).reshape(-1, 2)
            y = np.array([r[4] for r in rows if r[0] == s])
            for m in (1, 2):
                w = np.array([[start[s, m, "hidden", j, n] for n in range(1, neurons + 1)] for j in range(2)]).reshape(2, neurons)
                v = np.array([start[s, m, "output", n, 0] for n in range(neurons + 1 if neurons else 2)])
                dw, dv = np.zeros_like(w), np.zeros_like(v)
                for epoch in range(1, m + 2) if len(x) else ():
                    h = np.column_stack([np.ones(len(x)), sig(x @ w)]) if neurons else x
                    p = sig(h @ v)
                    assert np.allclose(curve[s, m, epoch], (0.5 * ((y - p) ** 2).sum(), ((p >= 0.5) == (y >= 0.5)).mean()))
                    e = (p - y) * p * (1 - p)
                    if neurons:
                        dw = 0.5 * m * (x.T @ (e[:, None] * v[1:] * h[:, 1:] * (1 - h[:, 1:]))) / len(x) + 0.5 * dw
                    dv = 0.5 * m * (h.T @ e) / len(x) + 0.5 * dv
                    w, v = w - dw, v - dv
                assert np.allclose([found[s, m, "output", n, 0] for n in range(len(v))], v)
                assert np.allclose([[found[s, m, "hidden", j, n] for n in range(1, neurons + 1)] for j in range(2)], w)
        assert not any(k[0] == "none" for k in curve)


def test_no_place_holds_a_long_series(spark):
    panel, rows = design(spark, {"a": 400, "b": 10})
    blocks, places = batch_series.placed(panel, ["x_0", "x_1"], "y", rows_per_place=40)
    sizes = blocks.groupBy("_place").agg(F.sum("_n").alias("n")).collect()
    assert places >= 11 and sum(r["n"] for r in sizes) == 410 and max(r["n"] for r in sizes) < 100
    assert blocks.filter("s = 'a'").count() >= 9


def test_small_places_share_parts(spark):
    """As many places as the rows ask for, but no more parts, which are what tasks take, than there is work for."""
    panel, rows = design(spark, {"a": 400, "b": 10, None: 3})
    blocks, places = batch_series.placed(panel, ["x_0", "x_1"], "y", rows_per_place=2)
    spread = blocks.agg(F.countDistinct("_part").alias("parts"), F.countDistinct("_place").alias("places"), F.sum("_n").alias("rows")).first()
    assert places >= 206 and spread["places"] > 100 and spread["rows"] == 413
    assert spread["parts"] <= batch_series.parts_of(panel, places) == spark.sparkContext.defaultParallelism
    assert all(len(r["_x"]) == 2 * r["_n"] and len(r["_y"]) == r["_n"] for r in blocks.collect())


def test_walk_forward(spark):
    """The scores of the rows behind a share are those of a model trained on that share alone."""
    panel, rows = design(spark, {"a": 41, "b": 7, None: 15})
    init = wt.random_init(panel.df.select("s").distinct().withColumn("model_id", F.lit(1).cast("long")), 2, 2, seed=4)
    found = {(r["s"], r["t"]): r for r in walk_forward(panel, ["x_0", "x_1"], "y", init, (0.2, 0.6), eta=0.4, momentum=0.3).df.collect()}
    sliced = Panel(panel.df, "s", "t", max_series_rows=4, segment_rows=10)
    again = {(r["s"], r["t"]): r["p"] for r in walk_forward(sliced, ["x_0", "x_1"], "y", init, (0.2, 0.6), eta=0.4, momentum=0.3, tasks=2).df.collect()}
    assert again.keys() == found.keys() and all(again[k] == pytest.approx(r["p"], abs=1e-12) for k, r in found.items())
    for share in (0.2, 0.6):
        older = [r for s, n in (("a", 41), ("b", 7), (None, 15)) for r in rows if r[0] == s and r[1] < round(n * share)]
        train = Panel(spark.createDataFrame(older, panel.df.schema), "s", "t")
        weights = {(r["s"], r["layer"], r["src"], r["dst"]): r["weight"] for r in online.fit_online(train, ["x_0", "x_1"], "y", init, eta=0.4, momentum=0.3).weights.collect()}
        own = [k for k, r in found.items() if r["share"] == share]
        assert own
        for s, t, x0, x1, y in rows:
            if (s, t) in own:
                h = [1 / (1 + np.exp(-(x0 * weights[s, "hidden", 0, n] + x1 * weights[s, "hidden", 1, n]))) for n in (1, 2)]
                p = 1 / (1 + np.exp(-(weights[s, "output", 0, 0] + sum(a * weights[s, "output", n, 0] for n, a in enumerate(h, 1)))))
                assert found[s, t]["p"] == pytest.approx(p, abs=1e-12) and found[s, t]["step"] == round(dict(a=41, b=7).get(s, 15) * share)
    assert len(found) == sum(n - round(n * 0.2) for n in (41, 7, 15))
