from __future__ import annotations

import subprocess
import sys
from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.models import batch, components, online, packed, scoring, search, weights as wt
from tidemark.panel import Panel

FEATURES = ["x_0", "x_1", "x_2"]
ROOT = Path(__file__).resolve().parent.parent


def design(spark, lengths: dict[int, int], seed: int = 0, **options) -> tuple[Panel, pd.DataFrame]:
    rng = np.random.default_rng(seed)
    rows = pd.concat(
        [
            pd.DataFrame({"s": s, "t": range(n), "x_0": 1.0, "x_1": rng.normal(size=n), "x_2": rng.normal(size=n), "y": rng.integers(0, 2, n).astype(float)})
            for s, n in lengths.items()
        ]
    )
    return Panel(spark.createDataFrame(rows.sample(frac=1.0, random_state=1)).repartition(3), "s", "t", **options), rows


def table(df) -> dict[tuple, float]:
    return {(r["s"], r["model_id"], r["layer"], r["src"], r["dst"]): r["weight"] for r in df.collect()}


def models(panel, trials=1):
    return search.trials_of(panel.df.select("s").distinct(), trials)


def sigmoid(z):
    return 1 / (1 + np.exp(-z))


def train_net(x, y, w, v, eta, mu, epochs):
    """One hidden layer, row by row: hidden weights w (input × neuron), output weights v (constant first)."""
    w, v = w.copy(), v.copy()
    dw, dv = np.zeros_like(w), np.zeros_like(v)
    curve = []
    for _ in range(epochs):
        sse, hits = 0.0, 0
        for xi, yi in zip(x, y):
            h = np.concatenate([[1.0], sigmoid(xi @ w)])
            o = sigmoid(h @ v)
            sse += 0.5 * (yi - o) ** 2
            hits += (o >= 0.5) == (yi >= 0.5)
            e = -(yi - o) * o * (1 - o)
            delta = e * v[1:] * h[1:] * (1 - h[1:])
            dv = eta * h * e + mu * dv
            dw = eta * np.outer(xi, delta) + mu * dw
            v, w = v - dv, w - dw
        curve.append((sse, hits / len(x)))
    return w, v, curve


@pytest.mark.parametrize("options", [{}, {"max_series_rows": 4, "segment_rows": 5}])
def test_mlp_equals_the_row_loop(spark, options):
    panel, rows = design(spark, {1: 23, 2: 5, 3: 1}, **options)
    init = wt.random_init(models(panel, 3), 3, 4, seed=5)
    start = table(init)
    fit = online.fit_online(panel, FEATURES, "y", init, eta=0.3, momentum=0.6, epochs=3, batches=2).pinned()
    got = table(fit.weights)
    curve = {(r["s"], r["model_id"], r["epoch"]): (r["sse"], r["success"]) for r in fit.curve.collect()}
    assert len(got) == len(start) == 3 * 3 * (12 + 5)
    for s in (1, 2, 3):
        part = rows[rows.s == s].sort_values("t")
        for m in (1, 2, 3):
            w = np.array([[start[s, m, "hidden", j, n] for n in range(1, 5)] for j in range(3)])
            v = np.array([start[s, m, "output", n, 0] for n in range(5)])
            w2, v2, c = train_net(part[FEATURES].to_numpy(), part.y.to_numpy(), w, v, 0.3, 0.6, 3)
            assert np.allclose([[got[s, m, "hidden", j, n] for n in range(1, 5)] for j in range(3)], w2, atol=1e-12)
            assert np.allclose([got[s, m, "output", n, 0] for n in range(5)], v2, atol=1e-12)
            assert np.allclose([curve[s, m, e] for e in (1, 2, 3)], c)


@pytest.mark.parametrize("perceptron", [False, True])
@pytest.mark.parametrize("options", [{}, {"max_series_rows": 4, "segment_rows": 5}])
def test_plr_equals_the_row_loop(spark, options, perceptron):
    panel, rows = design(spark, {1: 12, 2: 7}, **options)
    init = wt.constant_init(models(panel), 3, 0, 0.25)
    fit = online.fit_online(panel, FEATURES, "y", init, eta=0.5, epochs=2, perceptron=perceptron, trace_every=1).pinned()
    got, trace = table(fit.weights), {(r["s"], r["step"], r["src"]): r["weight"] for r in fit.trace.collect()}
    for s in (1, 2):
        part = rows[rows.s == s].sort_values("t")
        w, step = np.full(3, 0.25), 0
        for _ in range(2):
            for xi, yi in zip(part[FEATURES].to_numpy(), part.y):
                assert np.allclose([trace[s, step, j] for j in range(3)], w, atol=1e-12)
                p = sigmoid(xi @ w)
                w = w + 0.5 * (yi - (float(p >= 0.5) if perceptron else p)) * p * (1 - p) * xi
                step += 1
        assert np.allclose([got[s, 1, "output", j, 0] for j in range(3)], w, atol=1e-12)
    assert len(trace) == 2 * 19 * 3


def test_result_does_not_depend_on_partitions(spark):
    results = []
    for partitions in ("1", "4", "16"):
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        panel, _ = design(spark, {1: 9, 2: 14})
        init = wt.random_init(models(panel, 2), 3, 2, seed=3)
        results.append(table(online.fit_online(panel, FEATURES, "y", init, epochs=2, momentum=0.5, rows_per_task=5).weights))
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert results[0] == results[1] == results[2]


def test_gradient_equals_central_differences(spark):
    panel, rows = design(spark, {1: 30})
    init = wt.random_init(spark.createDataFrame([("m",)], "model_id string"), 3, 2, seed=2).toPandas()
    x, y = rows[FEATURES].to_numpy(), rows.y.to_numpy()

    def loss(frame):
        hidden, output = batch._arrays(frame, 3)["m"]
        o = sigmoid(np.column_stack([np.ones(len(x)), sigmoid(x @ hidden.T)]) @ output)
        return 0.5 * ((y - o) ** 2).sum()

    sums = batch.batch_gradient(panel.df, FEATURES, "y", init).toPandas().set_index(["layer", "src", "dst"])["gradient"]
    assert sums["loss", 0, 0] == pytest.approx(loss(init))
    for i, row in init.iterrows():
        up, down = init.copy(), init.copy()
        up.loc[i, "weight"] += 1e-5
        down.loc[i, "weight"] -= 1e-5
        assert sums[row.layer, row.src, row.dst] == pytest.approx((loss(up) - loss(down)) / 2e-5, abs=1e-7)


def test_batch_descent_lowers_the_loss(spark):
    panel, rows = design(spark, {1: 60})
    df = panel.df.withColumn("y", (F.col("x_1") > 0).cast("double"))
    init = wt.random_init(spark.createDataFrame([("a",), ("b",)], "model_id string"), 3, 0, sd=0.1, seed=2)
    weights, curve = batch.fit_batch(df, FEATURES, "y", init, eta=2.0, momentum=0.5, epochs=4)
    assert len(weights) == 6
    for _, part in curve.sort_values("epoch").groupby("model_id"):
        assert part["sse"].is_monotonic_decreasing


def test_scores_of_one_model_and_of_many(spark):
    panel, rows = design(spark, {1: 4, 2: 4})
    init = wt.random_init(models(panel), 3, 2, seed=9).cache()
    by_key = {(r["s"], r["t"]): r["p"] for r in scoring.score_by_key(panel.df, FEATURES, init.drop("model_id"), ["s"], 2).collect()}
    for s in (1, 2):
        one = scoring.score(panel.df.filter(F.col("s") == s), FEATURES, init.filter(F.col("s") == s))
        for r in one.collect():
            assert r["p"] == pytest.approx(by_key[s, r["t"]], rel=1e-12)
    with pytest.raises(ValueError):
        scoring.read_net(init)


def test_restarts_grid_and_stages(spark):
    panel, _ = design(spark, {1: 12, 2: 8})
    best, fits = search.restart_search(panel, FEATURES, "y", trials=5, neurons=2, epochs=3, batches=2)
    last = {(r["s"], r["model_id"]): r["success"] for r in fits.curve.filter("epoch = 3").collect()}
    for r in best.collect():
        wins = [m for (s, m), v in last.items() if s == r["s"] and v == max(v2 for (s2, _), v2 in last.items() if s2 == r["s"])]
        assert r["model_id"] == min(wins) and r["success"] == last[r["s"], r["model_id"]]

    grid = search.param_grid(spark, [1, 3], [1, 2], [0.1, 0.9])
    assert grid.count() == 8
    table_ = search.grid_search(panel, FEATURES, "y", grid).pinned()
    assert table_.curve.count() == 2 * (4 * 1 + 4 * 2)
    assert table_.weights.groupBy("s", "model_id").count().select("count").distinct().count() == 2

    init = wt.random_init(models(panel), 3, 2)
    weights, curve = search.staged_fit(panel, FEATURES, "y", init, [{"epochs": 2, "momentum": 0.7}, {"epochs": 1, "momentum": 0.0}])
    assert [(r["stage"], r["epoch"], r["step"]) for r in curve.filter("s = 1").orderBy("step").collect()] == [(1, 1, 1), (1, 2, 2), (2, 1, 3)]
    assert weights.count() == init.count()


def test_random_weights(spark):
    df = wt.random_init(spark.range(400).select(F.col("id").alias("model_id")), 5, 10, sd=2.0, seed=1)
    row = df.agg(F.avg("weight").alias("m"), F.stddev("weight").alias("s"), F.count("*").alias("n"), F.countDistinct("weight").alias("d")).first()
    assert row["n"] == row["d"] == 400 * (50 + 11)
    assert abs(row["m"]) < 0.06 and abs(row["s"] - 2.0) < 0.05
    again = wt.random_init(spark.range(400).repartition(7).select(F.col("id").alias("model_id")), 5, 10, sd=2.0, seed=1)
    assert wt.weights_unchanged(df, again).first()[0]
    assert not wt.weights_unchanged(df, again.limit(10)).first()[0]


def test_save_and_load(spark, tmp_path):
    df = wt.random_init(spark.range(3).select(F.col("id").alias("model_id")), 3, 2, seed=4)
    wt.save_model(df, f"{tmp_path}/model")
    assert wt.weights_unchanged(df, wt.load_model(spark, f"{tmp_path}/model")).first()[0]


def test_principal_component(spark):
    panel, rows = design(spark, {1: 50})
    df = panel.df.withColumn("x_3", 2 * F.col("x_1") - F.col("x_2"))
    loadings = components.principal_loadings(df, ["x_1", "x_2", "x_3"])
    frame = rows.assign(x_3=2 * rows.x_1 - rows.x_2)[["x_1", "x_2", "x_3"]]
    vector = np.linalg.svd((frame - frame.mean()).to_numpy())[2][0]
    vector = vector * np.sign(vector[np.abs(vector).argmax()])
    assert np.allclose(list(loadings.values()), vector)


@pytest.mark.parametrize("options", [{}, {"max_series_rows": 4, "segment_rows": 5}, {"rows_per_task": 6}])
def test_incomplete_rows_null_keys_and_scores(spark, options):
    """Rows without a label or feature are left out, a NULL series is a series, and the last epoch's scores are those of the loop."""
    rng = np.random.default_rng(3)
    rows = [(s, t, 1.0, float(rng.normal()), None if t == 5 else float(rng.normal()), None if t == 16 else float(t % 2))
            for s in ("a", None) for t in range(17)]
    per_task = {k: options[k] for k in ("rows_per_task",) if k in options}
    panel = Panel(spark.createDataFrame(rows, "s string, t int, x_0 double, x_1 double, x_2 double, y double"), "s", "t",
                  **{k: v for k, v in options.items() if k not in per_task})
    init = wt.constant_init(models(panel), 3, 0, 0.5)
    fit = online.fit_online(panel, FEATURES, "y", init, eta=0.4, epochs=2, keep_scores=True, **per_task).pinned()
    got = table(fit.weights)
    scores = {(r["s"], r["rn"]): (r["p"], r["difference"]) for r in fit.scores.collect()}
    assert len(scores) == 30 and len(got) == 6
    for s in ("a", None):
        part = [r for r in rows if r[0] == s and None not in r[2:]]
        w = np.full(3, 0.5)
        for epoch in range(2):
            for i, r in enumerate(part, start=1):
                x, y = np.array(r[2:5]), r[5]
                p = sigmoid(x @ w)
                if epoch:
                    assert np.allclose(scores[s, i], (p, y - p))
                w = w + 0.4 * (y - p) * p * (1 - p) * x
        assert np.allclose([got[s, 1, "output", j, 0] for j in range(3)], w)


def long_series(spark, **options):
    """Series that need several slices, one that needs one, and models of a series without rows."""
    panel, rows = design(spark, {1: 30, 2: 3, 3: 17, 4: 41}, max_series_rows=4, segment_rows=10, **options)
    none = spark.createDataFrame([(9,)], "s long")
    return panel, rows, models(panel, 3).unionByName(search.trials_of(none, 2))


def everything(fit):
    weights = table(fit.weights)
    curve = {(r["s"], r["model_id"], r["epoch"]): (r["sse"], r["success"]) for r in fit.curve.collect()}
    return weights, curve


@pytest.mark.parametrize("neurons", [0, 3])
@pytest.mark.parametrize("how", [{"relay": True, "epochs_per_job": 2, "tasks": 2}, {"relay": False}])
def test_slices_train_like_whole_series(spark, how, neurons):
    panel, rows, nets = long_series(spark)
    init = wt.random_init(nets, 3, neurons, seed=5)
    options = {"eta": 0.4, "momentum": 0.5, "epochs": 3}
    whole = everything(online.fit_online(Panel(panel.df, "s", "t"), FEATURES, "y", init, **options))
    sliced = everything(online.fit_online(panel, FEATURES, "y", init, **options, **how).pinned())
    for a, b in zip(whole, sliced):
        assert a.keys() == b.keys() and a
        for k in a:
            assert b[k] == pytest.approx(a[k], abs=1e-12)


@pytest.mark.parametrize("relay", [True, False])
def test_traces_and_scores_of_slices(spark, relay):
    panel, rows, nets = long_series(spark)
    init = wt.random_init(nets, 3, 0, seed=2)
    options = {"eta": 0.4, "epochs": 2, "trace_every": 4, "keep_scores": True}
    whole = online.fit_online(Panel(panel.df, "s", "t"), FEATURES, "y", init, **options).pinned()
    sliced = online.fit_online(panel, FEATURES, "y", init, **options, relay=relay).pinned()
    for name, key in (("trace", ["s", "model_id", "step", "src"]), ("scores", ["s", "model_id", "rn"])):
        a, b = (getattr(f, name).toPandas().sort_values(key).reset_index(drop=True) for f in (whole, sliced))
        assert len(a) and a[key].equals(b[key]) and np.allclose(a.drop(columns=key), b.drop(columns=key))


def test_settings_by_model_in_slices(spark):
    panel, rows, nets = long_series(spark)
    init = wt.random_init(nets, 3, 2, seed=1).withColumns({"eta": F.col("model_id") * 0.1, "momentum": F.lit(0.3), "epochs": F.col("model_id").cast("int")})
    options = {"eta": None, "momentum": None, "epochs": None}
    whole = everything(online.fit_online(Panel(panel.df, "s", "t"), FEATURES, "y", init, **options))
    for how in ({"relay": True, "tasks": 2}, {"relay": False}):
        sliced = everything(online.fit_online(panel, FEATURES, "y", init, **options, **how).pinned())
        assert [a.keys() for a in whole] == [b.keys() for b in sliced]
        assert all(b[k] == pytest.approx(a[k], abs=1e-12) for a, b in zip(whole, sliced) for k in a)


def test_many_epochs_take_few_jobs_and_leave_one_table(spark, monkeypatch):
    from tidemark.models import relay

    panel, rows, nets = long_series(spark)
    made, gone = [], []
    path_of, forget = relay.shared_path, relay.remove
    monkeypatch.setattr(relay, "shared_path", lambda s, label: made.append(path_of(s, label)) or made[-1])
    monkeypatch.setattr(relay, "remove", lambda s, path: gone.append(path) or forget(s, path))
    init = wt.constant_init(nets, 3, 0, 0.1)
    fit = online.fit_online(panel, FEATURES, "y", init, eta=0.3, epochs=50, relay=True, tasks=1)
    assert fit.weights.count() == 14 * 3 and fit.curve.count() == 14 * 50
    assert len(made) == 1 + 5 and gone == made[:-1]
    whole = everything(online.fit_online(Panel(panel.df, "s", "t"), FEATURES, "y", init, eta=0.3, epochs=50))
    assert all(b[k] == pytest.approx(a[k], abs=1e-10) for a, b in zip(whole, everything(fit)) for k in a)


def test_groups_follow_the_rows(spark):
    """Series are dealt to groups of bounded size however many rows a task may hold."""
    assert online.groups_of(spark, 36_000_000, 500_000) == 36_000_000 // online.ROWS_PER_GROUP
    assert online.groups_of(spark, 100, 500_000) == spark.sparkContext.defaultParallelism and online.groups_of(spark, 100, 2) == 50


def test_series_go_in_waves(spark, monkeypatch):
    """A task holds the rows of one wave; traces, scores and models without rows are those of whole series."""
    from tidemark.models import relay

    monkeypatch.setattr(relay, "ROWS_PER_WAVE", 15)
    panel, rows, nets = long_series(spark)
    assert relay.waves_of(spark, panel.stats.rows, 2) == 4 and not relay.fits(spark, relay.slots(spark) * relay.ROWS_PER_TASK + 1)
    init = wt.random_init(nets, 3, 0, seed=2)
    options = {"eta": 0.4, "epochs": 2, "keep_scores": True}
    whole = online.fit_online(Panel(panel.df, "s", "t"), FEATURES, "y", init, **options).pinned()
    sliced = online.fit_online(panel, FEATURES, "y", init, **options, relay=True, tasks=2, epochs_per_job=1).pinned()
    for a, b in zip(everything(whole), everything(sliced)):
        assert a.keys() == b.keys() and a and all(b[k] == pytest.approx(a[k], abs=1e-12) for k in a)
    scores = [{(r["s"], r["model_id"], r["rn"]): r["p"] for r in f.scores.collect()} for f in (whole, sliced)]
    assert scores[0].keys() == scores[1].keys() and all(scores[1][k] == pytest.approx(v, abs=1e-12) for k, v in scores[0].items())


def test_a_failed_task_changes_nothing(tmp_path):
    """In a session that allows failures, one task of the barrier stage fails once; the stage runs again."""
    code = f"""
import os, sys
sys.path[:0] = [{str(ROOT)!r}, {str(ROOT / 'tests')!r}]
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[4,4]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4")
         .config("spark.driver.memory", "2g").config("spark.checkpoint.dir", {str(tmp_path / 'shared')!r}).getOrCreate())
import test_models as t
from tidemark.models import online, weights as wt
marker = {str(tmp_path / 'failed')!r}

def fail_once(task, beat):
    import os
    if task == 1 and beat == 1 and not os.path.exists(marker):
        open(marker, "w").close()
        raise RuntimeError("lost")

panel, rows, nets = t.long_series(spark)
init = wt.random_init(nets, 3, 2, seed=4)
results = [t.everything(online.fit_online(panel, t.FEATURES, "y", init, epochs=2, relay=True, tasks=3, epochs_per_job=1, probe=p).pinned()) for p in (None, fail_once)]
assert os.path.exists(marker) and results[0] == results[1]
print("same")
"""
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=240)
    assert done.stdout.strip().endswith("same"), done.stderr[-2000:]


def test_packed_weights(spark):
    panel, _ = design(spark, {1: 5, 2: 6})
    for neurons in (0, 3):
        rows = wt.random_init(models(panel, 2), 3, neurons, sd=2.0, seed=8)
        arrays = wt.random_arrays(models(panel, 2), 3, neurons, sd=2.0, seed=8)
        again = packed.unpack(arrays, ["s", "model_id"], 3)
        assert table(rows) == table(again) == table(packed.unpack(packed.pack(rows, ["s", "model_id"]), ["s", "model_id"], 3))
        assert packed.pack(arrays, ["s", "model_id"]).columns == ["s", "model_id", "neurons", "weights"]


def test_traces_of_hidden_neurons_are_refused(spark):
    panel, _ = design(spark, {1: 5})
    with pytest.raises(ValueError):
        online.fit_online(panel, FEATURES, "y", wt.constant_init(models(panel), 3, 2, 0.1), trace_every=1)


@pytest.mark.parametrize("neurons", [0, 2, 30])
@pytest.mark.parametrize("limits", [{}, {"EXPRESSION_WEIGHTS": 0}, {"EXPRESSION_WEIGHTS": 0, "SENT_WEIGHTS": 0}])
def test_scores_on_every_path(spark, monkeypatch, neurons, limits):
    """Literals, matrices sent along and arrays joined give the same scores; NULL features and missing models give NULL."""
    for name, value in limits.items():
        monkeypatch.setattr(scoring, name, value)
    rng = np.random.default_rng(5)
    rows = [(s, i, 1.0, float(rng.normal()), None if i == 3 else float(rng.normal())) for s in ("a", "b", None, "none") for i in range(40)]
    df = spark.createDataFrame(rows, "s string, t int, x_0 double, x_1 double, x_2 double").repartition(3)
    nets = {s: {c: float(rng.normal()) for c in wt.connections(3, neurons)} for s in ("a", "b", None)}
    weights = spark.createDataFrame([(s, *c, w) for s, net in nets.items() for c, w in net.items()], "s string, layer string, src int, dst int, weight double")

    def expected(net, x):
        if None in x:
            return None
        if not neurons:
            return sigmoid(sum(v * net["output", j, 0] for j, v in enumerate(x)))
        hidden = [sigmoid(sum(v * net["hidden", j, n] for j, v in enumerate(x))) for n in range(1, neurons + 1)]
        return sigmoid(net["output", 0, 0] + sum(h * net["output", n, 0] for n, h in enumerate(hidden, start=1)))

    by_key = {(r["s"], r["t"]): r["p"] for r in scoring.score_by_key(df, FEATURES, weights, ["s"], neurons).collect()}
    single = {(r["s"], r["t"]): r["p"] for r in scoring.score(df, FEATURES, nets["a"]).collect()}
    assert len(by_key) == len(single) == 160
    for s, t, *x in rows:
        for got, net in ((by_key[s, t], nets.get(s)), (single[s, t], nets["a"])):
            want = None if net is None else expected(net, x)
            assert got is None if want is None else got == pytest.approx(want, abs=1e-12)


def test_many_batch_models_take_several_passes(spark, monkeypatch):
    panel, _ = design(spark, {1: 30})
    init = wt.weight_rows(spark.range(1, 6).select(F.col("id").cast("string").alias("model_id")), 3, 2, F.sin(F.col("src") + F.col("dst") + F.col("model_id")))
    once = {tuple(r)[:4]: r["gradient"] for r in batch.batch_gradient(panel.df, FEATURES, "y", init).collect()}
    monkeypatch.setattr(batch, "WEIGHTS_PER_PASS", 10)
    again = {tuple(r)[:4]: r["gradient"] for r in batch.batch_gradient(panel.df, FEATURES, "y", init).collect()}
    assert once.keys() == again.keys() and all(np.isclose(once[k], again[k]) for k in once)
