"""Searching for a good start: random restarts, parameter grids, staged training."""

from __future__ import annotations

from functools import reduce
from itertools import product
from operator import and_

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.models.online import Fit, fit_online
from tidemark.models.weights import random_arrays, random_init, weight_rows
from tidemark.panel import Panel


def best_trial(curve: DataFrame, by: list[str]) -> DataFrame:
    """The trial with the highest success of its last epoch; the lowest trial number wins a tie."""
    last = curve.groupBy(*by, "model_id").agg(F.max_by("success", "epoch").alias("success"))
    best = F.max_by(F.struct("model_id", "success"), F.struct("success", -F.col("model_id")))
    return last.groupBy(*by).agg(best.alias("_b")).select(*by, "_b.model_id", "_b.success")


def trials_of(models: DataFrame, trials: int) -> DataFrame:
    """Number the restarts of each series from 1."""
    return models.withColumn("model_id", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(trials).cast("long"))))


def of_best(df: DataFrame, best: DataFrame, series: list[str]) -> DataFrame:
    """The rows of the best trial of each series; a NULL series is one."""
    keys = [*series, "model_id"]
    names = {c: f"__{i}" for i, c in enumerate(keys)}
    same = reduce(and_, (F.col(c).eqNullSafe(F.col(n)) for c, n in names.items()))
    return df.join(best.select(*(F.col(c).alias(n) for c, n in names.items())), same, "left_semi")


def _batches(panel: Panel, models: int) -> int:
    """Tasks to spread the models of one series over: none when there are series enough for all cores."""
    cores = panel.df.sparkSession.sparkContext.defaultParallelism
    return max(1, min(models, -(-2 * cores // max(1, panel.stats.series))))


def restart_search(
    panel: Panel,
    features: list[str],
    label: str,
    *,
    trials: int = 100,
    neurons: int = 30,
    epochs: int = 150,
    eta: float = 0.1,
    momentum: float = 0.7,
    sd: float = 1.0,
    seed: int = 0,
    init: DataFrame | None = None,
    batches: int | None = None,
) -> tuple[DataFrame, Fit]:
    """Train every series from many random weights for a few epochs; returns the best trials and all fits.

    The rows go to ``batches`` tasks per series and the restarts are shared out among them, so the rows are copied
    that many times, not once per restart. By default there are as many as the cores need; one if there are many series.
    """
    if init is None:
        models = trials_of(panel.df.select(*panel.series).distinct(), trials)
        init = random_arrays(models, len(features), neurons, sd, seed)
    fit = fit_online(
        panel, features, label, init, eta=eta, momentum=momentum, epochs=epochs, batches=batches or _batches(panel, trials)
    ).pinned()
    return best_trial(fit.curve, panel.series), fit


def param_grid(spark: SparkSession, neurons: list[int], epochs: list[int], momentum: list[float], eta: list[float] = (0.1,)) -> DataFrame:
    """Every combination of the settings, numbered from 1."""
    rows = [(i, *combo) for i, combo in enumerate(product(neurons, epochs, momentum, eta), start=1)]
    return spark.createDataFrame(rows, "model_id long, neurons int, epochs int, momentum double, eta double")


def grid_search(panel: Panel, features: list[str], label: str, grid: DataFrame, weight=None, sd: float = 1.0, seed: int = 0, batches: int | None = None) -> Fit:
    """Fit every setting of a (small, driver-made) grid on every series.

    ``weight`` gives starting weights as an expression over ``layer``, ``src``, ``dst``; default are random ones.
    """
    settings = [r.asDict() for r in grid.collect()]
    series = panel.df.select(*panel.series).distinct()
    init = None
    for size in sorted({s["neurons"] for s in settings}):
        rows = [
            F.struct(*(F.lit(s[c]).cast(t).alias(c) for c, t in (("model_id", "long"), ("epochs", "int"), ("momentum", "double"), ("eta", "double"))))
            for s in settings if s["neurons"] == size
        ]
        models = series.withColumn("_g", F.explode(F.array(*rows))).select(*panel.series, "_g.*")
        if weight is None:
            part = random_init(models, len(features), size, sd, seed)
        else:
            part = weight_rows(models, len(features), size, weight)
        init = part if init is None else init.unionByName(part)
    return fit_online(panel, features, label, init, eta=None, momentum=None, epochs=None, batches=batches or _batches(panel, len(settings)))


def staged_fit(
    panel: Panel, features: list[str], label: str, init: DataFrame, stages: list[dict], batches: int = 1,
    before: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Train in stages, each starting from the weights of the one before; returns weights and the joined curve.

    ``before`` is the curve that led to the start, for example that of a search; it becomes the first stage.

    ``stages`` holds keyword arguments of ``fit_online``, for example 5000 epochs with momentum 0.7 and then 5000
    without. Momentum starts at zero in every stage.
    """
    curves = [] if before is None else [before.withColumn("stage", F.lit(1))]
    start = weights = init
    for number, stage in enumerate(stages, start=len(curves) + 1):
        fit = fit_online(panel, features, label, start, batches=batches, **stage).pinned()
        start, weights = fit.packed, fit.weights
        curves.append(fit.curve.withColumn("stage", F.lit(number)))
    return weights, append_curves(curves, [*panel.series, "model_id"])


def append_curves(curves: list[DataFrame], by: list[str]) -> DataFrame:
    """Error curves of consecutive stages as one, with a running ``step`` per model.

    A curve has one row per epoch, so the window is over parameters of the fit, not over data rows.
    """
    joined = curves[0]
    for curve in curves[1:]:
        joined = joined.unionByName(curve)
    return joined.withColumn("step", F.row_number().over(Window.partitionBy(*by).orderBy("stage", "epoch")).cast("long"))
