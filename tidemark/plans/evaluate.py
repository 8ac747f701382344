"""Train on the oldest rows, score the rest, report."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.rolling import forward_change, pct_change
from tidemark.models.online import fit_online
from tidemark.models.packed import unpack
from tidemark.models.scoring import score_by_key
from tidemark.models.search import of_best, restart_search, staged_fit
from tidemark.operators.evaluation import accuracy_tstat, agg_sse, calibration, conditional_return, hits_by_year, with_errors
from tidemark.operators.running import cum_sum
from tidemark.operators.selection import chrono_split, complete_cases, regime
from tidemark.operators.summaries import histogram
from tidemark.panel import ROW_NUMBER, SERIES_ROWS, Panel, attach
from tidemark.session import shared_dir


def train_test_eval(
    design: Panel,
    features: list[str],
    label: str,
    *,
    train_share: float = 0.3,
    trials: int = 100,
    neurons: int = 30,
    search_epochs: int = 150,
    stages: tuple[dict, ...] = ({"epochs": 5000, "momentum": 0.7}, {"epochs": 5000, "momentum": 0.0}),
    eta: float = 0.1,
    momentum: float = 0.7,
    seed: int = 0,
    init: DataFrame | None = None,
) -> tuple[Panel, DataFrame, DataFrame]:
    """Split each series by time, search restarts on the oldest part, refine the best one, score the rest.

    Returns the scored held-out rows (``p``, ``y``), the weights and the error curve of all stages, that of the search's winner
    first. ``init`` gives the starts of the search instead of random ones. The split rows are stored once, because training reads
    them in several jobs.
    """
    shared_dir(design.df.sparkSession)
    split = chrono_split(design, {"train": train_share})
    split = split.replace(split.df.select(*split.keys, *features, label, "split").checkpoint())
    train = split.subset(split.df.filter("split = 'train'").drop("split"))
    best, search = restart_search(
        train, features, label, trials=trials, neurons=neurons, epochs=search_epochs, eta=eta, momentum=momentum, seed=seed,
        init=init,
    )
    start, searched = (of_best(x, best, train.series) for x in (search.packed, search.curve))
    weights, curve = staged_fit(train, features, label, start, [{"eta": eta, **stage} for stage in stages], before=searched)
    held_out = split.subset(split.df.filter("split = 'test'").drop("split"))
    scored = score_by_key(
        held_out.df, features, weights, split.series, neurons, models=design.stats.series
    )
    return held_out.replace(scored.withColumn("y", F.col(label))), weights, curve


def walk_forward(
    design: Panel, features: list[str], label: str, init: DataFrame, shares: tuple[float, ...] = (0.1, 0.3, 0.5), **options
) -> Panel:
    """One pass over every series, whose rows are scored by the weights that the model had after the last of ``shares`` before them.

    What training on each share and scoring the rest would give for the rows up to the next share, from a single pass: its weights are kept at
    those positions, and each row looks up the latest ones before it. ``init`` has one model per series; ``options`` go to
    ``fit_online``. Returned are the rows behind the first share with ``p``, ``y``, ``share`` and ``step``, the rows that had been
    learned from. Rows with a missing feature or label are left out.
    """
    design = design.subset(complete_cases(design.df, [*features, label]))
    panel = design.numbered()
    fit = fit_online(design, features, label, init, epochs=1, snapshot_shares=tuple(shares), **options).pinned()
    # Few per series; more of them would still be one small array.
    steps = fit.snapshots.groupBy(*design.series).agg(F.array_sort(F.collect_set("step")).alias("_steps"))
    rows = attach(panel.rows, steps, design.series, design.stats.series)
    rn, rounded = F.col(ROW_NUMBER), {s: F.bround(F.col(SERIES_ROWS) * F.lit(float(s))) for s in sorted(shares)}
    latest = F.array_max(F.filter("_steps", lambda s: s < rn))
    share = F.array_max(F.array(*(F.when(cut < rn, F.lit(float(s))) for s, cut in rounded.items())))
    rows = rows.withColumns({"step": latest, "share": share, "y": F.col(label)}).filter("step IS NOT NULL")
    keys = [*design.series, "step"]
    weights = unpack(fit.snapshots, [*keys, "model_id"], len(features))
    neurons = fit.packed.agg(F.max("neurons").alias("n")).first()["n"] or 0
    scored = score_by_key(rows.drop("_steps"), features, weights, keys, neurons, models=design.stats.series * len(shares))
    return design.replace(scored.drop(ROW_NUMBER, SERIES_ROWS), same_rows=False)


@dataclass(frozen=True)
class Report:
    """Rows with errors; histograms of errors, scores and returns (all, and by regime); calibration; returns by regime; hits by year
    (none if time isn't a date); and one row of ``n``, ``hit_rate``, ``t_stat`` and ``sse``."""

    rows: DataFrame
    residuals: DataFrame
    absolute_residuals: DataFrame
    squared_errors: DataFrame
    scores: DataFrame
    calibration: DataFrame
    conditional_returns: DataFrame
    returns: DataFrame
    returns_by_regime: DataFrame
    hits_by_year: DataFrame | None
    summary: DataFrame


def with_returns(panel: Panel, x: str, horizon: str = "backward", name: str = "change") -> Panel:
    """Add the relative change of ``x``: up to this row (``backward``) or to the next one (``forward``).

    The label of a row is about the next row, so ``forward`` is the return that the score predicts. Add it before rows
    are dropped or split.
    """
    if horizon not in ("backward", "forward"):
        raise ValueError("horizon is 'backward' or 'forward'")
    return panel.roll({name: pct_change(x) if horizon == "backward" else forward_change(x)})


def error_series(scored: Panel) -> Panel:
    """Scored rows with residual, loss, hit flag, and their running sums per series."""
    panel = scored.replace(with_errors(scored.df))
    return cum_sum(panel, {"cum_d": "d", "cum_abs_d": F.abs("d"), "cum_hits": F.col("hit").cast("double")})


def evaluation_report(
    scored: Panel, returns: str = "change", threshold: float = 0.8, bins: int = 20, return_bins: int = 100, regime_bins: int = 8
) -> Report:
    """Everything the evaluation shows. The rows are stored once, since every table below reads them."""
    shared_dir(scored.df.sparkSession)
    rows = error_series(scored).df.checkpoint()
    absolute = rows.withColumn("abs_d", F.abs("d"))
    by_regime = rows.withColumn("regime", regime("p", threshold)).filter("regime IS NOT NULL")
    dated = isinstance(rows.schema[scored.ts].dataType, (T.DateType, T.TimestampType, T.TimestampNTZType))
    return Report(
        rows,
        histogram(rows, "d", bins),
        histogram(absolute, "abs_d", bins),
        histogram(rows, "half_sq", bins),
        histogram(rows, "p", bins),
        calibration(rows, bins=bins),
        conditional_return(rows, "p", returns, threshold),
        histogram(rows, returns, return_bins),
        histogram(by_regime, returns, regime_bins, ["regime"]),
        hits_by_year(rows, scored.ts) if dated else None,
        accuracy_tstat(rows).withColumn("sse", agg_sse(rows).scalar()),
    )
