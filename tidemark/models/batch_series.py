"""Full-batch descent of many models of many series at once, with nothing but sums between the tasks.

Rows are dealt once to places of bounded size, whatever series they belong to; a series with many rows is in many places. A place keeps
its rows as matrices. Neighbouring places make a part, which is what a task takes at once: however small the places are, there are no more parts than
the rows ask for. In each epoch the models travel to the parts that hold rows of their series, every part gives one gradient per model, and one
shuffle by model adds them up and moves the weights, which stay a distributed table of one array per model. So neither a series nor
the weights of all models pass through one task or the driver, rows are never copied for a model, and an epoch is one job.

The loss is that of the online fits; the path through weight space is that of full-batch descent with momentum.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import pairwise
from operator import and_

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.models.online import COLUMNS, WEIGHT, Fit
from tidemark.models.packed import pack
from tidemark.models.search import best_trial, trials_of
from tidemark.models.weights import random_arrays
from tidemark.operators.selection import complete_cases
from tidemark.panel import Panel, attach
from tidemark.session import remove, shared_path

ROWS_PER_PLACE = 100_000
#: Rows of the places that are worked on together.
ROWS_PER_PART = 100_000
#: Numbers in the largest array of a gradient: rows are taken in pieces so that models x rows x neurons stay below.
CELLS = 4_000_000
#: Weights of the models that one task adds up.
WEIGHTS_PER_TASK = 4_000_000
MODELS_PER_TASK = 50_000


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-z))


def gradients(x: np.ndarray, y: np.ndarray, weights: np.ndarray, neurons: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gradient (model, weight), half squared error and hits of models of one shape, summed over the rows."""
    models, inputs = len(weights), x.shape[1]
    sums, sse, hits = np.zeros_like(weights), np.zeros(models), np.zeros(models, np.int64)
    cut = neurons * inputs
    step = max(1, CELLS // (models * max(1, neurons)))
    with np.errstate(over="ignore"):
        for at in range(0, len(x), step):
            rows, target = x[at : at + step], y[at : at + step]
            if neurons:
                h = _sigmoid(rows @ weights[:, :cut].reshape(-1, inputs).T).reshape(len(rows), models, neurons)
                output = weights[:, cut:]
                p = _sigmoid(output[:, 0] + np.einsum("rmn,mn->rm", h, output[:, 1:]))
            else:
                p = _sigmoid(rows @ weights.T)
            e = (p - target[:, None]) * p * (1.0 - p)
            if neurons:
                slope = e[:, :, None] * output[:, 1:] * h * (1.0 - h)
                sums[:, :cut] += (slope.reshape(len(rows), -1).T @ rows).reshape(models, cut)
                sums[:, cut] += e.sum(axis=0)
                sums[:, cut + 1 :] += np.einsum("rm,rmn->mn", e, h)
            else:
                sums += e.T @ rows
            sse += 0.5 * ((target[:, None] - p) ** 2).sum(axis=0)
            hits += ((p >= 0.5) == (target[:, None] >= 0.5)).sum(axis=0)
    return sums, sse, hits


def placed(panel: Panel, features: list[str], label: str, rows_per_place: int = ROWS_PER_PLACE) -> tuple[DataFrame, int]:
    """Stored blocks (`_part`, `_place`, series, `_n`, `_x`, `_y`), one for each place and series in it, and the number of places.

    A row's place follows from its keys, so a repeated task deals it alike. The places of a series are neighbours.
    """
    spark = panel.df.sparkSession
    places = max(spark.sparkContext.defaultParallelism, -(-panel.stats.rows // rows_per_place))
    rows = panel.df.select(*dict.fromkeys([*panel.keys, *features, label]))
    first = F.pmod(F.xxhash64(*panel.series), F.lit(places))
    shift = F.lit(0)
    if panel.stats.longest > rows_per_place:
        lengths = rows.groupBy(*panel.series).agg(F.ceil(F.count(F.lit(1)) / rows_per_place).alias("_spread"))
        rows = attach(rows, lengths, panel.series, panel.stats.series)
        shift = F.pmod(F.xxhash64(F.lit(1), *(F.col(c) for c in panel.order)), F.col("_spread"))
    rows = rows.withColumn("_place", F.pmod(first + shift, F.lit(places)).cast("int"))
    rows = rows.withColumn("_part", F.floor(F.col("_place").cast("long") * parts_of(panel, places) / places).cast("int"))
    series = [F.col(c) for c in panel.series]
    schema = rows.select("_part", "_place", *series, F.lit(0).cast("long").alias("_n"), F.array().cast("array<double>").alias("_x"), F.array().cast("array<double>").alias("_y")).schema
    names = panel.series

    def as_blocks(part: pd.DataFrame) -> pd.DataFrame:
        order, cuts = _groups(part, ["_place", *names])
        x, y = part[features].to_numpy(float)[order], part[label].to_numpy(float)[order]
        heads = part[["_part", "_place", *names]].iloc[order[np.concatenate([[0], cuts])]]
        return heads.assign(_n=np.diff([0, *cuts, len(part)]), _x=[a.ravel() for a in np.split(x, cuts)], _y=np.split(y, cuts))

    path = shared_path(spark, "blocks")
    rows.select("_part", "_place", *names, *dict.fromkeys([*features, label])).groupBy("_part").applyInPandas(as_blocks, schema).write.parquet(path)
    return spark.read.schema(schema).parquet(path), places


def parts_of(panel: Panel, places: int) -> int:
    """Parts that the places are put together to."""
    return min(places, max(panel.df.sparkSession.sparkContext.defaultParallelism, -(-panel.stats.rows // ROWS_PER_PART)))


def _groups(frame: pd.DataFrame, by: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The order that puts equal rows next to each other, and where in it a group begins, but for the first."""
    code = frame.groupby(by, sort=False, dropna=False).ngroup().to_numpy()
    order = np.argsort(code, kind="stable")
    return order, np.flatnonzero(np.diff(code[order])) + 1


def _same(left: list[str], right: list[str]):
    return reduce(and_, (F.col(a).eqNullSafe(F.col(b)) for a, b in zip(left, right)))


def fit_batch_by_series(
    panel: Panel,
    features: list[str],
    label: str,
    init: DataFrame,
    *,
    eta: float | None = 0.1,
    momentum: float | None = 0.0,
    epochs: int | None = 1,
    mean: bool = True,
    rows_per_place: int = ROWS_PER_PLACE,
) -> Fit:
    """Fit every model of ``init`` (long or packed, with the series columns and ``model_id``) on all rows of its series.

    ``eta``, ``momentum`` and ``epochs`` may be ``None`` to be read from columns of ``init``. ``mean`` divides the gradient by the rows of
    the series. Rows with a NULL or NaN feature or label are left out; a model of a series without rows keeps its weights. The curve
    has, per epoch, what the weights before its step cost.
    """
    spark = panel.df.sparkSession
    panel = panel.subset(complete_cases(panel.df, [*features, label]))
    names, ids = panel.series, [*panel.series, "model_id"]
    given = {"eta": eta, "momentum": momentum, "epochs": epochs}
    models = pack(init, ids, [k for k, v in given.items() if v is None])
    blocks, places = placed(panel, features, label, rows_per_place)
    lengths = blocks.groupBy(*names).agg(F.sum("_n").alias("_length"))
    models = attach(models, lengths, names, panel.stats.series)
    values = {k: (F.lit(v) if v is not None else F.col(k)) for k, v in given.items()} | {
        "kind": F.lit(WEIGHT), "neurons": F.col("neurons"), "weights": F.col("weights"), "steps": F.transform("weights", lambda w: F.lit(0.0)),
        "done": F.lit(0), "length": F.coalesce("_length", F.lit(0)), "sse": F.array(), "hits": F.array(), "numbers": F.array(),
    }
    state = models.select(*ids, *(values[c].cast(t).alias(c) for c, t in COLUMNS.items()))
    columns, schema = state.columns, state.schema
    path = shared_path(spark, "models")
    state.write.parquet(path)
    state = spark.read.schema(schema).parquet(path)
    size = state.agg(F.max("epochs").alias("epochs"), F.sum(F.size("weights")).alias("weights"), F.count(F.lit(1)).alias("models")).first()
    tasks = max(spark.sparkContext.defaultParallelism, -(-(size["weights"] or 0) // WEIGHTS_PER_TASK), -(-size["models"] // MODELS_PER_TASK))

    # Read once per epoch: kept by the executors, and read again from the stored blocks where one of them is lost.
    held = blocks.repartition(parts_of(panel, places), "_part").persist()
    # Fresh column identities keep the two sides of the cogroup apart.
    spots = blocks.select(F.col("_part").alias("_part"), *(F.col(c).alias(f"_at_{c}") for c in names)).distinct().persist()
    types = {f.name: f.dataType.simpleString() for f in schema.fields}
    partial = ", ".join(f"`{c}` {types[c]}" for c in ids) + ", _gradient array<double>, _sse double, _hits long"
    inputs = len(features)

    def partials(rows: pd.DataFrame, nets: pd.DataFrame) -> pd.DataFrame:
        found = {c: [] for c in ["_gradient", "_sse", "_hits"]}
        if not len(nets) or not len(rows):
            return pd.DataFrame({c: [] for c in [*ids, *found]})
        # Models of one series and shape, with their sums over the blocks of the part.
        order, cuts = _groups(nets, [*names, "neurons"])
        nets = nets.iloc[order]
        weights = nets["weights"].to_list()
        keys = list(nets[names].itertuples(index=False, name=None))
        fleets: dict[tuple, list] = {}
        every = []
        for at, stop in pairwise([0, *cuts, len(nets)]):
            fleet = [int(nets["neurons"].iat[at]), np.stack(weights[at:stop]), 0.0, 0.0, 0]
            fleets.setdefault(_key(keys[at]), []).append(fleet)
            every.append(fleet)
        for key, x, y in zip(rows[names].itertuples(index=False, name=None), rows["_x"], rows["_y"]):
            for fleet in fleets.get(_key(key), ()):
                sums, sse, hits = gradients(x.reshape(-1, inputs), y, fleet[1], fleet[0])
                fleet[2], fleet[3], fleet[4] = fleet[2] + sums, fleet[3] + sse, fleet[4] + hits
        for *_, sums, sse, hits in every:
            found["_gradient"] += list(sums)
            found["_sse"] += list(sse)
            found["_hits"] += list(hits)
        return nets[ids].assign(**found)

    def moved(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        nets: dict[tuple, dict] = {}
        sums: dict[tuple, list] = {}
        for batch in batches:
            for row in batch.to_dict("records"):
                key = _key(tuple(row[c] for c in ids))
                if row["kind"] is not None:
                    nets[key] = row
                elif key in sums:
                    total = sums[key]
                    total[0] = total[0] + row["_gradient"]
                    total[1], total[2] = total[1] + row["_sse"], total[2] + row["_hits"]
                else:
                    sums[key] = [row["_gradient"], row["_sse"], row["_hits"]]
        for key, row in nets.items():
            gradient, sse, hits = sums[key]
            row["steps"] = row["eta"] * gradient / (row["length"] if mean else 1.0) + row["momentum"] * row["steps"]
            row["weights"] = row["weights"] - row["steps"]
            row["sse"], row["hits"] = np.append(row["sse"], sse), np.append(row["hits"], int(hits))
        if nets:
            yield pd.DataFrame(list(nets.values()))[columns]

    for epoch in range(size["epochs"] or 0):
        busy = state.filter((F.col("epochs") > epoch) & (F.col("length") > 0))
        idle = state.filter((F.col("epochs") <= epoch) | (F.col("length") == 0))
        copies = busy.select(*ids, "neurons", "weights").join(spots, _same(names, [f"_at_{c}" for c in names])).select("_part", *ids, "neurons", "weights")
        parts = held.groupBy("_part").cogroup(copies.groupBy("_part")).applyInPandas(partials, partial)
        both = busy.unionByName(parts, allowMissingColumns=True).repartition(tasks, *ids)
        before, path = path, shared_path(spark, "models")
        both.mapInPandas(moved, schema).unionByName(idle).write.parquet(path)
        state = spark.read.schema(schema).parquet(path)
        remove(spark, before)
    held.unpersist()
    spots.unpersist()
    return Fit(state, ids, inputs)


def _key(values: tuple) -> tuple:
    return tuple(None if pd.isna(v) else v for v in values)


def restart_search_batch(
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
    **options,
) -> tuple[DataFrame, Fit]:
    """Best of many random starts of every series, all trained by full-batch descent; returns the best trials and all fits.

    Unlike ``restart_search`` no task needs the rows of a series, so it suits series of any length.
    """
    if init is None:
        init = random_arrays(trials_of(panel.df.select(*panel.series).distinct(), trials), len(features), neurons, sd, seed)
    fit = fit_batch_by_series(panel, features, label, init, eta=eta, momentum=momentum, epochs=epochs, **options)
    return best_trial(fit.curve, panel.series), fit
