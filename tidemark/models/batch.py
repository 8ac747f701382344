"""Full-batch gradient descent, data-parallel over rows.

The loss is that of the online fits, half the squared error, but the gradient is summed over all rows before the
weights move. That is another path through weight space than the online update; use it when one model must learn
from more rows than a serial pass can visit. Each epoch is one job: every partition reduces its rows to one gradient
per weight, Spark adds those up, and only the sums reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.models.weights import HIDDEN, OUTPUT, connections

GRADIENT_SCHEMA = "model_id string, layer string, src int, dst int, gradient double"
LOSS = "loss"
#: Weights of the models whose gradients one pass over the rows computes.
WEIGHTS_PER_PASS = 100_000


def _arrays(weights: pd.DataFrame, inputs: int) -> dict[str, tuple[np.ndarray | None, np.ndarray]]:
    """Per model: hidden weights (neuron × input) or None, and output weights."""
    nets = {}
    for model, rows in weights.sort_values(["layer", "dst", "src"]).groupby("model_id"):
        hidden = rows[rows["layer"] == HIDDEN]["weight"].to_numpy(dtype=float)
        output = rows[rows["layer"] == OUTPUT]["weight"].to_numpy(dtype=float)
        nets[str(model)] = (hidden.reshape(-1, inputs) if len(hidden) else None, output)
    return nets


def _partial_gradients(nets: dict, features: list[str], label: str):
    """Per-partition sums, vectorised over the rows of each Arrow batch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = {m: [np.zeros_like(h) if h is not None else None, np.zeros_like(o), 0.0] for m, (h, o) in nets.items()}
        with np.errstate(over="ignore"):
            for batch in batches:
                x, y = batch[features].to_numpy(dtype=float), batch[label].to_numpy(dtype=float)
                for model, (hidden, output) in nets.items():
                    total = sums[model]
                    if hidden is None:
                        inner = x
                        p = 1.0 / (1.0 + np.exp(-(x @ output)))
                    else:
                        h = 1.0 / (1.0 + np.exp(-(x @ hidden.T)))
                        inner = np.column_stack([np.ones(len(x)), h])
                        p = 1.0 / (1.0 + np.exp(-(inner @ output)))
                    e = (p - y) * p * (1.0 - p)
                    if hidden is not None:
                        total[0] += (e[:, None] * output[1:] * h * (1.0 - h)).T @ x
                    total[1] += e @ inner
                    total[2] += 0.5 * float(((y - p) ** 2).sum())
        frames = []
        for model, (hidden, output, loss) in sums.items():
            neurons = 0 if hidden is None else len(hidden)
            inputs = len(features)
            values = np.concatenate([[] if hidden is None else hidden.ravel(), output, [loss]])
            ends = [*connections(inputs, neurons), (LOSS, 0, 0)]
            frame = pd.DataFrame(ends, columns=["layer", "src", "dst"])
            frames.append(frame.assign(model_id=model, gradient=values))
        if frames:
            yield pd.concat(frames)[["model_id", "layer", "src", "dst", "gradient"]]

    return run


def batch_gradient(df: DataFrame, features: list[str], label: str, weights: DataFrame | pd.DataFrame) -> DataFrame:
    """Gradient of half the squared error over all rows, for every model of ``weights``, plus a ``loss`` row each.

    Weights go along with the tasks, for as many models in one pass over the rows as have ``WEIGHTS_PER_PASS`` weights together;
    more models take more passes. Rows with a NULL or NaN feature or label are left out.
    """
    table = weights if isinstance(weights, pd.DataFrame) else _collected(weights)
    nets = _arrays(table, len(features))
    rows = df.select(*features, label).na.drop()
    passes: list[dict] = [{}]
    held = 0
    for model, net in nets.items():
        size = sum(w.size for w in net if w is not None)
        if passes[-1] and held + size > WEIGHTS_PER_PASS:
            passes.append({})
            held = 0
        passes[-1][model] = net
        held += size
    parts = [rows.mapInPandas(_partial_gradients(some, features, label), GRADIENT_SCHEMA) for some in passes]
    partial = reduce(DataFrame.unionByName, parts)
    return partial.groupBy("model_id", "layer", "src", "dst").agg(F.sum("gradient").alias("gradient"))


def _collected(weights: DataFrame) -> pd.DataFrame:
    """The weights on the driver: they are parameters, however many rows there are to learn from."""
    table = weights.select("model_id", "layer", "src", "dst", "weight").toPandas()
    return table.assign(model_id=table["model_id"].astype(str))


def fit_batch(
    df: DataFrame,
    features: list[str],
    label: str,
    init: DataFrame,
    *,
    eta: float = 0.1,
    momentum: float = 0.0,
    epochs: int = 1,
    mean: bool = True,
) -> tuple[pd.DataFrame, pd.DataFrame]:
    """Descend for ``epochs`` jobs; returns weights and loss curve, both of parameter size, on the driver.

    ``mean`` divides the gradient by the number of rows, so that ``eta`` does not depend on how many there are.
    The rows are read once per epoch, so their features are kept in the executors' memory and disk while the fit runs.
    """
    weights = _collected(init)
    df = df.select(*features, label).na.drop().persist()
    keys = ["model_id", "layer", "src", "dst"]
    scale = float(df.count()) if mean else 1.0
    weights["step"] = 0.0
    curve = []
    for epoch in range(1, epochs + 1):
        sums = batch_gradient(df, features, label, weights).toPandas()
        is_loss = sums["layer"] == LOSS
        curve.append(sums[is_loss][["model_id", "gradient"]].rename(columns={"gradient": "sse"}).assign(epoch=epoch))
        weights = weights.merge(sums[~is_loss], on=keys, validate="one_to_one")
        weights["step"] = eta * weights.pop("gradient") / scale + momentum * weights["step"]
        weights["weight"] -= weights["step"]
    df.unpersist()
    return weights[[*keys, "weight"]], pd.concat(curve, ignore_index=True) if curve else pd.DataFrame(columns=["model_id", "sse", "epoch"])
