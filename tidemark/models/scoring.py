"""Forward passes.

A score is row-local, so it also applies to a streaming DataFrame. Nets of up to ``EXPRESSION_WEIGHTS`` weights become plain column
arithmetic: the weights of one model are literals, those of a model by key are joined as columns. Larger nets would make
expressions that cost far more than the arithmetic in them; their rows go through matrix products on Arrow batches. The weights of
many models are sent along with the tasks while they are few enough, and beyond that are joined as one array per row.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.scalars import sigmoid
from tidemark.models.weights import HIDDEN, OUTPUT, connections
from tidemark.panel import attach

#: A net with more weights is applied as a matrix product.
EXPRESSION_WEIGHTS = 64
#: Weights of all models together (eight bytes each) that are sent to the tasks; more are joined to the rows.
SENT_WEIGHTS = 4_000_000
#: A single model may have no more weights than this.
MODEL_WEIGHTS = 1_000_000

Net = dict[tuple[str, int, int], float]


def read_net(weights: DataFrame) -> Net:
    """The weights of one model on the driver. Refuses anything that is not one model."""
    rows = weights.select("layer", "src", "dst", "weight").limit(MODEL_WEIGHTS + 1).collect()
    net = {(r["layer"], r["src"], r["dst"]): r["weight"] for r in rows}
    if len(rows) > MODEL_WEIGHTS or len(net) != len(rows):
        raise ValueError("expected the weights of a single model; use score_by_key for many")
    return net


def neurons_of(net) -> int:
    """Number of hidden neurons, 0 for a perceptron."""
    return max((dst for layer, _, dst in net if layer == HIDDEN), default=0)


def weights_apply(features: list[str], weight: Callable[[int], Column]) -> Column:
    """Row vector times one weight column."""
    return reduce(add, (F.col(f) * weight(j) for j, f in enumerate(features)))


def forward(features: list[str], neurons: int, weight: Callable[[str, int, int], Column]) -> Column:
    """Score of a net whose weights are given as column expressions."""
    if neurons == 0:
        return sigmoid(weights_apply(features, lambda j: weight(OUTPUT, j, 0)))
    total = weight(OUTPUT, 0, 0)
    for n in range(1, neurons + 1):
        hidden = sigmoid(weights_apply(features, lambda j, n=n: weight(HIDDEN, j, n)))
        total = total + hidden * weight(OUTPUT, n, 0)
    return sigmoid(total)


def _product(x: np.ndarray, weights: np.ndarray, neurons: int) -> np.ndarray:
    """Scores of rows by one model (a vector of weights) or by one each (a matrix), in the order of ``connections``."""
    inputs = x.shape[1]
    cut = neurons * inputs
    with np.errstate(over="ignore"):
        if neurons:
            shape = (*weights.shape[:-1], neurons, inputs)
            z = np.matmul(weights[..., :cut].reshape(shape), x[:, :, None])[:, :, 0] if weights.ndim == 2 else x @ weights[:cut].reshape(shape).T
            hidden = 1.0 / (1.0 + np.exp(-z))
            total = weights[..., cut] + (hidden * weights[..., cut + 1 :]).sum(axis=1)
        else:
            total = (x * weights).sum(axis=1)
        return 1.0 / (1.0 + np.exp(-total))


def _matrix(columns: tuple[pa.Array, ...]) -> np.ndarray:
    return np.column_stack([c.cast(pa.float64()).to_numpy(zero_copy_only=False) for c in columns]).astype(float)


def _by_model(x: np.ndarray, model: np.ndarray, weights: np.ndarray, neurons: int) -> np.ndarray:
    """Scores where ``model`` names a row of ``weights``; NaN where it is negative."""
    p = np.full(len(x), np.nan)
    order = np.argsort(model, kind="stable")
    order = order[model[order] >= 0]
    starts = np.flatnonzero(np.diff(model[order], prepend=-1))
    if len(order) >= 8 * len(starts):
        for rows in np.split(order, starts[1:]):
            if len(rows):
                p[rows] = _product(x[rows], weights[model[rows[0]]], neurons)
    else:
        for at in range(0, len(order), 1024):
            rows = order[at : at + 1024]
            p[rows] = _product(x[rows], weights[model[rows]], neurons)
    return p


def score(df: DataFrame, features: list[str], net: Net | DataFrame, name: str = "p") -> DataFrame:
    """Add the score of one model; ``features`` starts with the intercept column. A NULL feature gives NULL."""
    net = read_net(net) if isinstance(net, DataFrame) else net
    neurons = neurons_of(net)
    if len(net) <= EXPRESSION_WEIGHTS:
        return df.withColumn(name, forward(features, neurons, lambda *c: F.lit(net[c])))
    weights = np.array([net[c] for c in connections(len(features), neurons)])

    @F.arrow_udf(T.DoubleType())
    def apply(*columns: pa.Array) -> pa.Array:
        return pa.array(_product(_matrix(columns), weights, neurons), from_pandas=True)

    return df.withColumn(name, apply(*features))


mlp_score = score
plr_score = score


def score_by_key(
    df: DataFrame, features: list[str], weights: DataFrame, on: list[str], neurons: int = 0, name: str = "p",
    models: int | None = None,
) -> DataFrame:
    """Add the score of the model that belongs to each row's key (NULL is a key); rows without a model get NULL.

    ``models``, if known, saves counting them. A key has one model.
    """
    order = connections(len(features), neurons)
    if len(order) <= EXPRESSION_WEIGHTS:
        label = {c: f"_{c[0]}_{c[1]}_{c[2]}" for c in order}
        pick = [
            F.max(F.when((F.col("layer") == a) & (F.col("src") == s) & (F.col("dst") == d), F.col("weight"))).alias(label[a, s, d])
            for a, s, d in label
        ]
        wide = weights.groupBy(*on).agg(*pick)
        rows = wide.count() if models is None else models
        joined = attach(df, wide, on, max(1, rows * len(label) // 8))
        return joined.withColumn(name, forward(features, neurons, lambda *c: F.col(label[c]))).drop(*label.values())

    # At most one entry for each connection, so the list of a model is bounded by its shape.
    place = F.when(F.col("layer") == HIDDEN, (F.col("dst") - 1) * len(features) + F.col("src")).otherwise(neurons * len(features) + F.col("src"))
    entries = F.array_sort(F.collect_list(F.struct(place.alias("place"), "weight")))
    wide = weights.groupBy(*on).agg(F.transform(entries, lambda x: x["weight"]).alias("_weights"))
    if models is None:
        models = wide.count()
    if models * len(order) <= SENT_WEIGHTS:
        table = wide.toArrow()
        matrix = np.array(table.column("_weights").to_pylist(), float).reshape(table.num_rows, len(order))
        numbered = table.drop_columns(["_weights"]).append_column("_model", pa.array(range(table.num_rows), pa.int32()))
        keys = df.sparkSession.createDataFrame(numbered, weights.select(*on).schema.add("_model", T.IntegerType()))
        sent = df.sparkSession.sparkContext.broadcast(matrix)

        @F.arrow_udf(T.DoubleType())
        def look_up(model: pa.Array, *columns: pa.Array) -> pa.Array:
            numbers = model.fill_null(-1).to_numpy(zero_copy_only=False)
            return pa.array(_by_model(_matrix(columns), numbers, sent.value, neurons), from_pandas=True)

        return attach(df, keys, on, models).withColumn(name, look_up("_model", *features)).drop("_model")

    @F.arrow_udf(T.DoubleType())
    def joined(own: pa.Array, *columns: pa.Array) -> pa.Array:
        x, p, given = _matrix(columns), np.full(len(own), np.nan), own.is_valid().to_numpy(zero_copy_only=False)
        matrix = own.drop_null().flatten().to_numpy(zero_copy_only=False).reshape(-1, len(order))
        rows = np.flatnonzero(given)
        for at in range(0, len(rows), 1024):
            p[rows[at : at + 1024]] = _product(x[rows[at : at + 1024]], matrix[at : at + 1024], neurons)
        return pa.array(p, from_pandas=True)

    return attach(df, wide, on, models * len(order) // 8).withColumn(name, joined("_weights", *features)).drop("_weights")
