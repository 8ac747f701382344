"""First principal component of several columns, of all rows or of each series."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.panel import attach

#: States that a task holds before it hands them on.
KEYS_HELD = 20_000


def principal_loadings(df: DataFrame, columns: list[str]) -> dict[str, float]:
    """Unit loadings of the first component; the largest one is positive, which fixes the sign.

    One aggregate gives the covariances of the columns, and only that small matrix is decomposed.
    """
    complete = df.select(*columns).na.drop("any")
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    row = complete.agg(*(F.covar_samp(a, b).alias(f"c{k}") for k, (a, b) in enumerate(pairs))).first()
    matrix = np.zeros((len(columns), len(columns)))
    for (a, b), covariance in zip(pairs, row):
        i, j = columns.index(a), columns.index(b)
        matrix[i, j] = matrix[j, i] = covariance
    vector = np.linalg.eigh(matrix)[1][:, -1]
    vector = vector * np.sign(vector[np.abs(vector).argmax()])
    return dict(zip(columns, vector.tolist()))


def principal_component(df: DataFrame, columns: list[str], name: str = "pc1") -> DataFrame:
    """Add the score on the first component (columns as they are, neither centred nor scaled)."""
    total: Column | None = None
    for column, loading in principal_loadings(df, columns).items():
        part = F.col(column) * F.lit(loading)
        total = part if total is None else total + part
    return df.withColumn(name, total)


class _States:
    """Per key the count, the mean and the products of distances to it; any two add up without loss of digits."""

    def __init__(self) -> None:
        self.held: dict[tuple, tuple[float, np.ndarray, np.ndarray]] = {}

    def add(self, key: tuple, n: float, mean: np.ndarray, products: np.ndarray) -> None:
        if key in self.held:
            n0, mean0, products0 = self.held[key]
            d, total = mean - mean0, n0 + n
            products = products0 + products + np.outer(d, d) * (n0 * n / total)
            mean, n = mean0 + d * (n / total), total
        self.held[key] = n, mean, products


def _key(values: tuple) -> tuple:
    return tuple(None if pd.isna(v) else v for v in values)


def principal_loadings_by(df: DataFrame, columns: list[str], by: list[str]) -> DataFrame:
    """Unit loadings of the first component of every series, as an array in the order of ``columns``; NULL keys are a series.

    Each partition reduces its rows to one matrix per series, a shuffle by series adds those up, and a task decomposes the matrices that it
    has got all at once. The largest loading is positive, the first of equal ones. Rows with a missing value are left out; a series of
    fewer than two rows, or of equal rows only, has NULL loadings.
    """
    k = len(columns)
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    keys = ", ".join(f"`{c}` {kinds[c]}" for c in by)

    def reduced(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        states = _States()
        for batch in batches:
            for key, part in batch.groupby(by, sort=False, dropna=False):
                x = part[columns].to_numpy(float)
                mean = x.mean(axis=0)
                states.add(_key(key), float(len(x)), mean, (x - mean).T @ (x - mean))
            if len(states.held) > KEYS_HELD:
                yield as_rows(states)
                states = _States()
        if states.held:
            yield as_rows(states)

    def as_rows(states: _States) -> pd.DataFrame:
        frame = pd.DataFrame(list(states.held), columns=by)
        n, mean, products = zip(*states.held.values())
        return frame.assign(_n=n, _mean=list(mean), _products=[p.ravel() for p in products])

    def decomposed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        states = _States()
        for batch in batches:
            for *key, n, mean, products in batch[[*by, "_n", "_mean", "_products"]].itertuples(index=False, name=None):
                states.add(_key(tuple(key)), n, mean, products.reshape(k, k))
        if states.held:
            matrices = np.stack([p for _, _, p in states.held.values()])
            vectors = np.linalg.eigh(matrices)[1][:, :, -1]
            largest = np.abs(vectors).argmax(axis=1)
            vectors *= np.sign(vectors[np.arange(len(vectors)), largest])[:, None]
            known = [n >= 2 and p.any() for n, _, p in states.held.values()]
            yield pd.DataFrame(list(states.held), columns=by).assign(loadings=[v if ok else None for v, ok in zip(vectors, known)])

    complete = df.select(*dict.fromkeys([*by, *columns])).na.drop("any", subset=columns)
    states = complete.mapInPandas(reduced, f"{keys}, _n double, _mean array<double>, _products array<double>")
    return states.repartition(*by).mapInPandas(decomposed, f"{keys}, loadings array<double>")


def principal_component_by(df: DataFrame, columns: list[str], by: list[str], name: str = "pc1", series: int | None = None) -> DataFrame:
    """Add the score on the first component of the row's series. ``series``, if known, saves counting them."""
    loadings = principal_loadings_by(df, columns, by).withColumnRenamed("loadings", "_loadings")
    if series is None:
        series = df.select(*by).distinct().count()
    products = F.zip_with(F.array(*(F.col(c).cast("double") for c in columns)), "_loadings", lambda x, w: x * w)
    score = F.aggregate(products, F.lit(0.0), lambda total, x: total + x)
    return attach(df, loadings, by, series * (len(columns) + 8) // 8).withColumn(name, score).drop("_loadings")
