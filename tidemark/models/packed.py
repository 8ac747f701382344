"""Weights as one array per model, the form in which fits move them; the long table of ``models.weights`` is the form to read.

The order within an array is that of ``connections``: hidden weights by neuron and input, then output weights.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.models.weights import HIDDEN, OUTPUT


def is_packed(weights: DataFrame) -> bool:
    return "weights" in weights.columns


def pack(weights: DataFrame, ids: list[str], settings: list[str] = ()) -> DataFrame:
    """One row per model: ``ids``, ``settings`` (equal in all rows of a model), ``neurons`` and ``weights``. Packed tables stay as they are."""
    if is_packed(weights):
        return weights.select(*ids, *settings, F.col("neurons").cast("int").alias("neurons"), F.col("weights").cast("array<double>").alias("weights"))
    cell = F.struct("layer", F.col("dst").cast("int").alias("dst"), F.col("src").cast("int").alias("src"), F.col("weight").cast("double").alias("weight"))
    packed = weights.groupBy(*ids).agg(
        *(F.any_value(c).alias(c) for c in settings),
        F.max(F.col("dst").cast("int")).alias("neurons"),
        F.transform(F.array_sort(F.collect_list(cell)), lambda c: c["weight"]).alias("weights"),
    )
    return packed.select(*ids, *settings, "neurons", "weights")


def unpack(packed: DataFrame, ids: list[str], inputs: int) -> DataFrame:
    """The long table: one row per connection."""
    rows = packed.select(*ids, "neurons", F.posexplode("weights").alias("_at", "weight"))
    at, cut = F.col("_at"), F.col("neurons") * inputs
    hidden = at < cut

    def where(inside: Column, outside: Column) -> Column:
        return F.when(hidden, inside).otherwise(outside).cast("int")

    return rows.select(
        *ids,
        F.when(hidden, F.lit(HIDDEN)).otherwise(F.lit(OUTPUT)).alias("layer"),
        where(at % inputs, at - cut).alias("src"),
        where(F.floor(at / inputs) + 1, F.lit(0)).alias("dst"),
        "weight",
    )
