"""Bringing series together on a common index."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def merge_outer(frames: list[DataFrame], on: list[str]) -> DataFrame:
    """Full outer merge of any number of tables that are each unique on ``on``; gaps become NULL.

    A chain of full outer joins would shuffle the growing result once per table. Stacking the tables and
    grouping by the index needs one shuffle for all of them. A repeated index row is an error, because grouping
    would lose it.
    """
    stacked = reduce(
        lambda a, b: a.unionByName(b, allowMissingColumns=True),
        (f.withColumn(f"_from_{i}", F.lit(1)) for i, f in enumerate(frames)),
    )
    columns = [c for f in frames for c in f.columns if c not in on]
    if len(set(columns)) != len(columns):
        raise ValueError("value columns must have distinct names")
    tags = [f"_from_{i}" for i in range(len(frames))]
    merged = stacked.groupBy(*on).agg(
        *(F.max(c).alias(c) for c in columns), *(F.count(t).alias(t) for t in tags)
    )
    repeated = F.greatest(*tags) > 1 if len(tags) > 1 else F.col(tags[0]) > 1
    checked = F.when(repeated, F.raise_error(F.lit("merge_outer: repeated index row"))).otherwise(F.lit(True))
    return merged.filter(checked.cast("boolean")).drop(*tags)


def align_inner(left: DataFrame, right: DataFrame, on: list[str], results: dict[str, Column]) -> DataFrame:
    """Arithmetic of two series, with distinct value names, on the index rows they share."""
    return left.join(right, on, "inner").select(*on, *(c.alias(name) for name, c in results.items()))


def merge_predictions(labels: DataFrame, scores: DataFrame, hits: DataFrame, returns: DataFrame | None, on: list[str]) -> DataFrame:
    """Labels, scores, hit flags and (optionally) returns on their common index, complete rows only.

    Merging outer and then dropping incomplete rows keeps exactly the common rows, so the joins are inner. All of
    them are on the same key: each table is shuffled once.
    """
    tables = [labels, scores, hits] + ([returns] if returns is not None else [])
    return reduce(lambda a, b: a.join(b, on, "inner"), tables).na.drop("any")


def calendar_days(df: DataFrame, series: list[str], day: str) -> DataFrame:
    """Every calendar day from the first to the last of each series."""
    bounds = df.groupBy(*series).agg(F.min(day).alias("_first"), F.max(day).alias("_last"))
    return bounds.select(*series, F.explode(F.sequence("_first", "_last", F.expr("interval 1 day"))).alias(day))


def calendar_densify(df: DataFrame, series: list[str], day: str) -> DataFrame:
    """Align rows to the dense calendar of their series; days without a row get NULL values."""
    return calendar_days(df, series, day).join(df, [*series, day], "left")
