"""Choosing rows and columns, and splitting a series by time."""

from __future__ import annotations

import datetime as dt
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalars import ColumnLike, as_column, finite_or_null, round_even
from tidemark.panel import ROW_NUMBER, SERIES_ROWS, Panel


def select_cols(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*columns)


def rename_cols(df: DataFrame, names: dict[str, str]) -> DataFrame:
    return df.withColumnsRenamed(names)


def add_intercept(df: DataFrame, name: str = "x_0") -> DataFrame:
    return df.withColumn(name, F.lit(1.0))


def as_series(panel: Panel, columns: list[str]) -> DataFrame:
    """The canonical form: key columns, row number ``rn`` (from 1 within the series), values."""
    return panel.numbered().rows.select(*panel.keys, F.col(ROW_NUMBER).alias("rn"), *columns)


def time_order(df: DataFrame, order: list[str]) -> DataFrame:
    """Global sort, for a sink; operators carry their own order."""
    return df.orderBy(*order)


def row_range(panel: Panel, first: int, last: int) -> DataFrame:
    """Rows ``first`` to ``last`` of every series, both included."""
    return panel.numbered().rows.filter(F.col(ROW_NUMBER).between(first, last)).drop(ROW_NUMBER, SERIES_ROWS)


def time_range(df: DataFrame, ts: str, start=None, end=None, warmup: dt.timedelta | None = None) -> DataFrame:
    """Rows from ``start`` to ``end``, both included, either one open.

    Applied before the windows it reaches the scan, and indicators then start afresh at ``start``; applied
    after them it keeps the values they have over the full history. To have both, filter before with a ``warmup``
    that covers the reach of the indicators and again after without it.
    """
    kind = df.schema[ts].dataType

    def bound(value) -> Column:
        # As text, so that a naive time means the same whatever the session's time zone.
        return F.lit(str(value) if isinstance(value, dt.date) else value).cast(kind)

    bounds: list[Column] = []
    if start is not None:
        bounds.append(F.col(ts) >= bound(start - warmup if warmup is not None else start))
    if end is not None:
        bounds.append(F.col(ts) <= bound(end))
    return df.filter(reduce(and_, bounds)) if bounds else df


def drop_null(df: DataFrame, column: str) -> DataFrame:
    return df.filter(F.col(column).isNotNull())


def complete_cases(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Rows without NULL or NaN in the given (default: all) columns."""
    return df.na.drop("any", subset=columns)


def normalise_missing(df: DataFrame, columns: list[str]) -> DataFrame:
    """NaN and infinities of the given columns to NULL."""
    return df.withColumns({c: finite_or_null(c) for c in columns})


def any_null(df: DataFrame, columns: list[str], name: str = "has_null") -> DataFrame:
    """One row that says whether any cell of the columns is NULL."""
    missing = reduce(or_, (F.col(c).isNull() for c in columns))
    return df.agg(F.coalesce(F.bool_or(missing), F.lit(False)).alias(name))


def series_bounds(df: DataFrame, series: list[str], ts: str) -> DataFrame:
    return df.groupBy(*series).agg(F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"))


def regime(p: ColumnLike, threshold: float) -> Column:
    """``up`` above the threshold, ``down`` below one minus it, ``middle`` between, bounds included."""
    if not 0.5 <= threshold < 1:
        raise ValueError("threshold lies in [0.5, 1)")
    p = as_column(p)
    low = F.lit(1.0) - F.lit(float(threshold))
    return F.when(p > threshold, "up").when(p < low, "down").when(p.isNotNull(), "middle")


def threshold_filter(df: DataFrame, p: str, threshold: float, keep: str) -> DataFrame:
    """Rows of one regime; see ``regime``."""
    return df.filter(regime(p, threshold) == keep)


def confident(p: ColumnLike, extreme: float) -> Column:
    p = as_column(p)
    return (p > F.lit(1.0) - F.lit(float(extreme))) | (p < extreme)


def extreme_filter(df: DataFrame, p: str, extreme: float = 0.2) -> DataFrame:
    """Rows whose score lies within ``extreme`` of 0 or 1."""
    return df.filter(confident(p, extreme))


def chrono_split(panel: Panel, shares: dict[str, float], rest: str = "test", name: str = "split") -> Panel:
    """Name consecutive parts of each series, oldest rows first.

    ``shares`` gives the cumulative end of each part as a share of the series: ``{'train': 0.3}`` or
    ``{'setup': 0.1, 'train': 0.4}``. Ends are rounded half to even; what remains is ``rest``.
    """
    panel = panel.numbered()
    part = F
    for label, share in sorted(shares.items(), key=lambda item: item[1]):
        end = round_even(F.col(SERIES_ROWS).cast("double") * F.lit(float(share)))
        part = part.when(F.col(ROW_NUMBER) <= end, label)
    return panel.with_columns({name: part.otherwise(rest)})
