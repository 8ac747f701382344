"""Indicators that read a fixed number of neighbouring rows.

A ``Rolling`` knows how many rows it looks back and ahead and how to write itself in terms of a few window
columns. Because the reach is declared, ``Panel.roll`` can evaluate the same indicator over whole series or
over slices of a very long one, and because the window columns are asked for by name, indicators that need the
same lag or mean share it. ``shift`` moves the whole expression that many rows back, which is what lets "the
change of a moving average" be one window instead of two stages.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidemark.functions.scalars import ColumnLike, as_column, binary_flag, ratio, safe_ln

#: Means of the same rows can differ by rounding. Differences up to this share of a mean are taken as none.
FLAT = 1e-12


class WindowColumns:
    """The distinct window columns that a set of indicators asks for."""

    def __init__(self) -> None:
        self._asked: dict[tuple, tuple[str, Callable[[WindowSpec], Column]]] = {}

    def get(self, kind: str, x: ColumnLike, at: tuple[int, ...], write: Callable[[WindowSpec], Column]) -> Column:
        source = x if isinstance(x, str) else id(x)
        name, _ = self._asked.setdefault((kind, source, at), (f"_window_{len(self._asked)}", write))
        return F.col(name)

    def add_to(self, df: DataFrame, w: WindowSpec, running: dict[str, Column]) -> DataFrame:
        from_start = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        own = [write(w).alias(name) for name, write in self._asked.values()]
        return df.select("*", *own, *(c.over(from_start).alias(name) for name, c in running.items()))

    def names(self) -> list[str]:
        return [name for name, _ in self._asked.values()]


@dataclass(frozen=True)
class Rolling:
    back: int
    ahead: int
    at: Callable[[WindowColumns, int], Column]

    def lagged(self, k: int) -> Rolling:
        """The same indicator ``k`` rows earlier; a negative ``k`` looks ahead."""
        return Rolling(max(self.back + k, 0), max(self.ahead - k, 0), lambda w, s: self.at(w, s + k))


def add_rolling(
    df: DataFrame, w: WindowSpec, indicators: dict[str, Rolling], running: dict[str, Column] | None = None
) -> DataFrame:
    """Add the indicators for an ordered window, and aggregates ``running`` from the first row to the current one.

    One window operator computes what is asked for, once; what follows is row-local arithmetic.
    """
    asked = WindowColumns()
    results = {name: r.at(asked, 0) for name, r in indicators.items()}
    return asked.add_to(df, w, running or {}).withColumns(results).drop(*asked.names())


def combine(fn: Callable[..., Column], *parts: Rolling) -> Rolling:
    """Apply a row-local function to several indicators of the same row."""
    return Rolling(
        max(p.back for p in parts),
        max(p.ahead for p in parts),
        lambda w, s: fn(*(p.at(w, s) for p in parts)),
    )


def value(x: ColumnLike) -> Rolling:
    column = as_column(x)

    def at(w: WindowColumns, shift: int) -> Column:
        if shift == 0:
            return column
        if shift > 0:
            return w.get("lag", x, (shift,), lambda spec: F.lag(column, shift).over(spec))
        return w.get("lead", x, (-shift,), lambda spec: F.lead(column, -shift).over(spec))

    return Rolling(0, 0, at)


def lag_k(x: ColumnLike, k: int = 1) -> Rolling:
    return value(x).lagged(k)


def diff_1(x: ColumnLike) -> Rolling:
    return combine(lambda now, before: now - before, value(x), lag_k(x))


def pct_change(x: ColumnLike) -> Rolling:
    """Change over the previous value; NULL where that value is zero."""
    return combine(lambda now, before: ratio(now - before, before), value(x), lag_k(x))


def log_return(of: ColumnLike | Rolling, k: int = 1, factor: float = 100.0) -> Rolling:
    """``factor`` times the log difference to ``k`` rows earlier, of a column or an indicator."""
    of = of if isinstance(of, Rolling) else value(of)
    return combine(lambda now, before: factor * (safe_ln(now) - safe_ln(before)), of, of.lagged(k))


def roc_n(x: ColumnLike, n: int = 5) -> Rolling:
    """Continuous rate of change over ``n`` rows."""
    return log_return(x, n, 1.0)


def sma_n(x: ColumnLike, n: int) -> Rolling:
    """Mean of the last ``n`` rows; NULL unless all of them are there and none is NULL."""
    column = as_column(x)

    def at(w: WindowColumns, shift: int) -> Column:
        reach = (1 - n - shift, -shift)
        present = w.get("count", x, reach, lambda spec: F.count(column).over(spec.rowsBetween(*reach)))
        mean = w.get("avg", x, reach, lambda spec: F.avg(column).over(spec.rowsBetween(*reach)))
        return F.when(present == n, mean)

    return Rolling(n - 1, 0, at)


def wma_n(x: ColumnLike, n: int) -> Rolling:
    """Linearly weighted mean: the newest row weighs ``n``, the oldest 1."""
    parts = [lag_k(x, i) for i in range(n)]

    def weighted(*values: Column) -> Column:
        total = values[0] * n
        for i, v in enumerate(values[1:], start=1):
            total = total + v * (n - i)
        return total / (n * (n + 1) / 2)

    return combine(weighted, *parts)


def cci_n(x: ColumnLike, n: int = 15, c: float = 0.015) -> Rolling:
    """Distance from the mean of the last ``n`` rows in units of their mean absolute deviation."""
    parts = [sma_n(x, n)] + [lag_k(x, i) for i in range(n)]

    def channel(mean: Column, *values: Column) -> Column:
        deviation = F.abs(values[0] - mean)
        for v in values[1:]:
            deviation = deviation + F.abs(v - mean)
        # On a flat stretch the mean may differ from the values by a rounding error; that is no deviation.
        return F.when(deviation > FLAT * F.abs(mean), (values[0] - mean) / (c / n * deviation))

    return combine(channel, *parts)


def sma_spread(x: ColumnLike, fast: int = 5, slow: int = 10) -> Rolling:
    return combine(lambda f, s: f - s, sma_n(x, fast), sma_n(x, slow))


def sma_signal(x: ColumnLike, fast: int = 5, slow: int = 10) -> Rolling:
    """1 while the fast mean is above the slow one by more than rounding (``FLAT`` of the slow mean), else 0.

    The comparison is relative, so it means the same at any scale of the values.
    """
    return combine(lambda f, s: binary_flag(f - s - FLAT * F.abs(s)), sma_n(x, fast), sma_n(x, slow))


def label_next_up(x: ColumnLike) -> Rolling:
    """1 when the next row is higher, 0 when it is equal or lower, NULL when either is missing."""
    return combine(
        lambda now, after: F.when(after > now, 1.0).when(after <= now, 0.0), value(x), value(x).lagged(-1)
    )


def forward_change(x: ColumnLike) -> Rolling:
    """Relative change from this row to the next one."""
    return pct_change(x).lagged(-1)
