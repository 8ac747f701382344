"""Small panels and serial reference computations."""

from __future__ import annotations

import math

import numpy as np

from tidemark.panel import Panel

LONG = {"max_series_rows": 6, "segment_rows": 5}


def make_panel(spark, series: dict[str, list[float | None]], **options) -> Panel:
    rows = [(s, t, 1000 - t, v) for s, values in series.items() for t, v in enumerate(values)]
    return Panel(spark.createDataFrame(rows, "s string, t int, tie int, x double"), "s", "t", "tie", **options)


def columns(panel_or_df, *names: str) -> dict[str, list[tuple]]:
    """Values of the named columns per series in time order."""
    df = getattr(panel_or_df, "df", panel_or_df)
    out: dict[str, list[tuple]] = {}
    for row in sorted(df.select("s", "t", *names).collect(), key=lambda r: (r["s"], r["t"])):
        out.setdefault(row["s"], []).append(tuple(row[n] for n in names))
    return out


def column(panel_or_df, name: str, series: str = "a") -> list:
    return [v[0] for v in columns(panel_or_df, name)[series]]


def close(a: list, b: list, tolerance: float = 1e-9) -> bool:
    if len(a) != len(b):
        return False
    for x, y in zip(a, b):
        if (x is None) != (y is None):
            return False
        if x is not None and not math.isclose(x, y, rel_tol=tolerance, abs_tol=tolerance):
            return False
    return True


def serial_average(values: list[float | None], n: int, alpha: float) -> list[float | None]:
    """Seeded recurrence as a loop, with NULL before the first value skipped and NULL afterwards fatal."""
    out: list[float | None] = [None] * len(values)
    first = next((i for i, v in enumerate(values) if v is not None), len(values))
    y = None
    for i in range(first, len(values)):
        if values[i] is None:
            break
        if i == first + n - 1:
            y = float(np.mean(values[first : first + n]))
        elif i >= first + n:
            y = alpha * values[i] + (1 - alpha) * y
        out[i] = y
    return out


def walk(length: int, seed: int, start: float = 100.0) -> list[float]:
    steps = np.random.default_rng(seed).normal(0, 1, length)
    return [round(float(v), 4) for v in start + np.cumsum(steps)]
