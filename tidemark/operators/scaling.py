"""Per-series scalars attached to rows, and min-max scaling."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.scalars import as_column, ratio
from tidemark.panel import Panel


def broadcast_params(panel: Panel, aggregates: dict[str, Column]) -> Panel:
    """Attach aggregates of each series to its rows, for example its minimum and maximum."""
    return panel.per_series(aggregates)


def minmax_scale(panel: Panel, columns: dict[str, str], fit_on: Column | None = None) -> Panel:
    """Map each source column onto [0, 1] per series; ``columns`` is output name → source column.

    The bounds come from all rows, or from the rows for which ``fit_on`` holds, so that held-out rows need not
    leak into the scale (they may then fall outside [0, 1]). A constant series gives NULL. An output may
    overwrite its source.
    """
    source = {out: as_column(c) for out, c in columns.items()}
    fitted = {out: c if fit_on is None else F.when(fit_on, c) for out, c in source.items()}
    bounds = {f"_lo_{o}": F.min(c) for o, c in fitted.items()} | {f"_hi_{o}": F.max(c) for o, c in fitted.items()}
    panel = panel.per_series(bounds)
    scaled = {
        o: ratio(c - F.col(f"_lo_{o}"), F.col(f"_hi_{o}") - F.col(f"_lo_{o}")) for o, c in source.items()
    }
    return panel.with_columns(scaled).drop(*bounds)
