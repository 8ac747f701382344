"""Running sums."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import ColumnLike, as_column
from tidemark.panel import ROW_NUMBER, Panel, attach


def cum_sum(panel: Panel, sums: dict[str, ColumnLike], na: str = "propagate") -> Panel:
    """Add running sums in series order.

    ``na='propagate'`` gives NULL from the first NULL on; ``na='skip'`` counts a NULL as nothing and
    gives NULL only before the first value.
    """
    if na not in ("propagate", "skip"):
        raise ValueError("na is 'propagate' or 'skip'")
    inputs = {name: as_column(c) for name, c in sums.items()}
    if not panel.is_long:
        w = panel.window().rowsBetween(Window.unboundedPreceding, 0)
        columns = [_running(c, w, None, None, na).alias(name) for name, c in inputs.items()]
        return panel.replace(panel.rows.select("*", *columns))

    # Sum within slices of bounded size, and add to each slice what the slices before it hold.
    panel, segment, _ = panel.pinned().segments(panel.segment_rows)
    keys = [*panel.series, "__segment"]
    rows = panel.rows.withColumns({"__segment": segment, **{f"_in_{n}": c for n, c in inputs.items()}})
    totals = rows.groupBy(*keys).agg(
        *(F.sum(f"_in_{n}").alias(f"_sum_{n}") for n in inputs),
        *(F.count_if(F.col(f"_in_{n}").isNull()).alias(f"_gaps_{n}") for n in inputs),
    )
    before = Window.partitionBy(*panel.series).orderBy("__segment").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(
        *keys,
        *(F.sum(f"_sum_{n}").over(before).alias(f"_carry_{n}") for n in inputs),
        *(F.sum(f"_gaps_{n}").over(before).alias(f"_lost_{n}") for n in inputs),
    )
    slices = panel.stats.series + panel.stats.rows // panel.segment_rows
    joined = attach(rows, carried, keys, slices)
    w = Window.partitionBy(*keys).orderBy(ROW_NUMBER).rowsBetween(Window.unboundedPreceding, 0)
    columns = [
        _running(F.col(f"_in_{n}"), w, F.col(f"_carry_{n}"), F.col(f"_lost_{n}"), na).alias(n) for n in inputs
    ]
    helpers = [f"_{part}_{n}" for n in inputs for part in ("in", "carry", "lost")]
    return panel.replace(joined.select("*", *columns).drop("__segment", *helpers))


def _running(c: Column, w, carry: Column | None, lost: Column | None, na: str) -> Column:
    total = F.sum(c).over(w)
    if carry is not None:
        either = carry.isNotNull() | total.isNotNull()
        total = F.when(either, F.coalesce(carry, F.lit(0.0)) + F.coalesce(total, F.lit(0.0)))
    if na == "skip":
        return total
    gaps = F.count_if(c.isNull()).over(w)
    if lost is not None:
        gaps = gaps + F.coalesce(lost, F.lit(0))
    return F.when(gaps == 0, total)


def cum_abs_error(panel: Panel, name: str, d: ColumnLike, na: str = "propagate") -> Panel:
    """Running sum of the absolute residual."""
    return cum_sum(panel, {name: F.abs(as_column(d))}, na)
