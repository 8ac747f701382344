"""Exponential averages that go on where earlier rows ended.

After a row, an average is one number per series: ``y = A*y0 + B`` over any stretch of rows, where A is the decay over its length and B what
the stretch itself gives. So the averages of appended rows need the level before them and not the rows; the state of a panel is
a table with one row per series, which the next append takes in. Series without new rows keep theirs.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.rolling import lag_k
from tidemark.functions.scalars import ColumnLike, as_column, ratio
from tidemark.operators.smoothing import Before, Smoothing, smooth
from tidemark.panel import Panel, attach

_PARTS = {"seen": "long", "sum": "double", "level": "double", "broken": "boolean"}


def _state_types(outputs: dict[str, Smoothing], last: bool) -> dict[str, str]:
    types = {f"{name}__{part}": t for name in outputs for part, t in _PARTS.items()}
    return types | ({"__last": "double"} if last else {})


def _with_state(panel: Panel, types: dict[str, str], state: DataFrame | None) -> Panel:
    if state is None:
        return panel.with_columns({c: F.lit(None).cast(t) for c, t in types.items()})
    return panel.replace(attach(panel.rows, state.select(*panel.series, *types), panel.series, panel.stats.series))


def _merged(panel: Panel, state: DataFrame | None, new: DataFrame, types: dict[str, str]) -> DataFrame:
    """The new state of series with rows, the old one of the others. NULL keys match."""
    new = new.select(*panel.series, *types)
    if state is None:
        return new
    both = state.select(*panel.series, *types, F.lit(0).alias("_age")).unionByName(new.withColumn("_age", F.lit(1)))
    kept = both.groupBy(*panel.series).agg(F.max_by(F.struct(*types), "_age").alias("_s"))
    return kept.select(*panel.series, *(F.col("_s")[c].alias(c) for c in types))


def smooth_append(panel: Panel, outputs: dict[str, Smoothing], state: DataFrame | None = None, last: ColumnLike | None = None) -> tuple[Panel, DataFrame]:
    """Averages of the rows of ``panel``, which follow those that ``state`` was returned for; and the state after them.

    Without a state the rows are the first of their series. The results are those of ``smooth`` over all rows. ``last`` also keeps the last
    value of a column. Row numbers that the panel brings must count from 1 within it.
    """
    if any(s.n < 2 for s in outputs.values()):
        raise ValueError("an average over one row is the row itself and has no state")
    types = _state_types(outputs, last is not None)
    given = [c for c in panel.df.columns if c not in types]
    panel = _with_state(panel, types, state)
    inputs = {n: as_column(s.x).cast("double") for n, s in outputs.items()}
    before = {
        n: Before(F.coalesce(f"{n}__seen", F.lit(0).cast("long")), F.coalesce(f"{n}__sum", F.lit(0.0)), F.coalesce(f"{n}__level", F.lit(0.0)), F.coalesce(f"{n}__broken", F.lit(False)))
        for n in outputs
    }
    result = smooth(panel, outputs, before=before)
    key = F.struct(*panel.order)
    aggregates: list[Column] = []
    for n, s in outputs.items():
        x, b = inputs[n], before[n]
        # The old state is equal in all rows of a series, so any row's will do.
        seen = F.max(b.seen) + F.count(x)
        behind = F.max(F.when(x.isNull(), key)) > F.min(F.when(x.isNotNull(), key))
        gap = F.when(F.max(b.seen) > 0, F.count_if(x.isNull()) > 0).otherwise(F.coalesce(behind, F.lit(False)))
        aggregates += [
            F.least(F.lit(s.n).cast("long"), seen).alias(f"{n}__seen"),
            F.when(seen < s.n, F.max(b.sum) + F.coalesce(F.sum(x), F.lit(0.0))).otherwise(0.0).alias(f"{n}__sum"),
            F.max_by(F.col(n), key).alias(f"{n}__level"),
            (F.bool_or(b.broken) | gap).alias(f"{n}__broken"),
        ]
    if last is not None:
        aggregates.append(F.max_by(as_column(last).cast("double"), key).alias("__last"))
    new = result.df.groupBy(*panel.series).agg(*aggregates)
    kept = [c for c in result.rows.columns if c not in types]
    rows = result.replace(result.rows.select(*kept))
    assert set(given) <= set(rows.df.columns)
    return rows, _merged(panel, state, new, types)


def ema_append(panel: Panel, name: str, x: ColumnLike, n: int, state: DataFrame | None = None, kind: str = "ema") -> tuple[Panel, DataFrame]:
    """An exponential average of appended rows, and the state for the next ones."""
    return smooth_append(panel, {name: Smoothing(x, n, kind)}, state)


def _moves(panel: Panel, x: ColumnLike, state: DataFrame | None) -> Panel:
    """With ``_move``, the difference to the row before, which for a first row is the last value that the state keeps."""
    panel = panel.with_columns({"_one": F.lit(1), "_value": as_column(x).cast("double")})
    if state is None:
        panel = panel.with_columns({"_old": F.lit(None).cast("double")})
    else:
        old = state.select(*panel.series, F.col("__last").alias("_old"))
        panel = panel.replace(attach(panel.rows, old, panel.series, panel.stats.series))
    panel = panel.roll({"_prev": lag_k("_value"), "_any": lag_k("_one")})
    before = F.when(F.col("_any").isNull(), F.col("_old")).otherwise(F.col("_prev"))
    return panel.with_columns({"_move": F.col("_value") - before}).drop("_prev", "_any", "_one", "_old")


def rsi_append(panel: Panel, name: str, x: ColumnLike, n: int = 15, state: DataFrame | None = None) -> tuple[Panel, DataFrame]:
    """RSI of appended rows, and the state for the next ones."""
    panel = _moves(panel, x, state)
    d = F.col("_move")
    wanted = {
        "_gain": Smoothing(F.when(d > 0, d).when(d <= 0, 0.0), n, "wilder"),
        "_loss": Smoothing(F.when(d < 0, -d).when(d >= 0, 0.0), n, "wilder"),
    }
    panel, state = smooth_append(panel, wanted, state, last="_value")
    panel = panel.with_columns({name: 100.0 * ratio("_gain", F.col("_gain") + F.col("_loss"))})
    return panel.drop("_gain", "_loss", "_move", "_value"), state


def macd_append(
    panel: Panel, name: str, x: ColumnLike, fast: int = 12, slow: int = 26, signal: str | None = None, signal_n: int = 9, state: DataFrame | None = None
) -> tuple[Panel, DataFrame]:
    """MACD of appended rows and, if named, its signal line; and the state of all of them."""
    lines = {"_fast": Smoothing(x, fast), "_slow": Smoothing(x, slow)}
    panel, averages = smooth_append(panel, lines, state)
    panel = panel.with_columns({name: 100.0 * (ratio("_fast", "_slow") - 1.0)}).drop("_fast", "_slow")
    if signal is None:
        return panel, averages
    panel, line = smooth_append(panel, {signal: Smoothing(name, signal_n)}, state)
    keys = {c: f"_key_{i}" for i, c in enumerate(panel.series)}
    other = line.select(*(F.col(c).alias(k) for c, k in keys.items()), *(c for c in line.columns if c not in panel.series))
    same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(k)) for c, k in keys.items()))
    return panel, averages.join(other, same).drop(*keys.values())
