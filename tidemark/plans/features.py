"""From raw columns to the design table.

Every feature derives from one panel, so "merging" them on the index is a projection: one exchange, one sort, and a
chain of windows over the same order. Nothing is joined back.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.rolling import (
    Rolling,
    cci_n,
    diff_1,
    label_next_up,
    log_return,
    pct_change,
    roc_n,
    sma_n,
    sma_signal,
    wma_n,
)
from tidemark.functions.scalars import finite_or_null
from tidemark.operators.scaling import minmax_scale
from tidemark.operators.selection import complete_cases
from tidemark.operators.smoothing import momentum_indicators
from tidemark.panel import Panel

# Names and order of the design table.
TECHNICAL = [
    "SP_WMA_10_return", "SP_SMA_5_return", "SP_SMA_10_return", "Momentum_5", "RSI_15", "MACD", "CCI_15", "Signal",
]
MACRO = ["change_risk", "change_gold", "change_VIX", "change_Currency", "change_RF_normalized"]
INTERCEPT, LABEL = "x_0", "spEvolution"
FEATURES = [INTERCEPT, *TECHNICAL, *MACRO]

SCALED_TECHNICAL = ["SP_WMA_10_return", "SP_SMA_5_return", "SP_SMA_10_return", "Momentum_5", "MACD", "CCI_15"]

MOVE = "_move"


def technical_rollings(x: str) -> dict[str, Rolling]:
    return {
        "SP_WMA_10_return": log_return(wma_n(x, 10)),
        "SP_SMA_5_return": log_return(sma_n(x, 5)),
        "SP_SMA_10_return": log_return(sma_n(x, 10)),
        "Momentum_5": roc_n(x, 5),
        "CCI_15": cci_n(x, 15),
        "Signal": sma_signal(x, 5, 10),
        MOVE: diff_1(x),
    }


def macro_rollings(columns: dict[str, str]) -> dict[str, Rolling]:
    return {name: pct_change(column) for name, column in columns.items()}


def technical_features(panel: Panel, x: str) -> Panel:
    """The eight technical features, unscaled except RSI, which is divided by 100."""
    panel = panel.roll(technical_rollings(x))
    panel = momentum_indicators(panel, x, rsi="RSI_15", macd="MACD", move=MOVE)
    return panel.with_columns({"RSI_15": F.col("RSI_15") / 100.0, "Signal": F.col("Signal").cast("double")})


def macro_features(panel: Panel, columns: dict[str, str], fit_on: Column | None = None) -> Panel:
    """Relative changes of the macro columns (feature name → source column), scaled to [0, 1] per series."""
    panel = panel.roll(macro_rollings(columns))
    panel = panel.with_columns({name: finite_or_null(name) for name in columns})
    return minmax_scale(panel, {name: name for name in columns}, fit_on)


def design_table(panel: Panel, x: str, macro: dict[str, str], fit_on: Column | None = None) -> Panel:
    """Key columns, intercept, thirteen features and the next-row label; complete rows only.

    All fixed-reach indicators share one window, all scale bounds another.
    """
    panel = panel.roll(technical_rollings(x) | macro_rollings(macro) | {LABEL: label_next_up(x)})
    panel = momentum_indicators(panel, x, rsi="RSI_15", macd="MACD", move=MOVE)
    panel = panel.with_columns(
        {INTERCEPT: F.lit(1.0), "RSI_15": F.col("RSI_15") / 100.0, "Signal": F.col("Signal").cast("double")}
        | {name: finite_or_null(name) for name in macro}
    )
    panel = minmax_scale(panel, {name: name for name in [*SCALED_TECHNICAL, *macro]}, fit_on)
    columns = [INTERCEPT, *TECHNICAL, *macro, LABEL]
    return panel.subset(complete_cases(panel.df.select(*panel.keys, *columns), columns))
