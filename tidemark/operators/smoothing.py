"""Exponential averages and the indicators built on them.

``y_t = a*x_t + q*y_(t-1)`` with ``q = 1-a`` looks serial, but dividing by ``q^t`` turns it into a running
sum: ``y_t = q^t * sum(a*x_j*q^-j)``. The sum is a window, so no Python is involved and rows of a series need
not pass through a loop. ``q^-j`` grows, therefore the exponent restarts every ``span`` rows, far from the
range where doubles overflow, and each span receives what the earlier spans have left. A contribution that
has decayed below the smallest double is zero in a serial loop too, so only a fixed number of earlier spans
(two at the default span) can matter, and the result equals the loop to rounding.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from tidemark.functions.rolling import Rolling, add_rolling, diff_1, lag_k, sma_n
from tidemark.functions.scalars import ColumnLike, as_column, ratio
from tidemark.panel import ROW_NUMBER, SERIES_ROWS, Panel, attach

# Powers up to 10^200 leave room for inputs of any sensible size below the limit of a double.
SAFE_DIGITS = 200
LOWEST_DIGITS = 324
# Earlier spans looked at with window frames; averages of very different memory in one call need more and use a join.
MAX_FRAMES = 16


@dataclass(frozen=True)
class Smoothing:
    """Exponential average over ``n``, seeded by the mean of the first ``n`` values.

    ``kind='ema'`` weighs by 2/(n+1), ``kind='wilder'`` by 1/n. Counting starts at the first non-NULL value;
    a NULL after it makes the rest of the series NULL.
    """

    x: ColumnLike
    n: int
    kind: str = "ema"

    @property
    def alpha(self) -> float:
        if self.kind not in ("ema", "wilder"):
            raise ValueError("kind is 'ema' or 'wilder'")
        return 2.0 / (self.n + 1) if self.kind == "ema" else 1.0 / self.n

    @property
    def decay_digits(self) -> float:
        """Decimal digits lost per row; 0.0 when the average follows its input at once (n = 1)."""
        return -math.log10(1.0 - self.alpha) if self.alpha < 1.0 else 0.0


@dataclass(frozen=True)
class Before:
    """What the rows before a panel's first have left of an average, as columns: values seen (at most n), their sum while they are fewer
    than n, the level from then on, and whether a gap has ended the series. The columns are equal in all rows of a series."""

    seen: Column
    sum: Column
    level: Column
    broken: Column


def _partial_sum(x: str, n: int) -> Rolling:
    """Sum of the last n rows, or of those there are."""
    write = lambda spec: F.sum(F.col(x)).over(spec.rowsBetween(-(n - 1), 0))
    return Rolling(n - 1, 0, lambda w, shift: w.get("partial", x, (n, shift), write))


def smooth(panel: Panel, outputs: dict[str, Smoothing], span: int | None = None, before: dict[str, Before] | None = None) -> Panel:
    """Add exponential averages. ``span`` overrides the number of rows between restarts (for tests).

    ``before`` continues averages of earlier rows that the panel doesn't hold; rows are then numbered from 1 within the panel.
    """
    direct = {n: s for n, s in outputs.items() if s.n == 1}
    outputs = {n: s for n, s in outputs.items() if s.n > 1}
    if direct:
        panel = panel.with_columns({n: as_column(s.x).cast("double") for n, s in direct.items()})
    if not outputs:
        return panel
    if span is None:
        span = int(SAFE_DIGITS / max(s.decay_digits for s in outputs.values()))

    given = panel.df.columns
    panel = panel.with_columns({f"_x_{n}": as_column(s.x).cast("double") for n, s in outputs.items()})
    seeds = {f"_seed_{n}": sma_n(f"_x_{n}", s.n) for n, s in outputs.items()}
    if before:
        seeds |= {f"_part_{n}": _partial_sum(f"_x_{n}", s.n) for n, s in outputs.items()}
    rn = F.col(ROW_NUMBER)
    missing = {n: F.col(f"_x_{n}").isNull() for n in outputs}
    starts = {f"_start_{n}": F.min(F.when(~missing[n], rn)) for n in outputs}
    if not panel.is_long:
        # First value and last gap up to the row; a gap counts if it lies behind the first value.
        gaps = {f"_gap_{n}": F.max(F.when(missing[n], rn)) for n in outputs}
        numbered = panel.df.withColumn(ROW_NUMBER, F.row_number().over(panel.window()))
        rows = add_rolling(numbered, panel.window(), seeds, starts | gaps)
        unbroken = {n: F.col(f"_gap_{n}").isNull() | (F.col(f"_gap_{n}") < F.col(f"_start_{n}")) for n in outputs}
    else:
        given = [*given, ROW_NUMBER, SERIES_ROWS]
        panel = panel.numbered().roll(seeds | {f"_before_{n}": lag_k(f"_x_{n}") for n in outputs})
        breaks = {n: missing[n] & F.col(f"_before_{n}").isNotNull() for n in outputs}
        nulls = {f"_null_{n}": F.min(F.when(missing[n], rn)) for n in outputs} if before else {}
        panel = panel.per_series(starts | {f"_gap_{n}": F.min(F.when(breaks[n], rn)) for n in outputs} | nulls)
        rows = panel.rows
        unbroken = {n: F.col(f"_gap_{n}").isNull() | (rn < F.col(f"_gap_{n}")) for n in outputs}

    start = {n: F.col(f"_start_{n}") for n in outputs}
    seed = {n: F.col(f"_seed_{n}") for n in outputs}
    if before:
        # Values seen before count as rows numbered down from 0, so any gap in the panel lies behind them.
        for n, s in outputs.items():
            b = before[n]
            start[n] = F.when(b.seen > 0, 1 - b.seen).otherwise(start[n])
            first_gap = F.coalesce(b.seen > 0, F.lit(False)) & (F.coalesce(F.col(f"_{'gap' if not panel.is_long else 'null'}_{n}") <= rn, F.lit(False)))
            unbroken[n] = unbroken[n] & ~F.coalesce(b.broken, F.lit(False)) & ~first_gap
            seed[n] = F.when(b.seen > 0, (b.sum + F.col(f"_part_{n}")) / s.n).otherwise(seed[n])
    # Distance to the seed row: negative before it, 0 on it.
    after_seed = {n: rn - start[n] - (s.n - 1) for n, s in outputs.items()}
    position = (rn - 1) % span

    def term(name: str, scale: Column) -> Column:
        s, k = outputs[name], after_seed[name]
        return F.when(k == 0, seed[name] * scale).when(k > 0, s.alpha * F.col(f"_x_{name}") * scale)

    reach = {n: max(1, math.ceil(LOWEST_DIGITS / (s.decay_digits * span))) for n, s in outputs.items()}
    furthest = max(reach.values())
    spanned = panel.is_long or panel.stats.longest > span
    keys = [*panel.series, "_span"]
    if spanned:
        rows = rows.withColumn("_span", F.floor((rn - 1) / span).cast("long"))
    if spanned and (panel.is_long or furthest > MAX_FRAMES):
        parts = panel.stats.series + panel.stats.rows // span
        rows = attach(rows, _left_over(rows, keys, outputs, term, position, span, furthest), keys, parts)

    w = Window.partitionBy(*keys).orderBy(ROW_NUMBER) if spanned else panel.window()
    running = w.rowsBetween(Window.unboundedPreceding, 0)
    q = {n: F.lit(1.0 - s.alpha) for n, s in outputs.items()}
    levels = {n: F.coalesce(F.sum(term(n, F.pow(q[n], -position))).over(running), F.lit(0.0)) for n in outputs}
    rows = rows.withColumns({f"_level_{n}": level for n, level in levels.items()})
    if not spanned:
        carry = {n: F.lit(0.0) for n in outputs}
    elif panel.is_long or furthest > MAX_FRAMES:
        carry = {n: F.coalesce(F.col(f"_carry_{n}"), F.lit(0.0)) for n in outputs}
    else:
        rows = rows.select("*", *_carried(panel, outputs, q, position, span, reach))
        carry = {n: F.col(f"_carry_{n}") for n in outputs}

    results = []
    for n in outputs:
        smoothed = F.pow(q[n], position) * (F.col(f"_level_{n}") + q[n] * carry[n])
        if before:
            smoothed = smoothed + F.when(before[n].seen >= outputs[n].n, before[n].level * F.pow(q[n], rn)).otherwise(0.0)
        results.append(F.when((after_seed[n] >= 0) & unbroken[n], smoothed).alias(n))
    return panel.replace(rows.select(*given, *results))


def _carried(panel: Panel, outputs, q, position, span, reach) -> list[Column]:
    """What earlier spans of the same series contribute, read from the last row of each: windows, no join."""
    by_span = Window.partitionBy(*panel.series).orderBy("_span")
    columns = []
    for n in outputs:
        end = F.when(position == span - 1, F.col(f"_level_{n}") * F.pow(q[n], F.lit(span - 1)))
        total = F.lit(0.0)
        for k in range(1, reach[n] + 1):
            part = F.max(end).over(by_span.rangeBetween(-k, -k)) * F.pow(q[n], F.lit(span * (k - 1)))
            total = total + F.coalesce(part, F.lit(0.0))
        columns.append(total.alias(f"_carry_{n}"))
    return columns


def _left_over(rows, keys, outputs, term, position, span, reach):
    """The same by aggregates and a join, for series that must not be in one window."""
    ends = rows.groupBy(*keys).agg(
        *(F.sum(term(n, F.pow(F.lit(1.0 - s.alpha), span - 1 - position))).alias(f"_end_{n}") for n, s in outputs.items())
    )
    handed_on = ends.withColumn("_ahead", F.explode(F.sequence(F.lit(1), F.lit(reach))))
    return (
        handed_on.select(
            *keys[:-1],
            (F.col("_span") + F.col("_ahead")).alias("_span"),
            *(
                (F.col(f"_end_{n}") * F.pow(F.lit(1.0 - s.alpha), F.lit(span) * (F.col("_ahead") - 1))).alias(f"_end_{n}")
                for n, s in outputs.items()
            ),
        )
        .groupBy(*keys)
        .agg(*(F.sum(f"_end_{n}").alias(f"_carry_{n}") for n in outputs))
    )


def ema_n(panel: Panel, name: str, x: ColumnLike, n: int, **options) -> Panel:
    return smooth(panel, {name: Smoothing(x, n)}, **options)


def wilder_n(panel: Panel, name: str, x: ColumnLike, n: int, **options) -> Panel:
    return smooth(panel, {name: Smoothing(x, n, "wilder")}, **options)


def momentum_indicators(
    panel: Panel,
    x: ColumnLike,
    *,
    rsi: str | None = None,
    rsi_n: int = 15,
    macd: str | None = None,
    fast: int = 12,
    slow: int = 26,
    signal: str | None = None,
    signal_n: int = 9,
    move: str | None = None,
    span: int | None = None,
) -> Panel:
    """RSI, MACD and the MACD signal line, sharing one pass over the series.

    RSI is ``100*U/(U+D)`` with Wilder averages of gains and losses, NULL while nothing has moved. MACD is
    ``100*(fast/slow - 1)``; its signal line is an exponential average that starts at the first MACD value.
    ``move`` names a column that already holds the difference to the row before, which saves a window.
    """
    given = [c for c in panel.df.columns if c != move]
    wanted: dict[str, Smoothing] = {}
    if rsi:
        if move is None:
            panel, move = panel.roll({"_move": diff_1(x)}), "_move"
        d = F.col(move)
        wanted["_gain"] = Smoothing(F.when(d > 0, d).when(d <= 0, 0.0), rsi_n, "wilder")
        wanted["_loss"] = Smoothing(F.when(d < 0, -d).when(d >= 0, 0.0), rsi_n, "wilder")
    if macd or signal:
        wanted["_fast"] = Smoothing(x, fast)
        wanted["_slow"] = Smoothing(x, slow)
    panel = smooth(panel, wanted, span)
    results: dict[str, Column] = {}
    if rsi:
        results[rsi] = 100.0 * ratio("_gain", F.col("_gain") + F.col("_loss"))
    if macd or signal:
        results["_macd"] = 100.0 * (ratio("_fast", "_slow") - 1.0)
    panel = panel.with_columns(results)
    if signal:
        panel = smooth(panel, {signal: Smoothing("_macd", signal_n)}, span)
    if macd:
        panel = panel.with_columns({macd: F.col("_macd")})
    kept = [c for c in panel.rows.columns if not c.startswith("_") or c in (*given, ROW_NUMBER, SERIES_ROWS)]
    return panel.replace(panel.rows.select(*kept))


def rsi_n(panel: Panel, name: str, x: ColumnLike, n: int = 15, **options) -> Panel:
    return momentum_indicators(panel, x, rsi=name, rsi_n=n, **options)


def macd(panel: Panel, name: str, x: ColumnLike, fast: int = 12, slow: int = 26, **options) -> Panel:
    return momentum_indicators(panel, x, macd=name, fast=fast, slow=slow, **options)


def macd_signal(
    panel: Panel, name: str, x: ColumnLike, fast: int = 12, slow: int = 26, n: int = 9, **options
) -> Panel:
    return momentum_indicators(panel, x, signal=name, fast=fast, slow=slow, signal_n=n, **options)
