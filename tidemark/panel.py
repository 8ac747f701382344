"""A panel: many ordered series in one DataFrame.

Row order is never physical. A panel names the series columns, the time column and a tie-breaker that
makes the order unique, and every operator states that order to Spark.

Two plans exist for everything that depends on order:

* If no series is longer than ``max_series_rows`` (measured with one small aggregate), a window
  partitioned by series does the work: one exchange and one sort for any number of indicators.
* Otherwise a single series may hold a large share of all rows, and one window task would have to
  take it whole. Then rows are numbered with a range sort, which splits a series over as many tasks as
  it needs, and windows run over slices of ``segment_rows`` rows with the few neighbouring rows that the
  indicators read copied into each slice. The results are the same: same rows, same columns. Series keys may be NULL, which
  is a series like any other.

Row numbers are kept in private columns, which ``Panel.rows`` has and ``Panel.df`` hides. They belong to the rows they were
counted for: a panel over another DataFrame counts anew.
"""

from __future__ import annotations

import copy
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidemark.functions.rolling import Rolling, add_rolling
from tidemark.session import shared_dir

# Private columns: number of the row within its series, and rows of the series.
ROW_NUMBER = "__row_number"
SERIES_ROWS = "__series_rows"

# Lower bound for the rows per task of the range sort that numbers very long series.
SLICE_ROWS = 250_000

# One row per series is broadcast only up to this many series (some 100 bytes each).
BROADCAST_SERIES = 200_000


@dataclass(frozen=True)
class PanelStats:
    series: int
    rows: int
    longest: int


def attach(df: DataFrame, params: DataFrame, keys: list[str], params_rows: int) -> DataFrame:
    """Join a table that is unique on ``keys``, broadcasting it only when its known size is small. NULL keys match.

    Beyond that the join is a shuffle join, in which adaptive execution splits a hot key.
    """
    names = {k: f"__key_{i}" for i, k in enumerate(keys)}
    params = params.select(*(F.col(c).alias(names.get(c, c)) for c in params.columns))
    if params_rows <= BROADCAST_SERIES:
        params = F.broadcast(params)
    same = reduce(and_, (F.col(k).eqNullSafe(F.col(n)) for k, n in names.items()))
    return df.join(params, same, "left").drop(*names.values())


class Panel:
    def __init__(
        self,
        df: DataFrame,
        series: str | list[str],
        ts: str,
        tie: str | list[str] = (),
        *,
        max_series_rows: int = 4_000_000,
        segment_rows: int = 1_000_000,
        stats: PanelStats | None = None,
    ):
        self.rows = df
        self.series = [series] if isinstance(series, str) else list(series)
        if not self.series:
            raise ValueError("a panel needs a series column; add a constant one for a single series")
        self.order = [ts, *([tie] if isinstance(tie, str) else tie)]
        self.ts = ts
        self.max_series_rows = max_series_rows
        self.segment_rows = segment_rows
        self._stats = stats
        self._pinned = False
        # Set by a ``PanelStore``: reading the rows again costs a scan, so they are not stored once more.
        self.stored = False

    @property
    def df(self) -> DataFrame:
        """The rows, without private columns."""
        return self.rows.drop(ROW_NUMBER, SERIES_ROWS) if self._numbered else self.rows

    @property
    def _numbered(self) -> bool:
        return ROW_NUMBER in self.rows.columns

    # -- shape ---------------------------------------------------------------------------------

    @property
    def keys(self) -> list[str]:
        """The columns that identify a row."""
        return self.series + self.order

    @property
    def stats(self) -> PanelStats:
        """Number of series, rows, and rows of the longest series: one aggregate, run once per panel."""
        if self._stats is None:
            sizes = self.df.groupBy(*self.series).agg(F.count(F.lit(1)).alias("n"))
            row = sizes.agg(F.count("n").alias("k"), F.sum("n").alias("t"), F.max("n").alias("m")).first()
            self._stats = PanelStats(row["k"], row["t"] or 0, row["m"] or 0)
        return self._stats

    @property
    def is_long(self) -> bool:
        return self.stats.longest > self.max_series_rows

    def replace(self, df: DataFrame, same_rows: bool = True) -> Panel:
        """A panel over another DataFrame with the same key columns.

        ``same_rows=False`` says that rows were added or removed; the sizes of series are then measured anew.
        """
        panel = copy.copy(self)
        panel.rows = df if same_rows else df.drop(ROW_NUMBER, SERIES_ROWS)
        panel._pinned = False
        if not same_rows:
            panel._stats = None
        return panel

    def subset(self, df: DataFrame) -> Panel:
        """A panel over some of the rows. Sizes measured before stay as upper bounds, so nothing is counted again."""
        panel = self.replace(df, same_rows=False)
        panel._stats = self._stats
        return panel

    def with_columns(self, columns: dict[str, Column]) -> Panel:
        return self.replace(self.rows.withColumns(columns))

    def drop(self, *names: str) -> Panel:
        return self.replace(self.rows.drop(*names))

    def pinned(self) -> Panel:
        """For a panel with a very long series, store the rows computed so far.

        Its operators read their input twice (for totals, then for rows); without this every one of them would
        double the work of all that came before.
        """
        if self._pinned or self.stored or not self.is_long:
            return self
        shared_dir(self.df.sparkSession)
        panel = self.replace(self.rows.checkpoint())
        panel._pinned = True
        return panel

    def window(self) -> WindowSpec:
        """The ordered window of whole series. It takes a series into one task; the operators avoid that for very long ones."""
        return Window.partitionBy(*self.series).orderBy(*self.order)

    # -- order ---------------------------------------------------------------------------------

    def numbered(self) -> Panel:
        """With the private columns: numbers from 1 within the series, and rows of the series."""
        if self._numbered:
            return self
        if not self.is_long:
            whole = Window.partitionBy(*self.series)
            df = self.rows.select(
                "*",
                F.row_number().over(self.window()).cast("long").alias(ROW_NUMBER),
                F.count(F.lit(1)).over(whole).alias(SERIES_ROWS),
            )
        else:
            df = self._number_by_range()
        return self.replace(df)

    def _number_by_range(self) -> DataFrame:
        """Row numbers without putting a series into one task.

        A range exchange cuts the ordered rows into slices; the checkpoint pins which rows are in which
        slice, so that the slice sizes counted below and the rows they are joined to agree.
        """
        spark = self.df.sparkSession
        shared_dir(spark)
        slice_rows = max(self.segment_rows, SLICE_ROWS)
        slices = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-self.stats.rows // slice_rows))
        pinned = (
            self.rows.repartitionByRange(slices, *self.keys)
            .sortWithinPartitions(*self.keys)
            .select("*", F.spark_partition_id().alias("__slice"), F.monotonically_increasing_id().alias("__id"))
            .checkpoint()
        )
        sizes = pinned.groupBy(*self.series, "__slice").agg(F.min("__id").alias("__first"), F.count(F.lit(1)).alias("__n"))
        by_series = Window.partitionBy(*self.series)
        before = by_series.orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
        starts = sizes.select(
            *self.series,
            "__slice",
            (F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__first") + 1).alias("__shift"),
            F.sum("__n").over(by_series).alias(SERIES_ROWS),
        )
        joined = attach(pinned, starts, [*self.series, "__slice"], self.stats.series + slices)
        return joined.withColumn(ROW_NUMBER, F.col("__id") + F.col("__shift")).drop("__slice", "__id", "__shift")

    def segments(self, rows: int) -> tuple[Panel, Column, Column]:
        """Numbered panel with the slice number and the 0-based position in it, for slices of ``rows``."""
        panel = self.numbered()
        zero_based = F.col(ROW_NUMBER) - 1
        return panel, F.floor(zero_based / rows).cast("long"), (zero_based % rows).cast("int")

    # -- windows -------------------------------------------------------------------------------

    def roll(self, indicators: dict[str, Rolling]) -> Panel:
        """Add indicators of fixed reach. All of them share one exchange and one sort."""
        if not self.is_long:
            return self.replace(add_rolling(self.rows, self.window(), indicators))
        back = max(r.back for r in indicators.values())
        ahead = max(r.ahead for r in indicators.values())
        size = max(self.segment_rows, back, ahead)
        panel, segment, position = self.segments(size)
        targets = [segment]
        if back:
            targets.append(F.when(position >= size - back, segment + 1))
        if ahead:
            targets.append(F.when(position < ahead, segment - 1))
        copies = panel.rows.withColumn("__segment", F.explode(F.array_compact(F.array(*targets))))
        w = Window.partitionBy(*self.series, "__segment").orderBy(ROW_NUMBER)
        rolled = add_rolling(copies, w, indicators)
        return panel.replace(rolled.filter(F.col("__segment") == segment).drop("__segment"))

    def per_series(self, aggregates: dict[str, Column]) -> Panel:
        """Add one aggregate value per series to each of its rows."""
        if not self.is_long:
            whole = Window.partitionBy(*self.series)
            return self.replace(self.rows.select("*", *(a.over(whole).alias(n) for n, a in aggregates.items())))
        rows = self.pinned().rows
        params = rows.groupBy(*self.series).agg(*(a.alias(n) for n, a in aggregates.items()))
        return self.replace(attach(rows, params, self.series, self.stats.series))
