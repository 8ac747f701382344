"""A panel on disk, in order, with a manifest of what lies where.

Rows are written once in ranges of the series order, each range sorted. The manifest has one row for each series and range: how many rows,
and the first and last key. Row numbers are then a sum over the manifest plus the row's place in its range, so reading a panel needs no
sort, no window and no checkpoint, however long a series is. Later rows are appended as a batch of their own with its part of the
manifest; a batch is there once its part of the manifest is, so a write that failed half way leaves nothing to see.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.panel import BROADCAST_SERIES, ROW_NUMBER, SERIES_ROWS, SLICE_ROWS, Panel, PanelStats, attach

BATCH, RANGE, PLACE = "__batch", "__range", "__place"


class PanelStore:
    """The stored panel at ``path``; ``series``, ``ts`` and ``tie`` name the key columns as in a ``Panel``."""

    def __init__(self, spark: SparkSession, path: str, series: str | list[str], ts: str, tie: str | list[str] = ()):
        self.spark, self.path = spark, path.rstrip("/")
        self.series = [series] if isinstance(series, str) else list(series)
        self.ts, self.tie = ts, [tie] if isinstance(tie, str) else list(tie)

    @property
    def order(self) -> list[str]:
        return [self.ts, *self.tie]

    @classmethod
    def create(cls, panel: Panel, path: str, range_rows: int = SLICE_ROWS) -> PanelStore:
        """Store the rows of a panel as batch 0. Ranges have about ``range_rows`` rows."""
        store = cls(panel.df.sparkSession, path, panel.series, panel.ts, panel.order[1:])
        store._write(panel.df, panel.stats.rows, 0, range_rows)
        return store

    def append(self, df: DataFrame, range_rows: int = SLICE_ROWS) -> int:
        """Store later rows of the same columns as a new batch; returns its number.

        No row may come before the last stored one of its series: row numbers and whatever was computed from them would change.
        """
        manifest = self.manifest
        ends = manifest.groupBy(*self.series).agg(F.max("last").alias("_end"))
        begins = df.groupBy(*self.series).agg(F.min(F.struct(*self.order)).alias("_begin"))
        earlier = attach(begins, ends, self.series, BROADCAST_SERIES + 1).filter("_begin <= _end").limit(1).collect()
        if earlier:
            raise ValueError(f"rows before the end of a stored series: {earlier[0]}")
        number = manifest.agg((F.max(BATCH) + 1).alias("n")).first()["n"] or 0
        self._write(df, df.count(), int(number), range_rows)
        return int(number)

    def _write(self, df: DataFrame, rows: int, batch: int, range_rows: int) -> None:
        ranges = max(1, -(-rows // range_rows))
        keys = [*self.series, *self.order]
        folder = f"{self.path}/rows/{BATCH}={batch}"
        (
            df.repartitionByRange(ranges, *keys).sortWithinPartitions(*keys)
            .select("*", F.spark_partition_id().alias(RANGE), F.monotonically_increasing_id().alias(PLACE))
            .write.mode("overwrite").parquet(folder)
        )
        # What was written decides, not what a second run of the sort would give.
        written = self.spark.read.parquet(folder)
        key = F.struct(*self.order)
        parts = written.groupBy(*self.series, RANGE).agg(
            F.count(F.lit(1)).alias("rows"), F.min(PLACE).alias("begin"), F.min(key).alias("first"), F.max(key).alias("last")
        )
        parts.write.mode("overwrite").parquet(f"{self.path}/manifest/{BATCH}={batch}")

    @property
    def manifest(self) -> DataFrame:
        """One row for each series, batch and range: ``rows``, ``first`` and ``last`` key, ``begin``."""
        return self.spark.read.parquet(f"{self.path}/manifest")

    def rows(self, batch: int | None = None) -> DataFrame:
        """The stored rows with their place, of one batch or all; a batch reads its own files only."""
        found = self.spark.read.option("basePath", f"{self.path}/rows").parquet(f"{self.path}/rows")
        return found if batch is None else found.filter(F.col(BATCH) == batch)

    def panel(self, columns: list[str] | None = None, batch: int | None = None, max_series_rows: int = 4_000_000, segment_rows: int = 1_000_000) -> Panel:
        """The panel of all batches, or of one, whose rows are then numbered from 1 within it."""
        manifest = self.manifest.select(*self.series, BATCH, RANGE, "rows", "begin")
        if batch is not None:
            manifest = manifest.filter(F.col(BATCH) == batch)
        by_series = Window.partitionBy(*self.series)
        before = by_series.orderBy(BATCH, RANGE).rowsBetween(Window.unboundedPreceding, -1)
        starts = manifest.select(
            *self.series, BATCH, RANGE, (F.coalesce(F.sum("rows").over(before), F.lit(0)) - F.col("begin") + 1).alias("__shift"),
            F.sum("rows").over(by_series).alias(SERIES_ROWS),
        )
        sizes = manifest.groupBy(*self.series).agg(F.sum("rows").alias("n"))
        size = sizes.agg(F.count("n").alias("k"), F.sum("n").alias("t"), F.max("n").alias("m")).first()
        rows = self.rows(batch)
        if columns is not None:
            rows = rows.select(*dict.fromkeys([*self.series, *self.order, *columns]), BATCH, RANGE, PLACE)
        parts = starts.count()
        joined = attach(rows, starts, [*self.series, BATCH, RANGE], parts).filter(F.col("__shift").isNotNull())
        numbered = joined.withColumn(ROW_NUMBER, F.col(PLACE) + F.col("__shift")).drop(BATCH, RANGE, PLACE, "__shift")
        panel = Panel(
            numbered, self.series, self.ts, self.tie, max_series_rows=max_series_rows, segment_rows=segment_rows,
            stats=PanelStats(size["k"], size["t"] or 0, size["m"] or 0),
        )
        panel.stored = True
        return panel
