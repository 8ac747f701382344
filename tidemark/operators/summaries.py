"""Descriptive aggregates. All of them combine partially before the shuffle."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalars import normal_density, ratio

By = list[str] | tuple[str, ...]


def agg_minmax(df: DataFrame, column: str, by: By = ()) -> DataFrame:
    return df.groupBy(*by).agg(F.min(column).alias("lo"), F.max(column).alias("hi"))


def agg_mean_sd(df: DataFrame, column: str, by: By = ()) -> DataFrame:
    return df.groupBy(*by).agg(F.avg(column).alias("mean"), F.stddev_samp(column).alias("sd"))


def jarque_bera(df: DataFrame, column: str, by: By = ()) -> DataFrame:
    """Normality test: ``n/6*(S^2 + K^2/4)`` with population skewness and excess kurtosis; chi-square, 2 df."""
    moments = df.groupBy(*by).agg(
        F.count(column).alias("n"), F.skewness(column).alias("_s"), F.kurtosis(column).alias("_k")
    )
    statistic = F.col("n") / 6.0 * (F.col("_s") * F.col("_s") + F.col("_k") * F.col("_k") / 4.0)
    return moments.select(*by, "n", statistic.alias("statistic"), F.exp(-statistic / 2.0).alias("p_value"))


def _bin_rows(groups: DataFrame, bins: int) -> DataFrame:
    """One row per bin with its edges, for a table of one row per group."""
    width = (F.col("_hi") - F.col("_lo")) / bins
    return groups.withColumn("bin", F.explode(F.sequence(F.lit(1), F.lit(bins)))).withColumns(
        {"_width": width, "bin_low": F.col("_lo") + width * (F.col("bin") - 1), "bin_high": F.col("_lo") + width * F.col("bin")}
    )


def histogram(df: DataFrame, column: str, bins: int = 20, by: By = ()) -> DataFrame:
    """Counts and density in exactly ``bins`` equal right-closed bins between minimum and maximum.

    Every bin has a row, an empty one a zero. When all values are equal they are in bin 1 and the density is NULL. The maximum is in
    the last bin, whatever its quotient rounds to. A NULL in ``by`` is a group.
    """
    by = list(by)
    values = df.select(*by, F.col(column).cast("double").alias("_v")).filter(F.col("_v").isNotNull())
    ends = values.groupBy(*by).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    if by:
        names = {c: f"__{i}" for i, c in enumerate(by)}
        same = reduce(and_, (F.col(c).eqNullSafe(F.col(n)) for c, n in names.items()))
        placed = values.join(ends.withColumnsRenamed(names), same).drop(*names.values())
    else:
        pair = ends.select(F.struct("_lo", "_hi")).scalar()
        placed = values.withColumns({"_lo": pair.getField("_lo"), "_hi": pair.getField("_hi")})
    index = F.ceil(ratio((F.col("_v") - F.col("_lo")) * bins, F.col("_hi") - F.col("_lo")))
    counted = (
        placed.withColumn("bin", F.least(F.lit(bins), F.greatest(F.lit(1), F.coalesce(index, F.lit(1)))).cast("int"))
        .groupBy(*by, "bin")
        .agg(F.count(F.lit(1)).alias("n"), F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi"))
    )
    # At most one entry per bin, so the map of a group is small; it saves reading the input once more for the frame.
    groups = counted.groupBy(*by).agg(
        F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("_counts"),
        F.min("_lo").alias("_lo"),
        F.max("_hi").alias("_hi"),
        F.sum("n").alias("_n"),
    )
    n = F.coalesce(F.try_element_at("_counts", F.col("bin")), F.lit(0))
    rows = _bin_rows(groups, bins).withColumn("n", n)
    return rows.select(*by, "bin", "bin_low", "bin_high", "n", ratio("n", F.col("_n") * F.col("_width")).alias("density"))


def normal_overlay(df: DataFrame, column: str, bins: int = 20, by: By = ()) -> DataFrame:
    """Normal density with the sample's mean and deviation at the middle of each histogram bin."""
    middle = (F.col("bin_low") + F.col("bin_high")) / 2.0
    moments = df.groupBy(*by).agg(
        F.min(column).alias("_lo"), F.max(column).alias("_hi"), F.avg(column).alias("_mean"), F.stddev_samp(column).alias("_sd")
    )
    rows = _bin_rows(moments, bins)
    return rows.select(*by, "bin", middle.alias("x"), normal_density(middle, "_mean", "_sd").alias("density"))
