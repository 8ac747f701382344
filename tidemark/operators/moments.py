"""Central moments as a state that merges, so that summaries of all data need only the summaries of its parts.

A state is a row (`n`, `mean`, `m2`, `m3`, `m4`): the count, the mean, and sums of powers of the distance to that mean. Merging shifts each
part's sums to the common mean, which keeps their digits even where the mean is far larger than the spread; raw power sums would not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalars import ratio
from tidemark.operators.summaries import By

STATE = ["n", "mean", "m2", "m3", "m4"]


def moments(df: DataFrame, column: str, by: By = ()) -> DataFrame:
    """The state of a column, NULL left out. A group without values has n = 0 and zeros."""
    x = F.col(column)
    parts = df.groupBy(*by).agg(
        F.count(x).alias("n"), F.avg(x).alias("_mean"), F.var_pop(x).alias("_v"), F.skewness(x).alias("_s"), F.kurtosis(x).alias("_k")
    )
    n, v = F.col("n"), F.col("_v")
    values = {
        "mean": F.col("_mean"), "m2": n * v, "m3": n * F.col("_s") * v * F.sqrt(v), "m4": n * (F.col("_k") + 3.0) * v * v,
    }
    # Skewness and kurtosis of equal values are undefined, but their sums are zero.
    return parts.select(*by, "n", *(F.coalesce(F.nanvl(c, F.lit(0.0)), F.lit(0.0)).alias(name) for name, c in values.items()))


def _pair(a: Column, b: Column) -> Column:
    """The state of two parts together."""
    na, nb = a["n"].cast("double"), b["n"].cast("double")
    n = na + nb
    d = b["mean"] - a["mean"]
    share_a, share_b = F.coalesce(ratio(na, n), F.lit(0.0)), F.coalesce(ratio(nb, n), F.lit(0.0))
    mean = a["mean"] + d * share_b
    m2 = a["m2"] + b["m2"] + d * d * na * share_b
    m3 = a["m3"] + b["m3"] + d * d * d * na * share_b * (share_a - share_b) + 3.0 * d * (share_a * b["m2"] - share_b * a["m2"])
    m4 = (
        a["m4"] + b["m4"] + d * d * d * d * na * share_b * (share_a * share_a - share_a * share_b + share_b * share_b)
        + 6.0 * d * d * (share_a * share_a * b["m2"] + share_b * share_b * a["m2"]) + 4.0 * d * (share_a * b["m3"] - share_b * a["m3"])
    )
    empty = lambda s: s["n"] == 0
    both = F.struct((a["n"] + b["n"]).alias("n"), mean.alias("mean"), m2.alias("m2"), m3.alias("m3"), m4.alias("m4"))
    return F.when(empty(a), b).when(empty(b), a).otherwise(both)


def merge_moments(states: DataFrame, by: By = (), salt: int = 1) -> DataFrame:
    """One state per group from any number of parts. Parts are merged pair by pair in a fixed order of their values.

    A group's parts meet in one task, as a list: as many rows as there were parts, not values. ``salt`` above 1 merges them in that many
    lists first, for groups of very many parts.
    """
    if salt > 1:
        dealt = states.withColumn("_salt", F.pmod(F.xxhash64(*STATE), F.lit(salt)))
        states = merge_moments(dealt, [*by, "_salt"]).drop("_salt")
    none = F.struct(F.lit(0).cast("long").alias("n"), *(F.lit(0.0).alias(c) for c in STATE[1:]))
    parts = F.array_sort(F.collect_list(F.struct(*STATE)))
    merged = states.groupBy(*by).agg(F.reduce(parts, none, _pair).alias("_state"))
    return merged.select(*by, *(F.col("_state")[c].alias(c) for c in STATE))


def jarque_bera_of(states: DataFrame, by: By = ()) -> DataFrame:
    """The normality test of ``summaries.jarque_bera`` from states. NULL for equal values."""
    n = F.col("n")
    variance = ratio("m2", n)
    skewness = ratio(ratio("m3", n), variance * F.sqrt(variance))
    excess = ratio(ratio("m4", n), variance * variance) - 3.0
    statistic = n / 6.0 * (skewness * skewness + excess * excess / 4.0)
    return states.select(*by, "n", statistic.alias("statistic"), F.exp(-statistic / 2.0).alias("p_value"))


def mean_sd_of(states: DataFrame, by: By = ()) -> DataFrame:
    """Mean and sample standard deviation from states, as ``summaries.agg_mean_sd`` gives them."""
    return states.select(*by, F.when(F.col("n") > 0, F.col("mean")).alias("mean"), F.sqrt(ratio("m2", F.col("n") - 1)).alias("sd"))
