"""How good are the scores? Aggregates over a scored table with a score ``p`` and a 0/1 label ``y``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalars import bin_index, bin_label, hit_flag, ratio, residual, squared_error
from tidemark.operators.selection import confident, regime

By = list[str] | tuple[str, ...]


def with_errors(df: DataFrame, p: str = "p", y: str = "y", sign: str = "y-p") -> DataFrame:
    """Add residual ``d``, half squared error and hit flag."""
    d = residual(y, p, sign)
    return df.withColumns({"d": d, "half_sq": squared_error(d), "hit": hit_flag(p, y)})


def agg_sse(df: DataFrame, p: str = "p", y: str = "y", by: By = ()) -> DataFrame:
    """Sum of half squared residuals."""
    return df.groupBy(*by).agg(F.sum(squared_error(residual(y, p))).alias("sse"))


def hit_rate(df: DataFrame, p: str = "p", y: str = "y", by: By = ()) -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(hit_flag(p, y)).alias("hit_rate"))


def hits_by_year(df: DataFrame, ts: str, p: str = "p", y: str = "y") -> DataFrame:
    return hit_rate(df.withColumn("year", F.year(ts)), p, y, ["year"])


def accuracy_tstat(df: DataFrame, p: str = "p", y: str = "y", by: By = ()) -> DataFrame:
    """t statistic of the hit rate against a coin flip; NULL when every row has the same flag."""
    hit = hit_flag(p, y).cast("double")
    moments = df.groupBy(*by).agg(
        F.count(hit).alias("n"), F.avg(hit).alias("hit_rate"), F.stddev_samp(hit).alias("_sd")
    )
    t = ratio((F.col("hit_rate") - 0.5) * F.sqrt(F.col("n").cast("double")), "_sd")
    return moments.select(*by, "n", "hit_rate", t.alias("t_stat"))


def calibration(
    df: DataFrame, p: str = "p", y: str = "y", bins: int = 20, edges: str = "right", drop_empty: bool = False
) -> DataFrame:
    """Observed share of ups per score bin, beside the bin's upper edge for comparison.

    ``edges='right'`` puts a score on an edge into the lower bin; ``'open'`` leaves it out of both.
    """
    if edges not in ("right", "open"):
        raise ValueError("edges is 'right' or 'open'")
    scored = df.filter(F.col(p).isNotNull() & F.col(y).isNotNull())
    if edges == "open":
        scored = scored.filter(F.col(p) * bins != F.ceil(F.col(p) * bins))
    counted = scored.groupBy(bin_index(p, bins).alias("bin")).agg(
        F.sum(F.col(y).cast("double")).alias("occurences"), F.count(F.lit(1)).alias("total")
    )
    frame = df.sparkSession.range(1, bins + 1).select(F.col("id").cast("int").alias("bin"))
    total = F.coalesce("total", F.lit(0))
    table = frame.join(counted, "bin", "left").select(
        "bin",
        bin_label("bin", bins).alias("label"),
        ratio("occurences", "total").alias("probability"),
        F.coalesce("occurences", F.lit(0.0)).alias("occurences"),
        total.alias("total"),
        (F.col("bin") / float(bins)).alias("comparison"),
    )
    return table.filter(F.col("total") > 0) if drop_empty else table


def conditional_return(df: DataFrame, p: str, returns: str, threshold: float = 0.8) -> DataFrame:
    """Number of rows and mean return while the score is above, below or between the thresholds."""
    return (
        df.filter(F.col(p).isNotNull() & F.col(returns).isNotNull())
        .groupBy(regime(p, threshold).alias("regime"))
        .agg(F.count(F.lit(1)).alias("n"), F.avg(returns).alias("mean_return"))
    )


def selective_accuracy(df: DataFrame, p: str = "p", y: str = "y", extreme: float = 0.2, by: By = ()) -> DataFrame:
    """Share of rows with a confident score, and the hit rate on them."""
    sure = confident(p, extreme)
    return (
        df.groupBy(*by)
        .agg(
            F.count(F.lit(1)).alias("total"),
            F.count_if(sure).alias("bets"),
            F.avg(F.when(sure, hit_flag(p, y))).alias("hit_rate"),
        )
        .withColumn("coverage", ratio("bets", "total"))
    )
