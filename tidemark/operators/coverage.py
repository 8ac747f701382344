"""Selective accuracy at every threshold: how often the most confident scores are right, however many of them are taken."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import hit_flag, ratio
from tidemark.session import shared_path

#: Distinct confidences that one task sums up.
RANGE_ROWS = 250_000


def coverage_curve(df: DataFrame, p: str = "p", y: str = "y", confidence: Column | None = None, range_rows: int = RANGE_ROWS) -> DataFrame:
    """One row for each distinct confidence, the highest first in rank: rows at least that confident (``bets``), their share of all
    (``coverage``) and how many were hits (``hit_rate``).

    The confidence is the distance of the score to one half unless given. Rows of equal confidence belong together: they are summed up
    before anything is ordered. The running sums then go over ranges of the confidence, as many tasks as they need, each of which starts with
    the totals of the ranges above. Rows with a NULL score or label are left out.
    """
    spark = df.sparkSession
    confidence = F.abs(F.col(p) - 0.5) if confidence is None else confidence
    rows = df.filter(F.col(p).isNotNull() & F.col(y).isNotNull())
    sums = rows.groupBy(confidence.alias("confidence")).agg(F.count(F.lit(1)).alias("_n"), F.sum(hit_flag(p, y).cast("long")).alias("_hits"))
    path = shared_path(spark, "coverage")
    sums.write.parquet(path)
    sums = spark.read.parquet(path)
    ranges = max(1, -(-sums.count() // range_rows))
    ordered = shared_path(spark, "coverage")
    # Stored, so that the totals and the rows that they are added to come from the same ranges.
    sums.repartitionByRange(ranges, F.desc("confidence")).withColumn("_range", F.spark_partition_id()).write.parquet(ordered)
    placed = spark.read.parquet(ordered)
    totals = placed.groupBy("_range").agg(F.sum("_n").alias("_t"), F.sum("_hits").alias("_h"))
    earlier = totals.select(F.col("_range").alias("_other"), F.col("_t").alias("_ot"), F.col("_h").alias("_oh"))
    # One row per range, of 250,000 confidences each.
    above = totals.join(F.broadcast(earlier), F.col("_other") < F.col("_range"), "left").groupBy("_range").agg(
        F.coalesce(F.sum("_ot"), F.lit(0)).alias("_above_n"), F.coalesce(F.sum("_oh"), F.lit(0)).alias("_above_hits")
    )
    total = totals.agg(F.sum("_t").alias("_total"))
    running = Window.partitionBy("_range").orderBy(F.desc("confidence")).rowsBetween(Window.unboundedPreceding, 0)
    curve = placed.select("*", F.sum("_n").over(running).alias("_rn"), F.sum("_hits").over(running).alias("_rh"))
    curve = curve.join(F.broadcast(above), "_range").join(F.broadcast(total))
    bets, hits = F.col("_rn") + F.col("_above_n"), F.col("_rh") + F.col("_above_hits")
    return curve.select("confidence", bets.alias("bets"), ratio(hits, bets).alias("hit_rate"), ratio(bets, "_total").alias("coverage"))
