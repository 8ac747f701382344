"""Scoring rows as they arrive.

A score is row-local arithmetic, so the batch functions apply to a streaming DataFrame unchanged. Nothing is kept
between rows; the sink's checkpoint records which input files are done.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from tidemark.models.scoring import Net, score


def score_files(
    spark: SparkSession, path: str, schema: StructType, features: list[str], net: Net | DataFrame, out: str, checkpoint: str
) -> StreamingQuery:
    """Score every parquet file below ``path`` that is not scored yet and append the rows to ``out``.

    ``checkpoint`` is a folder that belongs to ``out`` and must be the same in every call: it says which files are done. The sink
    tells batches apart by its numbers, so another folder for the same output would lose files.
    """
    rows = spark.readStream.schema(schema).parquet(path)
    return (
        score(rows, features, net)
        .writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
