"""What several of the operators share: word pattern, row identity, tables in the shared folder, bounded Arrow batches.

Operators that return the columns of their input use names that begin with an underscore for what they add on the way; a column of the
input with such a name may be replaced or dropped.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import shared_path

# The white space that separates words: space and the five control characters from tab to carriage return.
SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


def whole(text: Column | str) -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, GAP), lambda w: w != "")


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def stored(df: DataFrame, label: str) -> DataFrame:
    """The rows as a table in the shared folder: computed once, and not computed again when an executor is lost."""
    spark = df.sparkSession
    path = shared_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def is_empty(df: DataFrame) -> bool:
    return df.limit(1).count() == 0


def row_keys(doc_id: str, text: str) -> dict[str, Column]:
    """Two hashes that name a row by its id and its whole text; equal for repeated rows, never null."""
    d, t = F.col(doc_id), F.col(text)
    return {"key1": F.xxhash64(d, t), "key2": F.xxhash64(t, d, F.lit(1))}


#: Row keys that are broadcast at most: two longs each.
KEYS_BROADCAST = 500_000


def without(df: DataFrame, gone: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of `df` whose row key isn't in `gone` (`key1`, `key2`), with the columns of `df`.

    Few keys are broadcast, so that no text is shuffled; more than KEYS_BROADCAST meet the rows in a shuffle.
    """
    gone = stored(gone.select(F.col("key1").alias("_key1"), F.col("key2").alias("_key2")).distinct(), "gone")
    if gone.count() <= KEYS_BROADCAST:
        gone = F.broadcast(gone)
    keyed = df.withColumns({f"_{n}": c for n, c in row_keys(doc_id, text).items()})
    return keyed.join(gone, ["_key1", "_key2"], "left_anti").select(*df.columns)


def slices(batches: Iterable[pa.RecordBatch], column: str, most_bytes: int = 8_000_000) -> Iterator[pa.RecordBatch]:
    """The batches again, cut so that the named text column has at most about `most_bytes` in each (one row at least)."""
    for batch in batches:
        sizes = batch.column(column).nbytes
        if sizes <= most_bytes or batch.num_rows <= 1:
            yield batch
            continue
        step = max(1, batch.num_rows * most_bytes // max(1, sizes))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)
