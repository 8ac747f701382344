"""Reading delimited series files and repairing their text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.scalars import ColumnLike, as_column


def read_series(
    spark: SparkSession,
    path: str | list[str],
    schema: T.StructType | str,
    sep: str = ",",
    null_value: str | None = None,
) -> DataFrame:
    """Read delimited files with a header row and an explicit schema.

    ``null_value`` names the text that stands for a gap (``.`` in some published series); empty fields are
    always NULL. Text columns that hold only blanks become NULL too.
    """
    reader = spark.read.schema(schema).option("header", True).option("sep", sep).option("mode", "FAILFAST")
    if null_value is not None:
        reader = reader.option("nullValue", null_value)
    return blank_to_null(reader.csv(path))


def scan_series(spark: SparkSession, path: str | list[str], columns: list[str]) -> DataFrame:
    """Read the named columns of parquet files; only those are read from disk."""
    return spark.read.parquet(*([path] if isinstance(path, str) else path)).select(*columns)


def blank_to_null(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Blank text to NULL in all (or the given) string columns."""
    wanted = [
        f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) and (columns is None or f.name in columns)
    ]
    return df.withColumns({c: F.when(F.trim(c) != "", F.col(c)) for c in wanted}) if wanted else df


def marker_to_null(c: ColumnLike, marker: str = ".") -> Column:
    """Text number whose gaps are written as a marker."""
    c = as_column(c)
    return F.when(F.trim(c) != marker, c).try_cast("double")


def parse_day(c: ColumnLike, pivot: int = 68) -> Column:
    """``dd.mm.yyyy`` or ``dd.mm.yy`` text to a date; anything else becomes NULL.

    Two-digit years up to ``pivot`` are 20xx, the others 19xx.
    """
    c = F.trim(as_column(c))
    short = c.rlike(r"^\d{1,2}\.\d{1,2}\.\d{2}$")
    head, year = F.regexp_extract(c, r"^(.*\.)", 1), F.right(c, F.lit(2))
    century = F.when(year.try_cast("int") <= pivot, "20").otherwise("19")
    full = F.when(short, F.concat(head, century, year)).otherwise(c)
    return F.try_to_date(full, "d.M.yyyy")
