"""Delimited files whose headers differ from one generation to the next, with an account of every cell that could not be read.

The files are scanned once, as lines with their place, and kept as cells. Each file's own header then says which cell belongs to which
column; what a cell holds that its column can't take goes to the ledger with file, line, column and text instead of ending the job or
vanishing. Large files are read in blocks by many tasks; a line's number is its place in its block plus the lines of the blocks before.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.panel import attach
from tidemark.session import shared_path
from tidemark.sources.series_csv import parse_day


@dataclass(frozen=True)
class Reading:
    """``rows`` with the columns of the schema, `file` and `line`; ``rejected`` cells (`file`, `line`, `column`, `text`), and ``counts`` by
    file and column of `good` cells, `gaps` and `bad` ones, which together are the rows of the file."""

    rows: DataFrame
    rejected: DataFrame
    counts: DataFrame


def _value(text: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.StringType):
        return text
    if isinstance(kind, T.DateType):
        return F.coalesce(parse_day(text), F.try_to_date(text, "yyyy-MM-dd"))
    return text.try_cast(kind)


def read_ledger(
    spark: SparkSession, path: str | list[str], schema: T.StructType, aliases: dict[str, list[str]] | None = None, sep: str = ",",
    gaps: tuple[str, ...] = ("", "."),
) -> Reading:
    """Read files that each begin with a header, in any order of columns and with any others among them.

    ``aliases`` gives further names that a column has had. A column that a file doesn't have is NULL, which is no fault; neither are the texts
    ``gaps``. Rejected are cells that aren't of their column's type, cells that a short line lacks (their text is NULL) and cells beyond the
    header (their column is NULL). Blank lines are skipped but counted. Cells may stand in double quotes but must not hold the separator.
    Where a header repeats a name, the first one counts.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_id"), F.split("value", re.escape(sep), -1).alias("_cells"),
    )
    stored = shared_path(spark, "cells")
    clean = F.transform("_cells", lambda c: F.regexp_replace(F.trim(c), '^"(.*)"$', "$1"))
    lines.withColumn("_cells", clean).write.parquet(stored)
    lines = spark.read.parquet(stored)
    blocks = lines.groupBy("file", "_block").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("file", "_block", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    n_blocks = blocks.count()
    numbered = attach(lines, blocks, ["file", "_block"], n_blocks).withColumn("line", F.col("_before") + F.col("_id") - F.col("_first") + 1)
    headers = numbered.filter("line = 1").select("file", F.col("_cells").alias("_header"))
    body = attach(numbered.filter("line > 1"), headers, ["file"], n_blocks).filter(F.array_join("_cells", "") != "")

    parts: dict[str, Column] = {}
    for i, field in enumerate(schema.fields):
        places = [F.nullif(F.array_position("_header", name), F.lit(0)) for name in (field.name, *(aliases or {}).get(field.name, []))]
        at = F.coalesce(*places)
        text = F.get("_cells", (at - 1).cast("int"))
        given = ~text.isin(*gaps)
        value = F.when(given, _value(text, field.dataType))
        bad = at.isNotNull() & (text.isNull() | (given & value.isNull()))
        parts[f"_value_{i}"] = value
        parts[f"_bad_{i}"] = F.coalesce(bad, F.lit(False))
        parts[f"_text_{i}"] = text
        parts[f"_here_{i}"] = at.isNotNull()
    read = body.withColumns(parts)
    columns = range(len(schema.fields))
    named = [schema.fields[i].name for i in columns]
    rows = read.select(*(F.col(f"_value_{i}").alias(named[i]) for i in columns), "file", "line")
    faults = [F.when(F.col(f"_bad_{i}"), F.struct(F.lit(named[i]).alias("column"), F.col(f"_text_{i}").alias("text"))) for i in columns]
    beyond = F.when(
        F.size("_cells") > F.size("_header"),
        F.transform(F.slice("_cells", F.size("_header") + 1, F.greatest(F.size("_cells") - F.size("_header"), F.lit(0))), lambda c: F.struct(F.lit(None).cast("string").alias("column"), c.alias("text"))),
    )
    listed = F.concat(F.array_compact(F.array(*faults)), F.coalesce(beyond, F.array().cast("array<struct<column:string,text:string>>")))
    rejected = read.select("file", "line", F.inline(listed))
    sums = [F.struct(F.lit(named[i]).alias("column"), *(F.col(f"_{kind}_{i}").alias(kind) for kind in ("here", "good", "gaps", "bad"))) for i in columns]
    tally = read.groupBy("file").agg(*(
        a for i in columns for a in (
            F.bool_or(f"_here_{i}").alias(f"_here_{i}"),
            F.count_if(F.col(f"_value_{i}").isNotNull()).alias(f"_good_{i}"),
            F.count_if(F.col(f"_value_{i}").isNull() & ~F.col(f"_bad_{i}")).alias(f"_gaps_{i}"),
            F.count_if(F.col(f"_bad_{i}")).alias(f"_bad_{i}"),
        )
    ))
    counts = tally.select("file", F.inline(F.array(*sums))).filter("here").drop("here")
    return Reading(rows, rejected, counts)
