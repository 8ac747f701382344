"""Filter interaction audit: what each step of every filter order removes, by contractions of contingency tensors.

Documents are counted by part and by the set of filters that they fail. The counts of a part fill a tensor with one axis of length two
(pass, fail) for each filter, and every figure of the audit is a contraction of it: a vector for each axis selects pass, fail or both.
Nothing is filtered again for any of the orders, so the documents are read once, however many orders there are.

Spark counts, and pre-aggregates before it shuffles: no task gets the rows of a part, only its counts. A part has at most
2^filters patterns, so its tensor is bounded.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import permutations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import slices

PASS, FAIL, ANY = (1, 0), (0, 1), (1, 1)
#: The orders of more filters than these are too many to list; the tensor itself would allow more.
MOST_FILTERS = 7


@lru_cache(maxsize=8)
def selections(filters: str) -> tuple[pd.DataFrame, dict[str, np.ndarray]]:
    """All steps of all orders, and for each figure the vectors (step, axis, pass or fail) that select its cells."""
    steps, kept, removed, failing, alone = [], [], [], [], []
    for order in permutations(range(len(filters))):
        for at, own in enumerate(order):
            before, name = order[:at], "".join(filters[i] for i in order)
            steps.append((name, at + 1, own))
            kept.append([PASS if i in before or i == own else ANY for i in range(len(filters))])
            removed.append([FAIL if i == own else PASS if i in before else ANY for i in range(len(filters))])
            failing.append([FAIL if i == own else ANY for i in range(len(filters))])
            alone.append([FAIL if i == own else PASS for i in range(len(filters))])
    named = {"kept": kept, "removed": removed, "failing": failing, "unique_fails": alone}
    return pd.DataFrame(steps, columns=["filter_order", "step", "filter"]), {k: np.array(v, np.int64) for k, v in named.items()}


def contract(tensors: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """For tensors (…, 2, 2, …) and vectors (step, axis, 2): the selected sums (…, step)."""
    axes = vectors.shape[1]
    letters = "abcdefghijkl"[:axes]
    expression = f"...{letters},{','.join('s' + a for a in letters)}->...s"
    return np.einsum(expression, tensors, *(vectors[:, i] for i in range(axes)), optimize=True)


def figures(tensors: np.ndarray, filters: str) -> dict[str, np.ndarray]:
    """The audit of some parts: tensors (part, total, 2, 2, …) give arrays (part, step); total 0 counts documents."""
    steps, vectors = selections(filters)
    documents = tensors[:, 0]
    removed = contract(tensors, vectors["removed"])
    result = {
        "kept": contract(documents, vectors["kept"]),
        "removed": removed[:, 0],
        "redundant": contract(documents, vectors["failing"]) - removed[:, 0],
        "unique_fails": contract(documents, vectors["unique_fails"]),
        "lost": removed[:, 1:],
    }
    own = steps["filter"].to_numpy()
    sums = np.stack([removed[:, 0][:, own == i].sum(axis=1) for i in range(len(filters))], axis=1)
    return result | {"shapley": sums[:, own]}


def audit(counts: DataFrame, filters: str, *, part: str = "part", pattern: str = "pattern", documents: str = "n", lost: list[str] = ()) -> DataFrame:
    """One row for each part, order of filters and step, from counts by part and pattern of failures.

    `filters` has one character per filter; bit i of `pattern` says that filter i fails. `documents` counts the documents of a row, the
    columns `lost` some of them (say, the good ones); several rows of one part and pattern add up. Returned are `part`,
    `filter_order`, `step` (from 1) and, as long counts within the part, `kept` after the step, `removed` by it, `redundant` (failing its
    filter, but removed earlier), `unique_fails` (failing no other filter), the removed ones of each column `lost`, and `shapley`,
    the filter's `removed` summed over all orders. Without rows there is no part and no row. A null part is one of its own.
    """
    if not 1 <= len(set(filters)) == len(filters) <= MOST_FILTERS:
        raise ValueError(f"one to {MOST_FILTERS} different characters name the filters")
    shape = (2,) * len(filters)
    names = [documents, *lost]
    # The first filter is the first axis, so its bit comes last in the cell's number.
    place = sum((F.col(pattern).bitwiseAND(1 << i).cast("boolean").cast("int") * (1 << (len(filters) - 1 - i)) for i in range(len(filters))), F.lit(0))
    totals = [F.sum(F.col(c)).cast("long").alias(f"t{i}") for i, c in enumerate(names)]
    cells = counts.groupBy(F.col(part).alias("part"), place.alias("cell")).agg(*totals)
    tensors = cells.groupBy("part").agg(F.collect_list(F.struct("cell", *(f"t{i}" for i in range(len(names))))).alias("cells"))

    def contracted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        steps, _ = selections(filters)
        for batch in batches:
            flat = np.zeros((len(batch), len(names), 1 << len(filters)), np.int64)
            for i, entries in enumerate(batch["cells"]):
                for entry in entries:
                    flat[i, :, entry["cell"]] = [entry[f"t{j}"] for j in range(len(names))]
            found = figures(flat.reshape(len(batch), len(names), *shape), filters)
            rows = {"part": np.repeat(batch["part"].to_numpy(), len(steps))}
            rows |= {c: np.tile(steps[c].to_numpy(), len(batch)) for c in ("filter_order", "step")}
            rows |= {c: found[c].ravel() for c in ("kept", "removed", "redundant", "unique_fails", "shapley")}
            yield pd.DataFrame(rows | {c: found["lost"][:, j].ravel() for j, c in enumerate(lost)})

    longs = ", ".join(f"`{c}` long" for c in ("kept", "removed", "redundant", "unique_fails", "shapley", *lost))
    kind = cells.schema["part"].dataType.simpleString()
    return tensors.mapInPandas(contracted, f"part {kind}, filter_order string, step int, {longs}")


# -- the five text filters ---------------------------------------------------------------------

# Limits of the filters and the characters that they count.
FEWEST_WORDS, DISTINCT_SHARE, CAPITAL_SHARE = 50, 65, 5
CAPITALS, MARKS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"#$%&*|"
_CONTINUED = bytes(range(0x80, 0xC0))


def text_failures(text: bytes) -> int:
    """Bits of the filters that one whole text fails: too few words, few distinct ones, many capitals, any mark."""
    words = text.split()  # of bytes: between spaces and the five control characters from tab to carriage return
    capitals = len(text) - len(text.translate(None, CAPITALS))
    code_points = len(text.translate(None, _CONTINUED))
    return (
        (len(words) < FEWEST_WORDS)
        | (100 * len(set(words)) < DISTINCT_SHARE * len(words)) << 1
        | (100 * capitals > CAPITAL_SHARE * code_points) << 2
        | (len(text) != len(text.translate(None, MARKS))) << 3
    )


def text_pattern(text: Column) -> Column:
    @F.arrow_udf(T.LongType())
    def judge(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for array in batches:
            parts = slices([pa.record_batch([array], names=["t"])], "t")
            yield pa.array([text_failures(t) for p in parts for t in p.column(0).cast(pa.binary()).to_pylist()], pa.int64())

    return judge(F.coalesce(text, F.lit("")))


def failure_counts(documents: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """Counts `n`, `good_lost` and `toxic_lost` by `part` and `pattern` of the failures A to E (bits 0 to 4).

    E fails a text that a smaller id has as well, anywhere in the table. A null text is empty, a null part the empty string. Null ids
    compare with none: such rows pass E and fail no other. Rows that repeat an id and its text are documents of their own; only a
    smaller id fails them. An id with several labels counts as good (toxic) if one of them says so.

    Only hashes of texts are shuffled. Equal texts of a part are one row before they meet, so a text of which there are very many
    copies is not a hot key.
    """
    marks = labels.select(F.col(doc_id).alias("_id"), (F.col("quality") == 1).alias("_good"), (F.col("toxic") == 1).alias("_toxic"))
    marks = marks.groupBy("_id").agg(F.max("_good").alias("_good"), F.max("_toxic").alias("_toxic"))
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = documents.select(
        F.col(doc_id).alias("_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), text_pattern(F.col(text)).alias("pattern"),
        F.xxhash64(whole).alias("_k1"), F.xxhash64(F.lit(1), whole, F.lit(2)).alias("_k2"),
    ).join(marks, "_id", "left").withColumns({c: F.coalesce(F.col(c), F.lit(False)) for c in ("_good", "_toxic")})
    same_text, kind = ["_k1", "_k2", "pattern"], ["part", "_good", "_toxic"]
    by_id = rows.groupBy("_id", *same_text, *kind).agg(F.count(F.lit(1)).alias("_n"))
    smallest = F.min(F.when(F.col("_id").isNotNull(), F.struct("_id", "_n")))
    groups = by_id.groupBy(*same_text, *kind).agg(
        F.sum("_n").alias("_n"), F.coalesce(F.sum(F.when(F.col("_id").isNull(), F.col("_n"))), F.lit(0)).alias("_loose"), smallest.alias("_first")
    )
    first = F.min("_first._id").over(Window.partitionBy("_k1", "_k2"))
    ahead = F.when(F.col("_first._id") == F.col("_smallest"), F.col("_first._n")).otherwise(0)
    split = groups.withColumn("_smallest", first).withColumn("_passing", F.col("_loose") + ahead)
    both = F.inline(F.array(
        F.struct(F.col("pattern"), F.col("_passing").alias("n")),
        F.struct(F.col("pattern").bitwiseOR(16).alias("pattern"), (F.col("_n") - F.col("_passing")).alias("n")),
    ))
    cells = split.select(*kind, both).groupBy("part", "pattern")
    return cells.agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("_good"), F.col("n")).otherwise(0)).alias("good_lost"),
        F.sum(F.when(F.col("_toxic"), F.col("n")).otherwise(0)).alias("toxic_lost"),
    ).filter("n > 0")
