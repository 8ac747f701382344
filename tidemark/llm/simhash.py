"""SimHash near-duplicates: an inverted index on bytes at their positions, count filtering, and exact bit distance."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import is_empty, row_keys, slices, stored, without

SEED = 42
SHINGLE = 4
MOST_BITS = 4
BYTES = 8
COUNTED = 1 << 15


def fingerprint(text: bytes, words: int = SHINGLE) -> int:
    """SimHash of the word shingles of a whole text, repeats included; zero for a text without words."""
    import xxhash

    tokens = text.lower().split()
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    ends = list(accumulate(tokens, lambda at, w: at + 1 + len(w), initial=-1))
    width = min(words, len(tokens))
    n = len(tokens) - width + 1
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for low in range(0, n, COUNTED):
        high = min(n, low + COUNTED)
        hashes = np.array([digest(joined[ends[i] + 1 : ends[i + width]], SEED) for i in range(low, high)], np.uint64)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, BYTES), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(ones * 2 > n, bitorder="little")
    return int(bits.view(np.uint64)[0])


def fingerprints(text: Column, words: int = SHINGLE) -> Column:
    """The fingerprint of each whole text as a signed 64-bit number; null counts as empty."""

    @F.arrow_udf(T.LongType())
    def sketch(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for array in batches:
            out = []
            for part in slices([pa.record_batch([array], names=["t"])], "t"):
                out += [fingerprint(t or b"", words) for t in part.column(0).cast(pa.binary()).to_pylist()]
            yield pa.array(np.array(out, np.uint64).view(np.int64))

    return sketch(F.coalesce(text, F.lit("")))


def hex_digits(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def byte_lists(size: int) -> list[tuple[int, ...]]:
    """Position sets of one size such that any four of the eight byte positions contain one of them.

    Three at a time it is Turán's construction, with 20 sets: a set lies in one of three groups of positions, or has two in
    one group and one in the next. Four at a time it is all 70.
    """
    if size == 4:
        return list(combinations(range(BYTES), 4))
    groups = [range(0, 3), range(3, 6), range(6, 8)]
    inside = [t for g in groups for t in combinations(g, 3)]
    across = [(*two, x) for i, g in enumerate(groups) for two in combinations(g, 2) for x in groups[(i + 1) % 3]]
    return [tuple(sorted(t)) for t in inside + across]


def _byte(fp: Column, position: int) -> Column:
    return F.shiftrightunsigned(fp, 8 * position).bitwiseAND(F.lit(255))


def _list_key(fp: Column, number: int, positions: tuple[int, ...]) -> Column:
    key = F.lit(number).cast("bigint")
    for p in positions:
        key = F.shiftleft(key, 8).bitwiseOR(_byte(fp, p))
    return key


def _shared(a: Column, b: Column) -> Column:
    """Bit p is set if the bytes at position p are equal."""
    difference = a.bitwiseXOR(b)
    mask = F.lit(0)
    for p in range(BYTES):
        mask = mask.bitwiseOR(F.when(_byte(difference, p) == 0, 1 << p).otherwise(0))
    return mask


def links(
    distinct: DataFrame, most_bits: int = MOST_BITS, list_limit: int = 512, key_bytes: int | None = None
) -> DataFrame:
    """Pairs (a, b) of different fingerprints whose connected components are those of all pairs within `most_bits` bits.

    Fingerprints within `most_bits` (at most 4) share at least 8 - most_bits bytes at their positions. The inverted index
    holds each fingerprint under sets of position and byte values, so that such a pair meets in one list at least. In a list,
    the shared positional bytes of each pair are tallied; pairs with fewer than the guaranteed number go, and so do pairs that meet
    in an earlier list too; the bit distance verifies the others. Lists are keyed by three bytes, or by four where there are so many
    fingerprints that chance would fill the shorter ones: both find the same pairs.

    A list above `list_limit` isn't paired. Its fingerprints are linked through midpoints: two are within 2r bits exactly if
    some number is within r bits of both, so all that share a midpoint are linked to the smallest of them. That takes 2081
    rows for each such fingerprint, however many there are, and loses no link.
    """
    if most_bits not in (0, 2, 4):
        raise ValueError("most_bits must be 0, 2 or 4")
    if key_bytes is None:
        key_bytes = 3 if distinct.count() < 50_000_000 else 4
    lists = byte_lists(key_bytes)
    fp = F.col("fp")
    index = distinct.select("fp", F.explode(F.array(*(_list_key(fp, i, t) for i, t in enumerate(lists)))).alias("key"))
    sizes = index.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    # Spark takes the index for as small as the fingerprints it comes from; a hint keeps it from broadcasting either side.
    listed = stored(index.join(sizes.hint("merge"), "key"), "lists")

    masks = [sum(1 << p for p in t) for t in lists]
    first = F.array(*(F.lit(next((i for i, s in enumerate(masks) if s & m == s), -1)) for m in range(256)))
    short = listed.filter(F.col("n") <= list_limit)
    left, right = short.select("key", F.col("fp").alias("a")), short.select("key", F.col("fp").alias("b"))
    a, b = F.col("a"), F.col("b")
    shared = _shared(a, b)
    found = left.join(
        right,
        (left["key"] == right["key"]) & (a < b) & (F.bit_count(shared) >= BYTES - most_bits)
        & (F.bit_count(a.bitwiseXOR(b)) <= most_bits) & (F.get(first, shared) == F.shiftright(left["key"], 8 * key_bytes)),
    ).select("a", "b")

    hot = listed.filter(F.col("n") > list_limit).select("fp").distinct()
    if is_empty(hot):
        return found
    flips = [0] + [sum(1 << i for i in t) for r in range(1, most_bits // 2 + 1) for t in combinations(range(64), r)]
    signed = F.array(*(F.lit(int(np.uint64(x).astype(np.int64))) for x in flips))
    near = hot.repartition("fp").select("fp", F.explode(F.transform(signed, lambda x: fp.bitwiseXOR(x))).alias("middle"))
    least = near.groupBy("middle").agg(F.min("fp").alias("a"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    through = near.join(least.hint("merge"), "middle").filter("fp <> a").select("a", F.col("fp").alias("b")).distinct()
    return found.unionByName(through)


def components(edges: DataFrame) -> DataFrame:
    """`node` and `root`, the smallest node of its connected component, for every node that isn't its own root.

    Alternates two steps until nothing changes: every node hands its larger neighbours to its smallest neighbour, then its
    smaller ones. Each result is a table, so a lost executor doesn't repeat the steps before.
    """
    def pointing(rows: DataFrame) -> DataFrame:
        return rows.filter("u <> v").distinct()

    def digest(rows: DataFrame) -> tuple:
        return tuple(rows.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    edges = stored(pointing(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))), "edges")
    state = digest(edges)
    while state[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("low")).withColumn("low", F.least("u", "low"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("low").alias("v"))
        edges = stored(pointing(large.unionByName(edges.join(least, "u").select("u", F.col("low").alias("v")))), "large")
        least = edges.groupBy("u").agg(F.min("v").alias("low"))
        small = edges.join(least, "u").select(F.col("v").alias("u"), F.col("low").alias("v"))
        edges = stored(pointing(small.unionByName(least.select("u", F.col("low").alias("v")))), "small")
        before, state = state, digest(edges)
        if state == before:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def near_duplicates(
    df: DataFrame, *, doc_id: str = "doc_id", text: str = "text", words: int = SHINGLE, most_bits: int = MOST_BITS,
    list_limit: int = 512, key_bytes: int | None = None,
) -> DataFrame:
    """One row per row of `df`: `doc_id`, `key1`, `key2` (of `row_keys`), `fingerprint`, `component_id` and `keeper`.

    Rows whose fingerprints differ in at most `most_bits` bits are linked; `component_id` is the smallest id that links reach.
    Equal fingerprints count once in everything but the last join, so a text with any number of copies is one entry of the index.
    `keeper` is true for one row key of each component: that of the smallest id (null last, then by key). A null text counts as
    empty; texts without words have fingerprint zero and are linked like others; a null id is never a component's id unless all
    its ids are null. Repeated rows share key and keeper flag. An empty table gives an empty result. Other columns aren't looked at.
    """
    rows = stored(
        df.select(F.col(doc_id).alias("doc_id"), *(c.alias(n) for n, c in row_keys(doc_id, text).items()),
                  fingerprints(F.col(text), words).alias("fp")),
        "fingerprints",
    )
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key1", "key2")
    distinct = stored(rows.groupBy("fp").agg(F.min(order).alias("lowest")), "distinct")
    roots = components(links(distinct.select("fp"), most_bits, list_limit, key_bytes))
    members = distinct.join(roots, distinct["fp"] == roots["node"], "left").select(
        "fp", "lowest", F.coalesce("root", "fp").alias("root")
    )
    lowest = members.groupBy("root").agg(F.min("lowest").alias("keep"))
    placed = members.select("fp", "root").join(lowest, "root").select("fp", "keep")
    return rows.join(placed, "fp").select(
        "doc_id", "key1", "key2", hex_digits(F.col("fp")).alias("fingerprint"), F.col("keep.doc_id").alias("component_id"),
        ((F.col("key1") == F.col("keep.key1")) & (F.col("key2") == F.col("keep.key2"))).alias("keeper"),
    )


def deduplicated(df: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One document of each component, with all columns of `df`: the one with the smallest id, once if it is repeated."""
    judged = near_duplicates(df, doc_id=doc_id, text=text, **options).groupBy("key1", "key2", "keeper").agg(F.count(F.lit(1)).alias("n"))
    judged = stored(judged.filter("not keeper or n > 1"), "judged")
    kept = without(df, judged.filter("not keeper"), doc_id, text)
    if is_empty(judged.filter("keeper")):
        return kept
    names = {f"_{n}": c for n, c in row_keys(doc_id, text).items()}
    return kept.withColumns(names).dropDuplicates(list(names)).select(*df.columns)
