"""Mixing sources to target weights: Sainte-Laguë quotas of equal-token blocks, then a seeded choice of blocks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import stored, whole, words_of

BLOCK = 128
SHARD = 1024
CAP = 3
#: Rows that a window task orders at most, on average; the number of buckets follows the input.
BUCKET_ROWS = 8192
CHUNK = 1 << 16
# Primes above 2^20, of which the first that doesn't divide the number of blocks permutes them.
STEPS = (1048583, 1048589, 1048601, 1048609)
BITS = 30
RESULT = ("doc_id", "source", "size", "source_size", "target", "taken")


def _key(source: Column) -> Column:
    """A source that is never null, so that joins and windows need no special case."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(""))


def seeded(seed: int, *columns: Column) -> Column:
    """Sixty bits of a hash that any SQL engine with md5 can repeat."""
    parts = [F.lit(str(seed)), *(F.coalesce(c.cast("string"), F.lit("")) for c in columns)]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 15), 16, 10).cast("bigint")


def _range_bucket(h: Column, n: int) -> Column:
    return F.shiftright(F.shiftright(h, BITS) * F.lit(n), BITS)


def cycle_weights(sources: DataFrame, source: str, pattern: Sequence[int] = (5, 2, 1)) -> DataFrame:
    """Weights that repeat a pattern over the sources by code point, null last. One row for each source."""
    by_name = Window.orderBy(F.col(source).asc_nulls_last())
    weights = F.array(*(F.lit(x) for x in pattern))
    return sources.withColumn("weight", F.get(weights, F.pmod(F.row_number().over(by_name) - 1, F.lit(len(pattern)))).cast("bigint"))


def targets(sources: DataFrame, total: int, cap: int = CAP) -> DataFrame:
    """Adds `target`: `total` shared by `weight`, no source above `cap` times its `source_size`; the excess is shared again.

    Each round is one aggregate over the sources; a source that reached its cap stays there, so rounds end.
    """
    most = cap * F.col("source_size")
    level = -1.0
    while True:
        capped = most < F.lit(max(level, 0.0)) * F.col("weight")
        held, weight = sources.agg(
            F.coalesce(F.sum(F.when(capped, most)), F.lit(0)), F.coalesce(F.sum(F.when(~capped, F.col("weight"))), F.lit(0))
        ).first()
        following = (total - held) / weight if weight else max(level, 0.0)
        if following <= level or not weight:
            break
        level = following
    return sources.withColumn("target", F.least(most.cast("double"), F.lit(max(level, 0.0)) * F.col("weight")))


def quotas(sources: DataFrame, total: int, block: int = BLOCK, shard: int = SHARD) -> DataFrame:
    """Blocks by `shard` and `source_key`: seats go to the highest quotients target / (2k + 1), `shard` seats to each shard.

    All seats that can win are made (at most the number of blocks and of sources together) and ranked: within buckets of
    quotients by a window, across buckets by their counts. Ties go by source.
    """
    n_blocks = int(total / block + 0.5)
    n_sources = sources.count()
    if not n_blocks or not n_sources:
        return sources.select(F.lit(0).cast("bigint").alias("shard"), "source_key", F.lit(0).cast("bigint").alias("blocks")).limit(0)
    # Up to this reciprocal quotient there are at least as many seats as blocks.
    last = (2 * n_blocks + n_sources) / total
    seats = sources.filter(F.col("target") > 0).select(
        "source_key", "target", F.floor((F.col("target") * last - 1) / 2 + 1e-6).alias("top")
    ).filter("top >= 0")
    parts = seats.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor(F.col("top") / CHUNK))).alias("part"))
    spread = parts.repartition(F.col("source_key"), F.col("part"))
    low = F.col("part") * CHUNK
    seats = spread.select(
        "source_key", "target", F.explode(F.sequence(low, F.least(F.col("top"), low + CHUNK - 1))).alias("k")
    ).withColumn("order", (2 * F.col("k") + 1) / F.col("target"))
    n_buckets = -(-(n_blocks + n_sources) // BUCKET_ROWS)
    seats = seats.withColumn("bucket", F.floor(F.col("order") / last * n_buckets))
    counts = seats.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("bucket", (F.sum("n").over(Window.orderBy("bucket")) - F.col("n")).alias("before"))
    within = F.row_number().over(Window.partitionBy("bucket").orderBy("order", "source_key"))
    # Spark takes the seats for as few as the sources they come from and would broadcast them.
    ranked = seats.withColumn("within", within).join(before.hint("merge"), "bucket").withColumn("rank", F.col("before") + F.col("within") - 1)
    return ranked.filter(F.col("rank") < n_blocks).groupBy(
        F.floor(F.col("rank") / shard).alias("shard"), "source_key"
    ).agg(F.count(F.lit(1)).alias("blocks"))


def _step(n: Column) -> Column:
    return F.coalesce(*(F.when(F.pmod(F.lit(p), n) != 0, F.lit(p)) for p in STEPS), F.lit(1)).cast("bigint")


def mix(
    df: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: DataFrame | None = None,
    pattern: Sequence[int] = (5, 2, 1), cap: int = CAP, block: int = BLOCK, shard: int = SHARD, seed: int = 17,
    keep: Sequence[str] = (),
) -> tuple[DataFrame, DataFrame]:
    """What the mix takes of every document, and the blocks of each source in each shard.

    Returns one row per row of `df`: `doc_id`, the columns in `keep` (those that aren't named like a result), `source`, `size` (words; null text: 0), `source_size`, `target`
    and `taken` (words, repeats counted); and a table of `shard`, `source` and `blocks`. Sources weigh what `weights`
    (`source`, `weight`) says, others nothing, or else `pattern` repeats over them by code point, null last: a null source is
    a source. All targets together are the words of `df`; none exceeds `cap` times its source.

    The words of a source lie on a line, documents in seeded order. As many whole passes as the quota holds are taken;
    of the rest, a seeded permutation of the line's blocks chooses. So no document is taken more than `cap` times, and a source
    misses its target by the rounding of its quota, about half a block. A source without words gets nothing. Equal rows are told apart by their
    place on the line only, so which of them is taken may differ, but not what the result holds. An empty table gives empty tables.
    """
    keep = [c for c in keep if c not in RESULT]
    kept = F.struct(*(F.col(c) for c in keep)) if keep else F.lit(0)
    sized = stored(
        df.select(
            F.col(doc_id).alias("doc_id"), kept.alias("kept"), F.col(source).alias("source"), _key(F.col(source)).alias("source_key"),
            F.size(words_of(whole(text))).cast("bigint").alias("size"),
            seeded(seed, F.col(doc_id), F.col(text)).alias("place"),
        ),
        "sized",
    )
    rows, total = sized.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    n_buckets = max(1, -(-rows // BUCKET_ROWS))
    sized = sized.withColumn("bucket", _range_bucket(F.col("place"), n_buckets))
    # By source and bucket: a source with a third of all rows is split like any other.
    parts = stored(
        sized.groupBy("source_key", "bucket").agg(F.first("source").alias("source"), F.sum("size").alias("words")), "parts"
    )
    sources = parts.groupBy("source_key").agg(F.first("source").alias("source"), F.sum("words").alias("source_size"))
    if weights is None:
        sources = cycle_weights(sources, "source", pattern)
    else:
        given = weights.select(_key(F.col("source")).alias("source_key"), F.col("weight").cast("bigint"))
        sources = sources.join(given, "source_key", "left").na.fill(0, ["weight"])
    sources = stored(targets(stored(sources, "sources"), total, cap), "targets")
    shards = stored(quotas(sources, total, block, shard), "quotas")

    blocks = shards.groupBy("source_key").agg(F.sum("blocks").alias("blocks"))
    size = F.col("source_size")
    wanted = F.least(F.coalesce("blocks", F.lit(0)) * block, size * cap)
    plan = sources.join(blocks, "source_key", "left").withColumn("wanted", wanted).select(
        "source_key", "source_size", "target",
        F.when(size > 0, F.floor(F.col("wanted") / size)).otherwise(0).cast("bigint").alias("passes"),
        F.when(size > 0, F.pmod("wanted", size)).otherwise(0).cast("bigint").alias("rest"),
        F.floor(size / block).cast("bigint").alias("whole"),
    ).withColumns({
        "chosen": F.ceil(F.col("rest") / block).cast("bigint"),
        "period": F.greatest("whole", F.lit(1).cast("bigint")),
    }).withColumns({"step": _step(F.col("period")), "shift": F.pmod(seeded(seed, F.col("source_key")), F.col("period"))})
    along = Window.partitionBy("source_key").orderBy("bucket")
    offsets = parts.select("source_key", "bucket", (F.sum("words").over(along) - F.col("words")).alias("before"))
    placed = sized.withColumn(
        "within",
        F.sum("size").over(
            Window.partitionBy("source_key", "bucket").orderBy("place", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
        ) - F.col("size"),
    ).join(offsets.join(plan, "source_key"), ["source_key", "bucket"])
    placed = placed.withColumn("at", F.col("before") + F.col("within"))

    def overlap(total: Column, b: Column) -> Column:
        # What is left after the whole blocks comes last, so that the chosen blocks have exactly the words wanted.
        order = F.when(b == F.col("whole"), b).otherwise(F.pmod(b * F.col("step") + F.col("shift"), F.col("period")))
        length = F.least(F.lit(block).cast("bigint"), F.col("rest") - order * block)
        begin = b * block
        shared = F.least(F.col("at") + F.col("size"), begin + length) - F.greatest(F.col("at"), begin)
        return total + F.when(order < F.col("chosen"), F.greatest(shared, F.lit(0).cast("bigint"))).otherwise(0)

    touched = F.sequence(F.floor(F.col("at") / block), F.floor((F.col("at") + F.col("size") - 1) / block))
    partly = F.aggregate(touched, F.lit(0).cast("bigint"), overlap)
    taken = F.col("passes") * F.col("size") + F.when((F.col("size") > 0) & (F.col("chosen") > 0), partly).otherwise(0)
    # In two steps, so that no kept column is taken for one of the same name that the expression means.
    result = placed.withColumn("taken", taken.cast("bigint")).select(
        "doc_id", *(F.col("kept")[c].alias(c) for c in keep), "source", "size", "source_size", "target", "taken"
    )
    named = shards.join(sources.select("source_key", "source"), "source_key").select("shard", "source", "blocks")
    return result, named
