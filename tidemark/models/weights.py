"""Weights as a long table.

One row per connection: ``layer`` is ``hidden`` or ``output``, ``src`` and ``dst`` number its ends. Input 0 is
the intercept and hidden neuron 0 the constant that feeds the output, so hidden neurons count from 1. A
perceptron without a hidden layer has output rows only, one per input. ``model_id`` and any series columns say
which model a row belongs to.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

HIDDEN, OUTPUT = "hidden", "output"
CONNECTION = ["layer", "src", "dst"]


def connections(inputs: int, neurons: int) -> list[tuple[str, int, int]]:
    """All connections of a net with ``inputs`` inputs (intercept included) and ``neurons`` hidden neurons."""
    if neurons == 0:
        return [(OUTPUT, j, 0) for j in range(inputs)]
    hidden = [(HIDDEN, j, n) for n in range(1, neurons + 1) for j in range(inputs)]
    return hidden + [(OUTPUT, n, 0) for n in range(neurons + 1)]


def weight_rows(models: DataFrame, inputs: int, neurons: int, weight: Column) -> DataFrame:
    """Weights for every row of ``models``; ``weight`` may use its columns and ``layer``, ``src``, ``dst``."""
    structs = [F.struct(F.lit(a).alias("layer"), F.lit(s).alias("src"), F.lit(d).alias("dst")) for a, s, d in connections(inputs, neurons)]
    rows = models.withColumn("_c", F.explode(F.array(*structs)))
    return rows.select(*models.columns, "_c.layer", "_c.src", "_c.dst").withColumn("weight", weight.cast("double"))


def _normal(identity: list[Column], sd: float, seed: int) -> Column:
    """A normal number that depends on the seed and the identity only.

    Digits of two md5 hashes give two uniform numbers, and those a normal one (Box and Muller). Any engine can repeat them.
    """

    def uniform(stream: int) -> Column:
        digits = F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit(str(stream)), *identity)), 1, 13)
        return (F.conv(digits, 16, 10).cast("double") + 1.0) / float(2**52)

    return F.sqrt(-2.0 * F.ln(uniform(1))) * F.cos(2.0 * F.pi() * uniform(2)) * sd


def _identity(columns: list[Column]) -> list[Column]:
    return [F.coalesce(c.cast("string"), F.lit("")) for c in columns]


def random_init(models: DataFrame, inputs: int, neurons: int, sd: float = 1.0, seed: int = 0) -> DataFrame:
    """Normal weights that depend only on the seed, the model and the connection, not on how rows are partitioned."""
    return weight_rows(models, inputs, neurons, _normal(_identity([F.col(c) for c in [*models.columns, *CONNECTION]]), sd, seed))


def random_arrays(models: DataFrame, inputs: int, neurons: int, sd: float = 1.0, seed: int = 0) -> DataFrame:
    """The weights of ``random_init`` as one array per model, the form that fits start from."""
    cells = F.array(*(F.struct(F.lit(a).alias("layer"), F.lit(s).alias("src"), F.lit(d).alias("dst")) for a, s, d in connections(inputs, neurons)))
    own = [F.col(c) for c in models.columns]
    weights = F.transform(cells, lambda c: _normal(_identity([*own, *(c[x] for x in CONNECTION)]), sd, seed))
    return models.select("*", F.lit(neurons).alias("neurons"), weights.alias("weights"))


def constant_init(models: DataFrame, inputs: int, neurons: int, value: float = 0.0) -> DataFrame:
    return weight_rows(models, inputs, neurons, F.lit(value))


def weights_unchanged(before: DataFrame, after: DataFrame, name: str = "unchanged") -> DataFrame:
    """One row that says whether two weight tables hold the same rows. One shuffle, no row order needed."""
    columns = before.columns
    signed = before.withColumn("_sign", F.lit(1)).unionByName(after.select(*columns).withColumn("_sign", F.lit(-1)))
    balance = signed.groupBy(*columns).agg(F.sum("_sign").alias("_sign"))
    return balance.agg((F.count_if(F.col("_sign") != 0) == 0).alias(name))


def save_model(weights: DataFrame, path: str, mode: str = "error") -> None:
    """Store weights sorted by model, so that reading one model skips the row groups of the others.

    A folder per model would mean a file per series; sorted row groups prune as well and stay few.
    """
    order = [c for c in weights.columns if c not in (*CONNECTION, "weight")] + CONNECTION
    weights.repartitionByRange(*order).sortWithinPartitions(*order).write.mode(mode).parquet(path)


def load_model(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
