"""Online gradient descent: weights change after every row, in series order.

One fit is a serial chain by definition, so the work is spread over fits. Spark groups series (and batches of
restarts) into tasks of bounded size; inside a task all its models advance together, one row position at a time,
as numpy arrays over models. A model's result does not depend on which others share its task.

A series too long for one task is trained slice by slice. Where the cluster can hold its rows, slices stay in the tasks of
a barrier stage and models travel from slice to slice (``models.relay``); otherwise a job per slice trains the models on it, and only
weights, last steps and curves travel between jobs. The updates and their order are the same.

Rows with a NULL or NaN feature or label are left out, as the last row of a series has no label.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.models import relay as barrier
from tidemark.models.fleet import Fleet
from tidemark.models.packed import pack, unpack
from tidemark.operators.selection import complete_cases
from tidemark.panel import ROW_NUMBER, SERIES_ROWS, Panel, attach
from tidemark.session import remove, shared_dir, shared_path

WEIGHT, TRACE, SCORE, SNAPSHOT = "weight", "trace", "score", "snapshot"
SETTINGS = {"eta": "double", "momentum": "double", "epochs": "int"}
#: One row per model (kind ``weight``): weights and last steps, the settings, and what each epoch has cost so far. Rows of the other kinds
#: hold pieces of traces and scores in the same columns.
COLUMNS = {
    "kind": "string", "neurons": "int", "weights": "array<double>", "steps": "array<double>", **SETTINGS,
    "done": "long", "sse": "array<double>", "hits": "array<long>", "length": "long", "numbers": "array<long>",
}


#: Rows of the short series that are trained together. A Python worker holds one group at a time, so its memory doesn't grow with the table.
ROWS_PER_GROUP = 50_000


def groups_of(spark: SparkSession, rows: int, rows_per_task: int) -> int:
    """Groups that the series are dealt to; a task may take several, one after another."""
    return max(spark.sparkContext.defaultParallelism, -(-rows // min(rows_per_task, ROWS_PER_GROUP)))


@dataclass(frozen=True)
class Fit:
    """Outcome of a fit: final weights, one curve row per model and epoch, and optionally a weight trace and the last scores."""

    table: DataFrame
    ids: list[str]
    inputs: int

    @property
    def packed(self) -> DataFrame:
        """One row per model with its weights as an array, in the order of ``connections``."""
        return self.table.filter(F.col("kind") == WEIGHT).select(*self.ids, "neurons", "weights")

    @property
    def weights(self) -> DataFrame:
        return unpack(self.packed, self.ids, self.inputs)

    @property
    def curve(self) -> DataFrame:
        """Half squared error summed over the epoch and share of hits, both measured before each update."""
        rows = self.table.filter(F.col("kind") == WEIGHT).select(*self.ids, "length", F.posexplode(F.arrays_zip("sse", "hits")).alias("_at", "_epoch"))
        return rows.select(
            *self.ids, (F.col("_at") + 1).alias("epoch"), F.col("_epoch.sse").alias("sse"),
            F.try_divide(F.col("_epoch.hits"), F.col("length")).alias("success"),
        )

    @property
    def scores(self) -> DataFrame:
        """Score ``p`` and ``difference`` (label minus score) of each row ``rn`` in the last epoch, before its update.

        Rows are numbered within the series, from 1, without those left out. Asked for with ``keep_scores``.
        """
        rows = self.table.filter(F.col("kind") == SCORE).select(*self.ids, F.inline(F.arrays_zip("numbers", "weights", "steps")))
        return rows.select(*self.ids, F.col("numbers").alias("rn"), F.col("weights").alias("p"), F.col("steps").alias("difference"))

    @property
    def trace(self) -> DataFrame:
        """Weights before each traced update; ``step`` counts the updates of the model from 0."""
        rows = self.table.filter(F.col("kind") == TRACE).select(*self.ids, "numbers", F.posexplode("weights").alias("_at", "weight"))
        step = F.element_at("numbers", (F.floor(F.col("_at") / self.inputs) + 1).cast("int"))
        return rows.select(*self.ids, step.alias("step"), (F.col("_at") % self.inputs).alias("src"), "weight")

    @property
    def snapshots(self) -> DataFrame:
        """Packed weights (``neurons``, ``weights``) before update ``step``, that is after so many rows. Asked for with ``snapshot_shares``."""
        rows = self.table.filter(F.col("kind") == SNAPSHOT).select(*self.ids, "neurons", F.col("weights").alias("_all"), F.size("numbers").alias("_k"), F.posexplode("numbers").alias("_at", "step"))
        size = (F.size("_all") / F.col("_k")).cast("int")
        return rows.select(*self.ids, "step", "neurons", F.slice("_all", F.col("_at") * size + 1, size).alias("weights"))

    def pinned(self) -> Fit:
        """Run the fit now and keep its small result, so that weights and curve do not train twice."""
        shared_dir(self.table.sparkSession)
        return Fit(self.table.checkpoint(), self.ids, self.inputs)


def fit_online(
    panel: Panel,
    features: list[str],
    label: str,
    init: DataFrame,
    *,
    eta: float | None = 0.1,
    momentum: float | None = 0.0,
    epochs: int | None = 1,
    perceptron: bool = False,
    batches: int = 1,
    trace_every: int | None = None,
    keep_scores: bool = False,
    snapshot_shares: tuple[float, ...] = (),
    rows_per_task: int = 500_000,
    relay: bool | None = None,
    **relay_options,
) -> Fit:
    """Fit every model of ``init`` on the rows of its series.

    ``init`` is a weight table, long or packed, with the panel's series columns and ``model_id``; models with hidden rows are
    perceptrons with one hidden layer, the others plain logistic ones. ``eta``, ``momentum`` and ``epochs`` may be
    ``None`` to be read from columns of ``init``, one value per model. ``perceptron`` lets the plain model learn from
    the predicted class instead of the score. ``batches`` spreads the models of one series over that many tasks.
    ``trace_every`` records the weights of models without hidden neurons; ``keep_scores`` the scores of the last epoch;
    ``snapshot_shares`` the weights once the first epoch has seen these shares of a series (rounded half to even).
    A series with more than ``rows_per_task`` rows is trained slice by slice: with ``relay`` in a barrier stage (``relay_options`` are those
    of ``models.relay.train``), without it by a job per slice. By default the cluster's size decides.
    """
    spark = panel.df.sparkSession
    panel = panel.subset(complete_cases(panel.df, [*features, label]))
    ids = [*panel.series, "model_id"]
    given = {"eta": eta, "momentum": momentum, "epochs": epochs}
    models = pack(init, ids, [k for k, v in given.items() if v is None])
    if trace_every and models.filter("neurons > 0").limit(1).count():
        raise ValueError("weights are traced for models without hidden neurons only")
    values = {k: (F.lit(v) if v is not None else F.col(k)) for k, v in given.items()} | {
        "kind": F.lit(WEIGHT), "neurons": F.col("neurons"), "weights": F.col("weights"),
        "steps": F.transform("weights", lambda w: F.lit(0.0)), "done": F.lit(0), "length": F.lit(0),
        "sse": F.array(), "hits": F.array(), "numbers": F.array(),
    }
    state = models.select(*ids, *(values[c].cast(t).alias(c) for c, t in COLUMNS.items()))
    columns = [*panel.series, *features, label]
    trainer = Trainer(panel.series, features, label, perceptron, trace_every, keep_scores, tuple(snapshot_shares))

    if panel.stats.longest <= rows_per_task and not panel.is_long:
        groups = groups_of(spark, panel.stats.rows, rows_per_task)
        rows = panel.df.select(*dict.fromkeys([*columns, *panel.order]))
        return Fit(_train(rows, state, trainer, panel.order, groups, batches), ids, len(features))

    size = min(panel.segment_rows, rows_per_task)
    panel, segment, _ = panel.segments(size)
    path = shared_path(spark, "rounds")
    if relay is None:
        relay = barrier.fits(spark, panel.stats.longest)
    waves = barrier.waves_of(spark, panel.stats.rows, relay_options.get("tasks")) if relay else 1
    numbered = panel.rows.select(*columns, ROW_NUMBER, SERIES_ROWS, segment.alias("_slice"))
    if waves > 1:
        numbered.withColumn("_wave", barrier.wave(panel.series, waves)).write.partitionBy("_wave").parquet(path)
    else:
        numbered.write.parquet(path)
    rows = spark.read.parquet(path)
    if relay:
        table = barrier.train(rows.drop("_slice"), state, trainer, size, panel.stats, waves, **relay_options)
    else:
        table = _by_jobs(rows.drop(SERIES_ROWS), state, trainer, panel, batches, rows_per_task)
    remove(spark, path)
    return Fit(table, ids, len(features))


def _train(rows: DataFrame, models: DataFrame, trainer: Trainer, order: list[str], groups: int, batches: int, epoch: int | None = None, first: bool = True) -> DataFrame:
    """One cogroup of rows and models: all epochs of whole series, or one epoch of a slice."""
    bucket = F.pmod(F.xxhash64(*trainer.series), F.lit(groups)).cast("int")
    schema = models.schema
    spread = F.explode(F.sequence(F.lit(0), F.lit(batches - 1)))
    rows = rows.withColumn("_bucket", bucket).withColumn("_batch", spread).groupBy("_bucket", "_batch")
    # Rows and models may share lineage; fresh column identities keep the two sides of the cogroup apart.
    nets = models.select(*(F.col(c).alias(c) for c in models.columns)).withColumns(
        {"_bucket": bucket, "_batch": F.pmod(F.xxhash64("model_id"), F.lit(batches)).cast("int")}
    )
    return rows.cogroup(nets.groupBy("_bucket", "_batch")).applyInPandas(
        lambda part, state: trainer.run(part, state, order, epoch, first), schema
    )


def _by_jobs(rows: DataFrame, state: DataFrame, trainer: Trainer, panel: Panel, batches: int, rows_per_task: int) -> DataFrame:
    """A job per epoch and slice; each writes the models that it trained, and those of the job before go."""
    spark = rows.sparkSession
    groups = groups_of(spark, panel.stats.rows, rows_per_task)
    lengths = rows.groupBy(*trainer.series).agg(F.max("_slice").alias("_last"), F.count(F.lit(1)).alias("_length"))
    columns = state.columns
    state = attach(state, lengths, trainer.series, panel.stats.series).na.fill(-1, ["_last"]).na.fill(0, ["_length"])
    state = state.withColumn("length", F.col("_length")).select(*columns, "_last")
    path = shared_path(spark, "models")
    state.write.parquet(path)
    state = spark.read.parquet(path)
    last = state.agg(F.max("epochs").alias("epochs"), F.max("_last").alias("slices")).first()
    pieces: list[DataFrame] = []
    for epoch in range(last["epochs"] or 0):
        for number in range(max(0, last["slices"]) + 1):
            # A series without rows has one empty slice.
            busy = (F.col("epochs") > epoch) & (F.greatest("_last", F.lit(0)) >= number)
            part = rows.filter(F.col("_slice") == number).drop("_slice")
            trained = _train(part, state.filter(busy), trainer, [ROW_NUMBER], groups, batches, epoch, number == 0)
            before, path = path, shared_path(spark, "models")
            trained.unionByName(state.filter(~busy)).write.parquet(path)
            table = spark.read.parquet(path)
            state = table.filter(F.col("kind") == WEIGHT)
            if trainer.keeps_pieces:
                pieces.append(table.filter(F.col("kind") != WEIGHT))
            else:
                remove(spark, before)
    for piece in pieces:
        state = state.unionByName(piece)
    return state.select(*columns)


@dataclass(frozen=True)
class Trainer:
    """Train the models of one group of series. Runs in a Python worker on bounded pandas frames."""

    series: list[str]
    features: list[str]
    label: str
    perceptron: bool = False
    trace_every: int | None = None
    keep_scores: bool = False
    snapshot_shares: tuple[float, ...] = ()

    @property
    def ids(self) -> list[str]:
        return [*self.series, "model_id"]

    @property
    def keeps_pieces(self) -> bool:
        return bool(self.trace_every or self.keep_scores or self.snapshot_shares)

    def run(self, rows: pd.DataFrame, state: pd.DataFrame, order: list[str], epoch: int | None, first: bool) -> pd.DataFrame:
        """All epochs (``epoch`` None), or the part of epoch number ``epoch`` that is in ``rows``; ``first`` opens it."""
        state = state.drop(columns=["_bucket", "_batch"])
        if state.empty:
            return state
        rows = rows.sort_values([*self.series, *order], kind="stable")
        x = rows[self.features].to_numpy(dtype=float)
        y = rows[self.label].to_numpy(dtype=float)
        numbers = np.ones(len(rows), dtype=np.int64) if epoch is None else rows[ROW_NUMBER].to_numpy(dtype=np.int64)
        places = rows[self.series].assign(_start=np.arange(len(rows)), _number=numbers)
        places = places.groupby(self.series, sort=False, dropna=False).agg(
            _start=("_start", "min"), _rows=("_start", "size"), _number=("_number", "min")
        ).reset_index().astype({c: rows[c].dtype for c in self.series})
        models = state.merge(places, how="left", on=self.series).fillna({"_start": 0, "_rows": 0, "_number": 1})
        models["_size"] = models["weights"].map(len)

        # Models of one shape are trained together.
        results = []
        for _, fleet in models.groupby(["_size", "neurons", "epochs"], sort=True):
            results += self._train(fleet, x, y, epoch, first)
        return pd.concat(results, ignore_index=True)[list(state.columns)]

    def _train(self, models: pd.DataFrame, x, y, epoch: int | None, first: bool) -> list[pd.DataFrame]:
        # Longest series first, so that the models that still have a row are always a prefix.
        lanes = models.iloc[np.argsort(-models["_rows"].to_numpy(), kind="stable")]
        fleet = Fleet(
            np.stack(lanes["weights"].to_list()), np.stack(lanes["steps"].to_list()), int(lanes["neurons"].iloc[0]), self.perceptron,
            **{c: lanes[c].to_numpy() for c in ("eta", "momentum", "done")},
            start=lanes["_start"].to_numpy(), length=lanes["_rows"].to_numpy(), number=lanes["_number"].to_numpy(),
        )
        epochs = int(lanes["epochs"].iloc[0])
        errors, hits, pieces = [], [], []
        marks = self.marks(lanes["_rows"] if epoch is None else lanes["length"])
        for number in range(epochs) if epoch is None else [epoch]:
            sse, hit, *found = fleet.advance(x, y, self.trace_every, self.keep_scores and number == epochs - 1, marks)
            errors.append(sse)
            hits.append(hit)
            pieces += self.pieces(lanes, *found)
        ran = [np.array(a).reshape(-1, len(lanes)).T for a in (errors, hits)]
        if epoch is not None:
            ran = [_joined(lanes[c], a, first) for c, a in zip(("sse", "hits"), ran)]
        length = lanes["_rows"].astype("int64") if epoch is None else lanes["length"]
        done = lanes.assign(weights=list(fleet.weights()), steps=list(fleet.steps()), done=fleet.done, sse=list(ran[0]), hits=list(ran[1]), length=length)
        return [done, *pieces]

    def marks(self, length) -> np.ndarray | None:
        """Update numbers of the snapshots, for series of these lengths."""
        return np.rint(np.outer(length, self.snapshot_shares)).astype(np.int64) if self.snapshot_shares else None

    def pieces(self, models: pd.DataFrame, traced: list, scored: list, marked: list) -> list[pd.DataFrame]:
        found = ((TRACE, traced), (SCORE, scored), (SNAPSHOT, marked))
        return [self._piece(models, kind, *piece) for kind, pieces in found for piece in pieces]

    def _piece(self, models: pd.DataFrame, kind: str, lanes: np.ndarray, numbers: list, weights: list, steps: list) -> pd.DataFrame:
        """Pieces of a trace or of scores, one row per model."""
        rows = models.iloc[lanes]
        return rows.assign(kind=kind, numbers=numbers, weights=weights, steps=steps, sse=[[]] * len(rows), hits=[[]] * len(rows))


def _joined(before: pd.Series, now: np.ndarray, first: bool) -> list[np.ndarray]:
    """The curve of earlier slices with that of the present one, which opens an epoch or adds to the one that is open."""
    if first:
        return [np.append(b, n) for b, n in zip(before, now)]
    return [np.append(b[:-1], b[-1] + n) for b, n in zip(before, now)]
