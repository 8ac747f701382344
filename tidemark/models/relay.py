"""Training on very long series in a barrier stage: slices of rows stay in their tasks, models travel along them.

A series has at most as many slices as there are tasks. In each beat a task trains the models that have arrived over the slice that they are
due for, and hands them to the task of the next slice through the barrier's exchange of messages; after the last slice of an epoch
a model goes back to the first one. Models set out one after another, so that once as many are on their way as there are slices, all
tasks work in every beat. Rows never move, and one job makes several epochs. A beat takes a second at least (the exchange is
polled), which is little beside training on the rows of a slice that is worth a task. Its result is a table from which the next job goes on, so a lost executor costs at most
the epochs of one job. The updates and their order are those of a loop over the rows.

Where a slice lies follows from its series and number, so no task knows more than its own rows and the models it has. Series that together have more
rows than the tasks should hold go in waves, one after another.
"""

from __future__ import annotations

import base64
import pickle
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from typing import Any

import numpy as np
import pandas as pd
from pyspark import BarrierTaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.models.fleet import Fleet
from tidemark.panel import ROW_NUMBER, SERIES_ROWS, PanelStats, attach
from tidemark.session import remove, shared_path

#: Rows that one task of the barrier stage may hold, as numbers in memory, if one series has so many.
ROWS_PER_TASK = 2_000_000
#: Rows that a task holds of the series of a wave.
ROWS_PER_WAVE = 500_000
#: Models under way at once may have this many bytes: their messages pass through the barrier's coordinator.
MESSAGE_BYTES = 16_000_000


def slots(spark: SparkSession) -> int:
    """Tasks that run at the same time."""
    return max(1, spark.sparkContext.defaultParallelism // int(spark.conf.get("spark.task.cpus", "1")))


def fits(spark: SparkSession, longest: int) -> bool:
    """Whether the cluster can hold the longest series at once in a barrier stage, which it can't start while executors come and go."""
    dynamic = spark.sparkContext.getConf().get("spark.dynamicAllocation.enabled", "false").lower() == "true"
    return not dynamic and longest <= slots(spark) * ROWS_PER_TASK


def waves_of(spark: SparkSession, total: int, tasks: int | None = None) -> int:
    """Waves in which the series of ``total`` rows go."""
    return max(1, -(-total // ((tasks or slots(spark)) * ROWS_PER_WAVE)))


def wave(series: list[str], waves: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(7), *series), F.lit(waves)).cast("int")


def train(
    rows: DataFrame, state: DataFrame, trainer, size: int, stats: PanelStats, waves: int = 1, epochs_per_job: int = 10, tasks: int | None = None,
    probe: Callable[[int, int], None] | None = None,
) -> DataFrame:
    """All epochs of the models in ``state`` over the numbered rows; the table of ``models.online``.

    Slices have ``size`` rows, or as many more as make them no more than tasks. With more than one of ``waves`` the rows have a column
    ``_wave``.

    ``probe`` is called in each task with its number and the beat, before the models of that beat are trained.
    """
    spark = rows.sparkSession
    tasks = max(1, min(tasks or slots(spark), stats.rows))
    columns, series = state.columns, trainer.series

    def slice_rows(length: Column) -> Column:
        return F.greatest(F.lit(size).cast("long"), F.ceil(length / tasks))

    home = F.pmod(F.xxhash64(*series), F.lit(tasks)).cast("int")
    number = F.floor((F.col(ROW_NUMBER) - 1) / slice_rows(F.col(SERIES_ROWS))).cast("long")
    held = rows.withColumns({"_slice": number, "_task": F.pmod(home + number, F.lit(tasks)).cast("int"), "_is_row": F.lit(True)}).drop(SERIES_ROWS)
    lengths = rows.groupBy(*series).agg(F.count(F.lit(1)).alias("_length"))
    state = attach(state, lengths, series, stats.series).withColumn("length", F.coalesce("_length", F.lit(0))).select(*columns)
    first = shared_path(spark, "models")
    state.write.parquet(first)
    start, done, pieces = spark.read.parquet(first), [], []
    epochs = start.agg(F.max("epochs").alias("n")).first()["n"] or 0
    for turn in range(waves):
        state, path = start.filter(wave(series, waves) == turn), first
        own = held.filter(F.col("_wave") == turn).drop("_wave") if waves > 1 else held
        for until in range(epochs_per_job, epochs + epochs_per_job, epochs_per_job):
            anywhere = F.pmod(F.xxhash64(*trainer.ids), F.lit(tasks)).cast("int")
            waiting = state.withColumns({
                "_task": anywhere, "_is_row": F.lit(False), "_home": home, "_slices": F.ceil(F.col("length") / slice_rows(F.col("length"))).cast("long"),
            })
            placed = own.unionByName(waiting, allowMissingColumns=True).repartitionById(tasks, F.col("_task"))
            job = Relay(trainer, columns, until, probe)
            before, path = path, shared_path(spark, "models")
            # Spark runs a failed barrier stage again unless its tasks write results, so these are shuffled first.
            placed.mapInPandas(job.run, state.schema, barrier=True).repartition(tasks, *trainer.ids).write.parquet(path)
            table = spark.read.parquet(path)
            state = table.filter(F.col("kind") == "weight")
            if trainer.keeps_pieces:
                pieces.append(table.filter(F.col("kind") != "weight"))
            elif before != first or turn == waves - 1:
                remove(spark, before)
        done.append(state)
    return reduce(DataFrame.unionByName, [*done, *pieces])


@dataclass
class Model:
    """A model under way, due for a slice."""

    key: tuple
    row: dict[str, Any]
    home: int
    slices: int
    slice: int = 0

    @property
    def shape(self) -> tuple:
        """Equal for models that can be trained together, whatever their slices."""
        return int(self.row["neurons"]), len(self.row["weights"]), int(self.row["epochs"]), len(self.row["sse"]), self.slice > 0

    def place(self, tasks: int) -> int:
        """The task that holds the slice."""
        return (self.home + self.slice) % tasks

    @property
    def bytes(self) -> int:
        return 16 * len(self.row["weights"]) + 16 * len(self.row["sse"]) + 200


def _key(values) -> tuple:
    return tuple(None if pd.isna(v) else v for v in values)


def _packed(models: list[Model]) -> bytes:
    """Models for a message: a list for each column, arrays joined."""
    columns: dict[str, Any] = {}
    for name in models[0].row:
        values = [m.row[name] for m in models]
        if isinstance(values[0], np.ndarray):
            columns[name] = np.concatenate(values), np.cumsum([len(v) for v in values])[:-1]
        else:
            columns[name] = values
    return pickle.dumps((columns, [(m.key, m.home, m.slices, m.slice) for m in models]))


def _unpacked(message: bytes) -> list[Model]:
    columns, heads = pickle.loads(message)
    values = [np.split(v[0], v[1]) if isinstance(v, tuple) else v for v in columns.values()]
    # Copies, so that a model doesn't keep the arrays of all that came with it.
    rows = (dict(zip(columns, (v.copy() if isinstance(v, np.ndarray) else v for v in row))) for row in zip(*values))
    return [Model(key, row, home, slices, at) for row, (key, home, slices, at) in zip(rows, heads)]


@dataclass(frozen=True)
class Relay:
    trainer: Any
    columns: list[str]
    until: int
    probe: Callable[[int, int], None] | None = None

    def run(self, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        context = BarrierTaskContext.get()
        own = context.partitionId()
        held, x, y, waiting = self._load(batches)
        longest = max(self._exchange(context, max((m.slices for m in waiting), default=1)))
        tasks = len(context.getTaskInfos())
        finished, pieces, arrived = [], [], []
        rest = []
        for model in waiting:
            if self._open(model) and not model.slices:
                open_epochs = self._target(model) - len(model.row["sse"])
                model.row["sse"], model.row["hits"] = (np.append(model.row[c], np.zeros(open_epochs, t)) for c, t in (("sse", float), ("hits", np.int64)))
            (rest if self._open(model) else finished).append(model)
        # Those that set out in one beat are one of as many parts as there are slices.
        share = max(1, -(-len(rest) // max(1, longest)))
        under_way, first_waiting, beat = 0, 0, 0
        while True:
            room = max(0, MESSAGE_BYTES - under_way) // tasks
            leaving: dict[int, list[Model]] = defaultdict(list)
            if rest and under_way == 0 and first_waiting == own:
                room = max(room, rest[-1].bytes)
            for _ in range(min(share, len(rest))):
                if rest[-1].bytes > room:
                    break
                room -= rest[-1].bytes
                model = rest.pop()
                leaving[model.place(tasks)].append(model)
            if self.probe:
                self.probe(own, beat)
            while arrived:
                staying = []
                for model in self._beat(arrived, held, x, y, pieces):
                    model.slice = (model.slice + 1) % model.slices
                    if model.slice == 0 and not self._open(model):
                        finished.append(model)
                        continue
                    to = model.place(tasks)
                    (staying if to == own else leaving[to]).append(model)
                arrived = staying
            sent = sum(m.bytes for models in leaving.values() for m in models)
            gathered = self._exchange(context, ({to: _packed(models) for to, models in leaving.items()}, sent, bool(rest)))
            arrived = [m for packed, _, _ in gathered if own in packed for m in _unpacked(packed[own])]
            under_way = sum(sent for _, sent, _ in gathered)
            first_waiting = next((i for i, (*_, more) in enumerate(gathered) if more), -1)
            del gathered, leaving
            beat += 1
            if under_way == 0 and first_waiting < 0:
                break
        frames = [pd.DataFrame([m.row for m in finished])] if finished else []
        for frame in [*frames, *pieces]:
            yield frame[self.columns]

    def _target(self, model: Model) -> int:
        return min(int(model.row["epochs"]), self.until)

    def _open(self, model: Model) -> bool:
        return len(model.row["sse"]) < self._target(model)

    def _load(self, batches: Iterator[pd.DataFrame]) -> tuple[dict[tuple, tuple[int, int, int]], np.ndarray, np.ndarray, list[Model]]:
        """First position, rows and first row number of each slice that the task holds, the rows themselves, and the models that wait."""
        by, features = [*self.trainer.series, "_slice"], self.trainer.features
        places, models, x, y = [], [], [], []
        for batch in batches:
            rows = batch[batch["_is_row"]]
            places.append(rows[[*by, ROW_NUMBER]])
            x.append(rows[features].to_numpy(float))
            y.append(rows[self.trainer.label].to_numpy(float))
            waiting = batch[~batch["_is_row"]]
            for row, home, slices in zip(waiting[self.columns].to_dict("records"), waiting["_home"], waiting["_slices"]):
                models.append(Model(_key(row[c] for c in self.trainer.series), row, int(home), int(slices)))
        models.sort(key=lambda m: (str(m.key), m.row["model_id"]), reverse=True)
        if not places:
            return {}, np.zeros((0, len(features))), np.zeros(0), models
        table = pd.concat(places, ignore_index=True)
        table = table.sort_values([*by, ROW_NUMBER], kind="stable")
        order = table.index.to_numpy()
        x, y = np.concatenate(x)[order], np.concatenate(y)[order]
        return self._segments(table), x, y, models

    def _segments(self, rows: pd.DataFrame) -> dict[tuple, tuple[int, int, int]]:
        by = [*self.trainer.series, "_slice"]
        places = rows[by].assign(_at=np.arange(len(rows)), _number=rows[ROW_NUMBER].to_numpy())
        found = places.groupby(by, sort=False, dropna=False).agg(at=("_at", "min"), n=("_at", "size"), number=("_number", "min")).reset_index()
        return {
            (_key(r[: len(by) - 1]), int(r[len(by) - 1])): (int(at), int(n), int(number))
            for r, at, n, number in zip(found[by].itertuples(index=False, name=None), found["at"], found["n"], found["number"])
        }

    def _exchange(self, context: BarrierTaskContext, own: Any) -> list:
        message = base64.b64encode(zlib.compress(pickle.dumps(own), 1)).decode()
        return [pickle.loads(zlib.decompress(base64.b64decode(m))) for m in context.allGather(message)]

    def _beat(self, arrived: list[Model], held: dict, x: np.ndarray, y: np.ndarray, pieces: list[pd.DataFrame]) -> list[Model]:
        """Train what has arrived; models of one shape together."""
        groups: dict[tuple, list[Model]] = defaultdict(list)
        for model in arrived:
            groups[model.shape].append(model)
        for (neurons, _, epochs, ran, inside), models in groups.items():
            # Longest slices first, so that the models that still have a row are always a prefix.
            models.sort(key=lambda m: -held[m.key, m.slice][1])
            at, length, row_number = (np.array(v) for v in zip(*(held[m.key, m.slice] for m in models)))
            get = lambda c: np.array([m.row[c] for m in models])
            fleet = Fleet(
                get("weights"), get("steps"), neurons, self.trainer.perceptron, eta=get("eta"), momentum=get("momentum"), done=get("done"),
                start=at, length=length, number=row_number,
            )
            # An epoch is open from its first slice on.
            epoch = ran - inside
            marks = self.trainer.marks(get("length"))
            sse, hits, *found = fleet.advance(x, y, self.trainer.trace_every, self.trainer.keep_scores and epoch == epochs - 1, marks)
            if any(found):
                pieces += self.trainer.pieces(pd.DataFrame([m.row for m in models]), *found)
            weights, steps = fleet.weights(), fleet.steps()
            for i, model in enumerate(models):
                row = model.row
                row["weights"], row["steps"], row["done"] = weights[i], steps[i], int(fleet.done[i])
                for name, value in (("sse", sse[i]), ("hits", hits[i])):
                    row[name] = np.append(row[name], value) if not inside else np.append(row[name][:-1], row[name][-1] + value)
        return arrived
