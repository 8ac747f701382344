"""Session helpers: where shared state goes and how a local session is built."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
_made: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, used to cut lineage and to pass tables between jobs.

    A cluster names it in ``spark.checkpoint.dir``. A local session without that setting gets a
    temporary folder; a cluster without it is an error, because a machine-local path would be lost
    together with the executor that wrote it.
    """
    context = spark.sparkContext
    folder = spark.conf.get(CHECKPOINT_CONF, None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError(f"set {CHECKPOINT_CONF} to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="tidemark-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return folder


def shared_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder; every call returns another one. ``clean`` removes them."""
    path = f"{shared_dir(spark).rstrip('/')}/tidemark-{label}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table that ``shared_path`` named, when nothing will read it again."""
    jvm = spark._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def clean(spark: SparkSession) -> int:
    """Delete the tables that this process has made below the shared folder; returns how many paths there were.

    For the end of a job, once its results are written: results that are still to be computed read these tables.
    """
    n = len(_made)
    while _made:
        remove(spark, _made.pop())
    return n


def local_session(cpus: int | str = 8, memory: str = "8g", name: str = "tidemark") -> SparkSession:
    """Session for tests and the bench. A cluster brings its own settings."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(cpus) if str(cpus).isdigit() else "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in Python workers when it is not installed there."""
    import shutil
    from pathlib import Path

    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="tidemark-code-")
    archive = shutil.make_archive(f"{folder}/{root.name}", "zip", root.parent, root.name)
    spark.sparkContext.addPyFile(archive)
