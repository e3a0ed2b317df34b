"""Session defaults, the shared work folder, and shipping this package to executors."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()
_step: ContextVar[str] = ContextVar("step", default="")


def session(app: str = "tabloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings this library relies on; cluster sizing is left to the submitter."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.speculation": "false",
    }
    for name, value in {**defaults, **conf}.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Where it is unset, which is refused on a cluster, a local session stores below its warehouse.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_work"


def _application_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark).rstrip('/')}/tabloom/{spark.sparkContext.applicationId}"


def work_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder, in a folder of this application and of the step at work, if any."""
    return "/".join(filter(None, (_application_folder(spark), _step.get(), uuid.uuid4().hex, label)))


@contextmanager
def work_step(name: str) -> Iterator[None]:
    """What is stored in between meanwhile can be dropped on its own by :func:`drop_step`."""
    token = _step.set(f"step-{name}")
    try:
        yield
    finally:
        _step.reset(token)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a file or folder with all below it; nothing happens if it is missing."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def drop_step(spark: SparkSession, name: str, unless_read_by: DataFrame | None = None) -> None:
    """Delete what a step stored in between, unless the given frame still reads from there."""
    folder = f"{_application_folder(spark)}/step-{name}"
    if unless_read_by is not None and any(f"/step-{name}/" in f for f in unless_read_by.inputFiles()):
        return
    delete(spark, folder)


def drop_work(spark: SparkSession) -> None:
    """Delete what this application stored in between; frames read from it are gone with it."""
    delete(spark, _application_folder(spark))


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once as parquet in the shared folder and continue from the files.

    Cuts lineage so that costly or side-effecting steps run once even when executors are lost, and
    unlike an RDD checkpoint keeps column pruning, filter pushdown and size statistics.
    """
    spark = df.sparkSession
    path = work_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Make this package importable in the Python workers, once per application."""
    application = spark.sparkContext.applicationId
    if application in _shipped:
        return
    package = Path(__file__).resolve().parent
    handle, archive = tempfile.mkstemp(prefix="tabloom-", suffix=".zip")
    with os.fdopen(handle, "wb") as raw, zipfile.ZipFile(raw, "w") as out:
        for source in sorted(package.rglob("*.py")):
            out.write(source, source.relative_to(package.parent))
    spark.sparkContext.addPyFile(archive)
    _shipped.add(application)
