"""Session settings shared by jobs, tests and the bench."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from uuid import uuid4

from pyspark.sql import SparkSession

#: Settings that matter for correctness (time zone) or for plan quality at scale (adaptive execution).
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Recording a Python call site for every column expression costs more than building the expression.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def build_session(app: str = "postmill", master: str | None = None, **extra: str) -> SparkSession:
    """Session with :data:`SETTINGS`; ``extra`` keys use ``__`` in place of ``.``."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    for key, value in extra.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


#: The folder of the run that is going on, if one is.
_RUN: ContextVar[str | None] = ContextVar("run", default=None)


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder of our own on whatever file system it is."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def run_scope(spark: SparkSession) -> Iterator[str]:
    """Working tables written inside the ``with`` block go to a folder of their own, which is removed at its end.

    Key tables, listings and other steps are read lazily, so what is wanted of them must be written elsewhere before the
    block ends; also when it ends by an error the folder goes. Scopes may be nested. Outside of one, tables stay in
    the shared folder until its owner clears it. Other runs' folders are not touched.
    """
    folder = f"{shared_dir(spark).rstrip('/')}/run-{uuid4().hex}"
    token = _RUN.set(folder)
    try:
        yield folder
    finally:
        _RUN.reset(token)
        remove(spark, folder)


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a query that runs inside the ``with`` block go when it ends.

    Else they stay until the driver happens to collect its garbage, and those of all steps of a job may lie on disk together.
    """
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: that of the run going on, else the one named by ``spark.checkpoint.dir``.

    A private temporary folder stands in only in local mode, where there is one machine.
    """
    if (run := _RUN.get()) is not None:
        return run
    named = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if named is None and current is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    if current is None:
        context.setCheckpointDir(named)
    return named or current
