"""Session defaults and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

#: Settings of operators with many steps: shuffle files go with their query, 4 MB a batch for Python.
LEAN = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}


def local_session(cpus: int | str = 8, app: str = "featloom") -> SparkSession:
    """Session for tests and the local bench; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder: on a cluster a
    machine-local path would vanish with its machine.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    return os.path.join(tempfile.gettempdir(), "featloom-checkpoints")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder (survives lost executors)."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def lean(operator: Callable) -> Callable:
    """Runs an operator whose first argument is a DataFrame and whose steps end in tables or checkpoints.

    While it runs, the files of a shuffle go when its query ends; else they stay until the driver happens
    to collect its garbage, and an operator of many steps holds all its shuffles at once. Batches for
    Python are bounded by bytes: a worker and the JVM, beside its heap, hold a batch a task each.
    """
    @wraps(operator)
    def run(docs: DataFrame, *args, **kwargs):
        conf = docs.sparkSession.conf
        before = {name: conf.get(name, None) for name in LEAN}
        for name, value in LEAN.items():
            conf.set(name, value)
        try:
            return operator(docs, *args, **kwargs)
        finally:
            for name, value in before.items():
                conf.unset(name) if value is None else conf.set(name, value)

    return run


def small_batches(spark: SparkSession) -> None:
    """Bounds batches for Python by bytes, as ``lean`` does, from now on in this session: for operators that are run by whoever asks for their rows."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.set(name, LEAN[name])


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder for a written table."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
