"""A session with the settings that the library's results rely on."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Rows and bytes of an Arrow batch between the JVM and a Python task, as notes vary from a line to a book.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": 500, "spark.sql.execution.arrow.maxBytesPerBatch": 2 << 20}
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    **{key: str(most) for key, most in BATCHES.items()},
}


def get_session(app: str = "foliospark", master: str | None = None, **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(app).config(map=SETTINGS | extra)
    return (builder.master(master) if master else builder).getOrCreate()


def bounded_batches(spark: SparkSession) -> None:
    """Keeps the session's Arrow batches small: both sides hold whole ones, and what Python makes of them is many times as large."""
    for key, most in BATCHES.items():
        held = spark.conf.get(key).removesuffix("b")  # bytes are shown with their unit
        if not (held.isdecimal() and 0 < int(held) <= most):
            spark.conf.set(key, str(most))


_OWN_FOLDER: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir``; a local one under a local master only."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _OWN_FOLDER:
        _OWN_FOLDER.append("file://" + tempfile.mkdtemp(prefix="foliospark-"))
    return _OWN_FOLDER[0]


# Tasks of costly Python for each core, and at least; a task costs as much as many short rows.
TASKS_A_CORE, LEAST_TASKS = 3, 24


def dealt(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` over a few tasks for each core, by their key: costly Python must not follow the few row groups of a file."""
    return rows.repartition(max(LEAST_TASKS, TASKS_A_CORE * rows.sparkSession.sparkContext.defaultParallelism), key)


def written(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` as a table in the shared folder: cuts the lineage of iterations and outlives executors."""
    path = f"{shared_folder(rows.sparkSession)}/{name}-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)
