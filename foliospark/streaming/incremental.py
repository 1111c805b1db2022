"""Rules over what changed: a file stream of notes, the affected rules per batch, results kept by path.

A batch is idempotent: results of a path are replaced by (path, batch), and a
restart from the checkpoint repeats the same batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

NOTES = "path string, text string"


def run_rules(spark: SparkSession, notes_dir: str, out_dir: str, checkpoint_dir: str, rules: dict[str, Callable[[DataFrame], DataFrame]], scopes: dict[str, str] | None = None) -> StreamingQuery:
    """Runs each rule on the new notes whose path fits its scope (a regular expression) and appends its issues with the batch's number."""
    source = spark.readStream.schema(NOTES).parquet(notes_dir)

    def each(batch: DataFrame, number: int) -> None:
        for name, rule in rules.items():
            chosen = batch.where(F.col("path").rlike((scopes or {}).get(name, "")))
            rule(chosen).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out_dir}/rule={name}/batch={number}")

    return source.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint_dir).trigger(availableNow=True).start()


def affected_courses(changed: DataFrame) -> DataFrame:
    """First parts of changed paths."""
    return changed.where("contains(path, '/')").select(F.substring_index("path", "/", 1).alias("course")).distinct()
