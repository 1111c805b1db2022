"""State along an order: previous values, islands, carried sections, stable names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def previous(rows: DataFrame, group: str, order: str, value: Column, name: str) -> DataFrame:
    """Adds the value of the row before."""
    return rows.withColumn(name, F.lag(value).over(Window.partitionBy(group).orderBy(order)))


def previous_filled(rows: DataFrame, group: str, order: str, text: str, name: str) -> DataFrame:
    """Adds the nearest earlier text that is not blank."""
    line = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn(name, F.last(F.nullif(F.trim(text), F.lit("")), ignorenulls=True).over(line))


def without_repeats(rows: DataFrame, group: str, order: str, value: str) -> DataFrame:
    """Rows whose value differs from the one before."""
    before = F.lag(value).over(Window.partitionBy(group).orderBy(order))
    return rows.withColumn("_before", before).where(~F.col(value).eqNullSafe(F.col("_before")) | F.col("_before").isNull()).drop("_before")


def compact_blanks(rows: DataFrame, group: str, order: str, text: str, most: int = 2) -> DataFrame:
    """At most ``most`` blank rows in a run."""
    filled = (F.trim(text) != "").cast("int")
    numbered = rows.withColumn("_island", F.sum(filled).over(Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))
    blank = numbered.withColumn("_nth", F.row_number().over(Window.partitionBy(group, "_island", F.trim(text) == "").orderBy(order)))
    return blank.where((F.trim(text) != "") | (F.col("_nth") <= most)).drop("_island", "_nth")


def carried(rows: DataFrame, group: str, order: str, value: Column, name: str) -> DataFrame:
    """Adds the last value seen so far, such as a section's title."""
    line = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(name, F.last(value, ignorenulls=True).over(line))


def stable_names(rows: DataFrame, stem: str, path: str, hash_all: bool = False) -> DataFrame:
    """Adds ``out_name``: the first of equal stems keeps it, others (or all that clash) get a digest of their path."""
    line = Window.partitionBy(F.lower(stem))
    clash = F.count("*").over(line) > 1 if hash_all else F.row_number().over(line.orderBy(path)) > 1
    return rows.withColumn("out_name", F.when(clash, F.concat_ws("_", stem, F.substring(F.sha2(path, 256), 1, 10))).otherwise(F.col(stem)))


def outermost(ranges: DataFrame) -> DataFrame:
    """Ranges (path, first, last) that no other of the same path holds: a running maximum, not a self-join."""
    line = Window.partitionBy("path").orderBy("first", F.desc("last")).rowsBetween(Window.unboundedPreceding, -1)
    return ranges.withColumn("_reach", F.max("last").over(line)).where("_reach is null or last > _reach").drop("_reach")


def fence_state(rows: DataFrame, group: str, order: str, is_fence: Column) -> DataFrame:
    """Adds ``fenced``: between an odd fence and the next."""
    line = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("fenced", (F.sum(is_fence.cast("int")).over(line) % 2 == 1) & ~is_fence)


def first_items(rows: DataFrame, group: str, order: str, most: int) -> DataFrame:
    """The first ``most`` rows of each group."""
    return rows.withColumn("_nth", F.row_number().over(Window.partitionBy(group).orderBy(order))).where(F.col("_nth") <= most).drop("_nth")
