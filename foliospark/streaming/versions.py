"""Results that follow the notes: keyed state lets each event through once, rules run once for each content, issues are kept by digest.

Events are ``path``, ``text`` (null: the note is gone) and ``seq``, a number that
grows with every change of a path.  Spark's state holds the path, number and
digest of every event, never a text, so that repeated and replayed events go no
further; late ones lose against the versions of their path.  A batch writes into
folders of its own number and replaces what an earlier run of the same batch left
there.

* ``versions``: path, seq, digest (null: gone) of every newer event, with the
  number since which the path has held that content.
* ``checked``: digests whose rules have run; they never run again.
* ``issues``: issues by digest.

Cases: of several events of a path the one with the greatest number counts, and
of equal numbers in one batch the greatest digest, in later batches the first; a
text that comes back, or that another note has, is not checked anew; null paths
and numbers are left out; an empty stream has no tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

EVENTS = "path string, text string, seq long"
_EVENTS_SEEN = "path string, seq long, digest string, text string"
_TABLES = {"versions": "path string, seq long, digest string, since long, batch long", "checked": "digest string, batch long", "issues": "digest string, rule string, line_no int, message string, batch long"}


def events_once(events: DataFrame) -> DataFrame:
    """``path``, ``seq``, ``digest`` and ``text`` of a stream of events, each event once."""
    sound = events.where("path is not null and seq is not null")
    return sound.select("path", "seq", F.sha2("text", 256).alias("digest"), "text").dropDuplicates(["path", "seq", "digest"])


def _table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """One of the tables, empty before its first batch."""
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(f"{root}/{name}")
    there = where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(where)
    return spark.read.schema(_TABLES[name]).parquet(f"{root}/{name}") if there else spark.createDataFrame([], _TABLES[name])


def follow(events: DataFrame, root: str, checkpoint: str, rules: Callable[[DataFrame], DataFrame]) -> StreamingQuery:
    """Starts a query that works off what there is of ``events`` and keeps the tables under ``root``.

    ``rules`` turns notes (``path``, ``text``) into issues (``rule``, ``path``, ``line_no``, ``message``).
    """

    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        put = lambda rows, name: rows.write.mode("overwrite").parquet(f"{root}/{name}/batch={number}")
        # The events are written once: what follows reads them there and not from the state again.
        put(batch, "texts")
        came = spark.read.schema(_EVENTS_SEEN).parquet(f"{root}/texts/batch={number}")
        put(_newer(came, _table(spark, root, "versions").where(F.col("batch") != number)), "versions")
        newer = spark.read.schema(_TABLES["versions"]).parquet(f"{root}/versions/batch={number}")
        known = _table(spark, root, "checked").where(F.col("batch") != number).select("digest")
        new = newer.where("digest is not null").select("digest").distinct().join(known, "digest", "left_anti")
        put(new, "checked")
        checked = spark.read.schema("digest string").parquet(f"{root}/checked/batch={number}")
        # One row of each digest is found by its name first, so that no text is grouped.
        one = came.groupBy("digest").agg(F.min(F.struct("path", "seq")).alias("at")).join(checked, "digest").select("digest", "at.path", "at.seq")
        notes = came.join(one, ["digest", "path", "seq"]).select(F.col("digest").alias("path"), "text")
        put(rules(notes).select(F.col("path").alias("digest"), "rule", "line_no", "message"), "issues")

    return events_once(events).writeStream.outputMode("append").foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _newer(came: DataFrame, versions: DataFrame) -> DataFrame:
    """The last event of each path that is newer than the path's versions, with the number since which it has that content."""
    last = came.groupBy("path").agg(F.max(F.struct("seq", "digest")).alias("v"))
    touched = versions.join(came.select("path").distinct(), "path", "left_semi")
    before = touched.groupBy("path").agg(F.max(F.struct("seq", "digest", "since")).alias("b"))
    same = F.col("b").isNotNull() & F.col("b.digest").eqNullSafe(F.col("v.digest"))
    newer = last.join(before, "path", "left").where("b is null or v.seq > b.seq")
    return newer.select("path", "v.seq", "v.digest", F.when(same, F.col("b.since")).otherwise(F.col("v.seq")).alias("since"))


def current(spark: SparkSession, root: str) -> DataFrame:
    """``path``, ``seq`` (since which it has its content), ``digest`` of the notes that are there."""
    last = _table(spark, root, "versions").groupBy("path").agg(F.max(F.struct("seq", "digest", "since")).alias("v"))
    return last.where("v.digest is not null").select("path", F.col("v.since").alias("seq"), "v.digest")


def current_issues(spark: SparkSession, root: str) -> DataFrame:
    """``rule``, ``path``, ``line_no``, ``message`` of the notes that are there."""
    found = _table(spark, root, "issues").select("digest", "rule", "line_no", "message")
    return current(spark, root).join(found, "digest").select("rule", "path", "line_no", "message")
