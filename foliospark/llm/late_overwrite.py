"""Late rows into a layout of day folders: only the files of dirty days are written anew.

A layout keeps the latest-arrived row of each id.  A day's rows, in the order of
time and id, are cut into Parquet files of so many rows.  Spark settles which
rows win, which ids leave which day, and how a day's rows are dealt over tasks;
each task gives DuckDB its share of one dirty day: old files, less the ids that
leave, and the incoming rows, in an external order by with row numbers, written
slice by slice.  A day of many rows is shared by several tasks: counts by
minute (by ranges of ids, where rows have no time) tell each task the ranks at
which its rows begin, so that its files begin where the others' end.

Tasks write under a staging folder, under names of their own, and report what
they wrote; when all have ended, a second job moves the reported files in and
deletes the day's old ones.  Both may run again after a lost executor, and what
failed attempts left goes with the staging folder.  Files of other days are never
opened for writing.  All files are reached through their URI, so the folder may
be in any store that pyarrow opens.

Cases: a null time is day -1; null times and ids come first in the order; a null
arrival is older than any other and a row without an id is the row of the id
null; of rows that arrived together the greatest by its columns in order stays, and
against a file's row an incoming one must have arrived later; repeated rows count
once; an empty table gives no files; a day that all its rows leave loses its
files.  Texts of any length stay whole.  Columns named like the own ones
(``folio_*``) are refused.
"""

from __future__ import annotations

import hashlib
import shutil
import tempfile
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.dataset as ds
import pyarrow.fs as pfs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from foliospark.llm._common import discard, lean, materialize, shared_dir

#: Rows of a day that one task sorts and writes, about; files are never shared between tasks.
TASK_ROWS = 4_000_000
#: Rows of a staged file, about.
STAGE_ROWS = 1_000_000
#: Ranges of ids by which a day without times is counted (numbered from 0).
ID_RANGES = 4096
#: What DuckDB holds in memory before it spills, and the rows of one batch and row group.
ENGINE_MEMORY, BATCH_ROWS = "256MB", 65_536
_MINUTE = 60_000_000

_FILES = "day long, file_no long, n_rows long, staged string, path string"


@dataclass(frozen=True)
class Layout:
    """A folder of day folders: where it is, which columns order and name its rows, and how many rows a file has."""

    root: str
    time_col: str
    id_col: str
    arrived_col: str
    rows_per_file: int


def _floored(value: Column, unit: int) -> Column:
    """Whole units below a long, without the rounding of doubles."""
    return F.floor((value - F.pmod(value, F.lit(unit))).cast("decimal(38,0)") / F.lit(unit)).cast("long")


def micros(rows: DataFrame, time_col: str) -> Column:
    """Microseconds since 1970; a time without a zone is read as UTC, whatever the session's zone."""
    if isinstance(rows.schema[time_col].dataType, T.TimestampNTZType):
        return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col(time_col))
    return F.unix_micros(F.col(time_col))


def day_of(rows: DataFrame, time_col: str) -> Column:
    """Whole days since 1970 in UTC; -1 without a time."""
    return F.coalesce(_floored(micros(rows, time_col), 1440 * _MINUTE), F.lit(-1)).cast("long")


def latest(rows: DataFrame, layout: Layout) -> DataFrame:
    """One row of each id, the one that arrived last; summed up before the shuffle, so that a hot id is no hot task."""
    whole = F.struct(F.col(layout.arrived_col).alias("folio_first"), *(F.col(c) for c in rows.columns))
    return rows.groupBy(F.col(layout.id_col).alias("folio_id")).agg(F.max(whole).alias("folio_row")).select(*(F.col(f"folio_row.`{c}`").alias(c) for c in rows.columns))


@dataclass(frozen=True)
class _Ranges:
    """Ranges of ids: where the first begins, how wide they are, and their number."""

    low: int
    step: int
    number: int


def _place(rows: DataFrame, layout: Layout, ranges: _Ranges) -> Column:
    """A number that grows with the order of a day's rows: the minute.

    On day -1 it is -1 without an id and a time, a range of ids without a time, and one number for all rows with a time.
    """
    time, key = F.col(layout.time_col), F.col(layout.id_col)
    ids = F.floor((key.cast("decimal(38,0)") - ranges.low) / F.lit(ranges.step)).cast("long")
    timed = F.when(F.col("folio_day") == -1, F.lit(ranges.number)).otherwise(_floored(micros(rows, layout.time_col), _MINUTE))
    return F.when(time.isNotNull(), timed).when(key.isNull(), F.lit(-1)).otherwise(ids).cast("long")


def _shares(counts: DataFrame, layout: Layout) -> DataFrame:
    """The tasks of each day: ``day``, ``share``, ``low``, ``high`` (places, both inclusive), ``skip``, ``take``, ``first_file``.

    ``counts`` has ``day``, ``place`` and ``n``: at most the minutes of a day, or ``ID_RANGES``, for each day.
    """
    size = layout.rows_per_file * max(1, TASK_ROWS // layout.rows_per_file)
    day = Window.partitionBy("day")
    ranked = counts.where("n > 0").withColumns({"after": F.sum("n").over(day.orderBy("place")), "total": F.sum("n").over(day)}).withColumn("before", F.col("after") - F.col("n"))
    touched = ranked.withColumn("share", F.explode(F.sequence(F.floor(F.col("before") / size), F.floor((F.col("after") - 1) / size))))
    found = touched.groupBy("day", "share").agg(F.min("place").alias("low"), F.max("place").alias("high"), F.min("before").alias("before"), F.first("total").alias("total"))
    begin = F.col("share") * size
    return found.select(
        "day", "share", "low", "high", (begin - F.col("before")).alias("skip"), F.least(F.lit(size), F.col("total") - begin).alias("take"),
        (begin / layout.rows_per_file).cast("long").alias("first_file"),
    )


def _files_of(store: pfs.FileSystem, folder: str) -> list[str]:
    found = store.get_file_info(pfs.FileSelector(folder, allow_not_found=True, recursive=True))
    return sorted(f.path for f in found if f.is_file and f.path.endswith(".parquet"))


def _dataset(store: pfs.FileSystem, files: list[str], schema: pa.Schema) -> ds.Dataset:
    return ds.dataset(files, filesystem=store, format="parquet", schema=schema) if files else ds.dataset(pa.table({f.name: pa.array([], f.type) for f in schema}))


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def _within(layout: Layout, share: dict, ranges: _Ranges) -> str:
    """The rows of a share's places, as a condition on the layout's columns."""
    time, key = _quoted(layout.time_col), _quoted(layout.id_col)
    first, last = share["low"], share["high"]
    if share["day"] != -1:
        return f"epoch_us({time}) BETWEEN {first * _MINUTE} AND {(last + 1) * _MINUTE - 1}"
    ids = f"{key} >= {ranges.low + first * ranges.step} AND {key} < {ranges.low + (last + 1) * ranges.step}"
    return f"CASE WHEN {time} IS NOT NULL THEN {last == ranges.number} WHEN {key} IS NULL THEN {first == -1} ELSE {ids} END"


def _rewrite_share(share: dict, layout: Layout, stage: str, schema: pa.Schema, ranges: _Ranges) -> Iterator[dict]:
    """Writes one share of a day slice by slice; what was written."""
    store, root = pfs.FileSystem.from_uri(layout.root)
    _, base = pfs.FileSystem.from_uri(stage)
    day, key = share["day"], _quoted(layout.id_col)
    columns, within = ", ".join(map(_quoted, schema.names)), _within(layout, share, ranges)
    spill = tempfile.mkdtemp(prefix="folio-spill-")  # of this task alone, and gone with it
    engine = duckdb.connect(config={"memory_limit": ENGINE_MEMORY, "threads": 1, "temp_directory": spill})
    try:
        engine.execute("SET TimeZone = 'UTC'")
        engine.register("old_rows", _dataset(store, _files_of(store, f"{root}/day={day}"), schema))
        engine.register("incoming", _dataset(store, _files_of(store, f"{base}/incoming/folio_day={day}"), schema))
        engine.register("outgoing", _dataset(store, _files_of(store, f"{base}/outgoing/folio_day={day}"), pa.schema([schema.field(layout.id_col)])))
        rows = engine.sql(
            f"SELECT {columns} FROM (SELECT *, row_number() OVER (ORDER BY {_quoted(layout.time_col)} NULLS FIRST, {key} NULLS FIRST) AS folio_rank FROM ("
            f"SELECT {columns} FROM old_rows WHERE {within} AND NOT EXISTS (SELECT 1 FROM outgoing WHERE outgoing.{key} IS NOT DISTINCT FROM old_rows.{key})"
            f" UNION ALL SELECT {columns} FROM incoming WHERE {within}))"
            f" WHERE folio_rank > {share['skip']} AND folio_rank <= {share['skip'] + share['take']} ORDER BY folio_rank"
        ).to_arrow_reader(BATCH_ROWS)
        folder = f"{base}/files/day={day}-{share['share']}-{uuid.uuid4().hex}"
        store.create_dir(folder, recursive=True)
        yield from _sliced(rows, layout, share, schema, store, folder, root)
    finally:
        engine.close()
        shutil.rmtree(spill, ignore_errors=True)


def _sliced(rows: pa.RecordBatchReader, layout: Layout, share: dict, schema: pa.Schema, store: pfs.FileSystem, folder: str, root: str) -> Iterator[dict]:
    """One file for every ``rows_per_file`` rows of a stream."""
    number, writer, held = share["first_file"], None, 0
    version = folder[-32:]

    def done() -> dict:
        writer.close()
        return {"day": share["day"], "file_no": number, "n_rows": held, "staged": f"{folder}/{number}.parquet", "path": f"{root}/day={share['day']}/part-{number:06d}-{version}.parquet"}

    for batch in rows:
        table = pa.Table.from_batches([batch]).cast(schema)
        while table.num_rows:
            if writer is None:
                writer = pq.ParquetWriter(f"{folder}/{number}.parquet", schema, filesystem=store)
            part = table.slice(0, layout.rows_per_file - held)
            writer.write_table(part)
            held += part.num_rows
            table = table.slice(part.num_rows)
            if held == layout.rows_per_file:
                yield done()
                number, writer, held = number + 1, None, 0
    if writer is not None:
        yield done()


def _dealt(tasks: DataFrame, *keys: str) -> DataFrame:
    """A short table of tasks, dealt to a few times as many partitions as there are cores."""
    return tasks.repartition(max(1, min(tasks.count(), 4 * tasks.sparkSession.sparkContext.defaultParallelism)), *keys)


def _stage(rows: DataFrame, day: str, spread: str, path: str, files: int) -> None:
    """Rows by day, as staged files of about ``STAGE_ROWS``."""
    salt = F.pmod(F.xxhash64(spread), F.lit(files))
    rows.repartition(F.col(day), salt).write.partitionBy(day).parquet(path)


def _replace_days(incoming: DataFrame, outgoing: DataFrame | None, layout: Layout) -> DataFrame:
    """Writes the days of ``incoming`` and ``outgoing`` anew; ``day``, ``file_no``, ``n_rows``, ``path`` of the new files, and days without any as null.

    ``incoming`` has the layout's columns and ``folio_day``; ``outgoing`` the id, the time and ``folio_day``.
    """
    spark = incoming.sparkSession
    columns = [c for c in incoming.columns if c != "folio_day"]
    schema = to_arrow_schema(incoming.select(columns).schema)
    stage = f"{shared_dir(spark)}/late-stage-{uuid.uuid4().hex}"
    came = incoming.select("folio_day", layout.id_col, layout.time_col, F.lit(1).alias("n"))
    left = outgoing.select("folio_day", layout.id_col, layout.time_col, F.lit(-1).alias("n")) if outgoing is not None else came.limit(0)
    dirty = materialize(came.union(left).select(F.col("folio_day").alias("day")).distinct(), "late-days")
    days, total = dirty.count(), incoming.count()
    files = 1 + total // (STAGE_ROWS * max(1, days))
    _stage(incoming, "folio_day", layout.id_col, f"{stage}/incoming", files)
    stood = came.limit(0)
    if outgoing is not None:
        _stage(outgoing.select("folio_day", layout.id_col), "folio_day", layout.id_col, f"{stage}/outgoing", files)
        old = read_layout(spark, layout, incoming.select(columns).schema)
        if old is not None:
            stood = old.join(F.broadcast(dirty) if days <= 100_000 else dirty, old["day"] == dirty["day"], "left_semi")
            stood = stood.select(F.col("day").alias("folio_day"), layout.id_col, layout.time_col, F.lit(1).alias("n"))
    moved = stood.union(came).union(left)
    no_time = moved.where(F.col(layout.time_col).isNull()).agg(F.min(layout.id_col), F.max(layout.id_col)).first()
    low, high = int(no_time[0] or 0), int(no_time[1] or 0)
    ranges = _Ranges(low, -(-(high - low + 1) // ID_RANGES), ID_RANGES)
    counts = moved.groupBy(F.col("folio_day").alias("day"), _place(moved, layout, ranges).alias("place")).agg(F.sum("n").alias("n"))
    shares = materialize(_shares(counts, layout), "late-shares")

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for share in batch.to_pylist():
                for file in _rewrite_share(share, layout, stage, schema, ranges):
                    yield pa.RecordBatch.from_pylist([file])

    made = materialize(_dealt(shares, "day", "share").mapInArrow(lean(rewrite), _FILES), "late-files")
    by_day = dirty.join(made, "day", "left").groupBy("day").agg(F.collect_list(F.struct("staged", "path")).alias("files"))
    published = materialize(_dealt(by_day, "day").mapInArrow(lean(_publisher(layout.root)), "day long, n long"), "late-published")
    moved_in = published.agg(F.sum("n")).first()[0] or 0
    if moved_in != made.count():
        raise RuntimeError(f"{moved_in} of {made.count()} files were published")
    for t in (shares, published):
        discard(t)
    store, base = pfs.FileSystem.from_uri(stage)
    store.delete_dir(base)
    return dirty.join(made.drop("staged"), "day", "left")


def _publisher(root: str):
    """Moves a day's reported files in, then deletes those that it had before; running it again changes nothing."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = pfs.FileSystem.from_uri(root)
        for batch in batches:
            for row in batch.to_pylist():
                files = [f for f in row["files"] if f["path"] is not None]
                folder = f"{base}/day={row['day']}"
                if files:
                    store.create_dir(folder, recursive=True)
                for f in files:
                    if store.get_file_info(f["path"]).type == pfs.FileType.NotFound:
                        store.move(f["staged"], f["path"])
                new = {f["path"] for f in files}
                for old in _files_of(store, folder):
                    if old not in new:
                        store.delete_file(old)
                if not files and store.get_file_info(folder).type == pfs.FileType.Directory:
                    store.delete_dir(folder)
                yield pa.RecordBatch.from_pylist([{"day": row["day"], "n": len(files)}])

    return task


def read_layout(spark: SparkSession, layout: Layout, schema: T.StructType) -> DataFrame | None:
    """The rows of a layout and their ``day``; None where it has no file."""
    store, base = pfs.FileSystem.from_uri(layout.root)
    if store.get_file_info(base).type == pfs.FileType.NotFound or not store.get_file_info(pfs.FileSelector(base)):
        return None
    return spark.read.schema(T.StructType([*schema.fields, T.StructField("day", T.LongType())])).parquet(layout.root)


def write_layout(rows: DataFrame, layout: Layout) -> DataFrame:
    """Writes a layout into its empty folder; ``day``, ``file_no``, ``n_rows`` and ``path`` of its files."""
    if any(c.lower().startswith("folio_") for c in rows.columns):
        raise ValueError("columns must not be named folio_*")
    store, base = pfs.FileSystem.from_uri(layout.root)
    store.create_dir(base, recursive=True)
    kept = materialize(latest(rows, layout).withColumn("folio_day", day_of(rows, layout.time_col)), "late-first")
    made = _replace_days(kept, None, layout)
    discard(kept)
    return made


def overwrite_late(files: DataFrame, late: DataFrame, layout: Layout) -> DataFrame:
    """Takes late rows into a layout; ``day``, ``file_no``, ``n_rows``, ``path`` and ``rewritten`` of all its files.

    ``files`` is the list that the last write gave.  A late row takes its id's
    place if it arrived later; its own day and the day where its id stood are
    written anew, and no other.
    """
    spark = late.sparkSession
    new = latest(late, layout).withColumn("folio_day", day_of(late, layout.time_col))
    old = read_layout(spark, layout, late.schema)
    key, arrived, time = layout.id_col, layout.arrived_col, layout.time_col
    if old is None:
        won = materialize(new.withColumns({"folio_old_day": F.lit(None).cast("long"), "folio_old_time": F.lit(None).cast(late.schema[time].dataType)}), "late-won")
    else:
        stood = old.select(F.col(key).alias("folio_old_id"), F.col(arrived).alias("folio_old_arrived"), F.col(time).alias("folio_old_time"), F.col("day").alias("folio_old_day"))
        beats = F.col("folio_old_day").isNull() | (F.col(arrived) > F.col("folio_old_arrived")) | (F.col("folio_old_arrived").isNull() & F.col(arrived).isNotNull())
        won = materialize(new.join(stood, F.col(key).eqNullSafe(F.col("folio_old_id")), "left").where(beats).drop("folio_old_id", "folio_old_arrived"), "late-won")
    outgoing = won.where("folio_old_day is not null").select(F.col("folio_old_day").alias("folio_day"), key, F.col("folio_old_time").alias(time))
    made = _replace_days(won.drop("folio_old_day", "folio_old_time"), outgoing, layout)
    discard(won)
    untouched = files.where("path is not null").join(made.select("day").distinct(), "day", "left_anti")
    return materialize(untouched.withColumn("rewritten", F.lit(False)).unionByName(made.where("path is not null").withColumn("rewritten", F.lit(True))), "late-list")


def layout_digest(files: DataFrame, layout: Layout, amount_col: str) -> DataFrame:
    """``files`` with what each file holds, read as a stream: ``cents``, ``rows_crc``, ``columns``, ``ids_sha256``.

    ``cents`` sums the amounts in hundredths, rounded half up; ``rows_crc`` sums
    the CRC-32 of ``id:time:arrived`` with times in microseconds.
    """
    names = [*files.columns, "cents", "rows_crc", "columns", "ids_sha256"]
    schema = T.StructType([*files.schema.fields, T.StructField("cents", T.LongType()), T.StructField("rows_crc", T.LongType()), T.StructField("columns", T.StringType()), T.StructField("ids_sha256", T.StringType())])
    where = files.columns.index("path")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = pfs.FileSystem.from_uri(layout.root)
        for batch in batches:
            found = [_file_digest(store, path.as_py(), layout, amount_col) for path in batch.column(where)]
            types = [pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array([f[k] for f in found], t) for k, t in enumerate(types))], names=names)

    return _dealt(files, "path").mapInArrow(lean(task), schema)


def _file_digest(store: pfs.FileSystem, path: str, layout: Layout, amount_col: str) -> tuple[int, int, str, str]:
    cents, crc, ids, first = 0, 0, hashlib.sha256(), True
    with store.open_input_file(path) as source:
        file = pq.ParquetFile(source)
        columns = ",".join(file.schema_arrow.names)
        for batch in file.iter_batches(BATCH_ROWS, columns=list(dict.fromkeys([layout.id_col, layout.time_col, layout.arrived_col, amount_col]))):
            amount = batch.column(amount_col).to_numpy(zero_copy_only=False).astype(float)
            cents += int(np.floor(100 * amount[~np.isnan(amount)] + 0.5).astype(np.int64).sum())
            key = [("" if v is None else str(v)) for v in batch.column(layout.id_col).to_pylist()]
            times = [[("" if v is None else str(v)) for v in batch.column(c).cast(pa.timestamp("us")).cast(pa.int64()).to_pylist()] for c in (layout.time_col, layout.arrived_col)]
            crc += sum(zlib.crc32(f"{k}:{t}:{a}".encode()) for k, t, a in zip(key, *times, strict=True))
            ids.update(((("" if first else ",") + ",".join(key)) if key else "").encode())
            first &= not key
    return cents, crc, columns, ids.hexdigest()
