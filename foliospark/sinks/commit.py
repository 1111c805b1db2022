"""Publication of files in two phases, in any store that pyarrow opens.

Tasks stage every file under a name of their own and say what they saw at its
place.  The list of what was staged is written before anything else happens; then
the driver claims the root, and a second job moves the files in, each only if its
place still holds what was seen.  So

* a failed or repeated task leaves staged files that no list names,
* of two writers at once one has the root and the other raises ``Busy`` before it
  has changed anything, or finds other contents and reports conflicts,
* a driver that dies leaves the claim and the list, and ``recover`` ends its work.

Cases: a null path or content is ``empty`` and paths that leave the root are
``refused``; of equal paths one row, the greatest by content, stays and the others
are ``repeated``; equal contents are ``unchanged``; with ``together`` one conflict
keeps all files from being written and their state is ``held``.
"""

from __future__ import annotations

import hashlib
import os
import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.fs as pfs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_UNSAFE = re.compile(r"^/|\\|^[A-Za-z]:|(^|/)\.{1,2}(/|$)|//|^$|^\.folio-")
CLAIM = ".folio-claim"
_STAGED = "path string, state string, staged string, seen string, digest string"


class Busy(RuntimeError):
    """Another writer has the root."""


@contextmanager
def _held(store: pfs.FileSystem, path: str) -> Iterator[str | None]:
    """SHA-256 of a file, read as a stream; None where there is none.

    The file stays open within: where it is replaced meanwhile, its store frees it
    when it is closed, side by side with others, and not within the move, which a
    disk does one at a time.
    """
    if store.get_file_info(path).type != pfs.FileType.File:
        yield None
        return
    sha = hashlib.sha256()
    with store.open_input_stream(path) as source:
        while block := source.read(1 << 20):
            sha.update(block)
        yield sha.hexdigest()


def _digest(store: pfs.FileSystem, path: str) -> str | None:
    with _held(store, path) as digest:
        return digest


def _stager(root: str, work: str):
    """Writes each file under the work folder and compares its place with what the writer expects."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = pfs.FileSystem.from_uri(root)
        folder = f"{base}/{work}/files-{uuid.uuid4().hex}"
        number = 0
        for batch in batches:
            out = []
            for path, content, expected, create_only, nth in zip(*(column.to_pylist() for column in batch.columns)):
                one = {"path": path, "state": "ready", "staged": None, "seen": None, "digest": None}
                if path is None or content is None:
                    one["state"] = "empty"
                elif _UNSAFE.search(path):
                    one["state"] = "refused"
                elif nth > 1:
                    one["state"] = "repeated"
                else:
                    one["seen"], one["digest"] = _digest(store, f"{base}/{path}"), hashlib.sha256(content).hexdigest()
                    if one["seen"] == one["digest"]:
                        one["state"] = "unchanged"
                    elif create_only and one["seen"] is not None:
                        one["state"] = "exists"
                    elif expected is not None and expected != (one["seen"] or hashlib.sha256(b"").hexdigest()):
                        one["state"] = "conflict"
                    else:
                        if not number:
                            store.create_dir(folder, recursive=True)
                        one["staged"], number = f"{folder}/{number}", number + 1
                        with store.open_output_stream(one["staged"]) as target:
                            target.write(content)
                out.append(one)
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([(c.split()[0], pa.string()) for c in _STAGED.split(", ")]))

    return task


def _publisher(root: str):
    """Moves staged files in where their place still holds what was seen; a second run finds them there."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = pfs.FileSystem.from_uri(root)
        made = None
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                state, place = row["state"], f"{base}/{row['path']}"
                if state == "ready":
                    with _held(store, place) as now:
                        if now == row["digest"]:
                            state = "written"  # by this task before it was broken off
                        elif now != row["seen"]:
                            state = "conflict"
                        else:
                            if now is None and (folder := place.rpartition("/")[0]) != made:
                                store.create_dir(folder, recursive=True)
                                made = folder
                            try:
                                store.move(row["staged"], place)
                            except FileNotFoundError:  # another attempt of this task was quicker
                                if _digest(store, place) != row["digest"]:
                                    raise
                            state = "written"
                out.append({"path": row["path"], "state": state})
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("path", pa.string()), ("state", pa.string())]))

    return task


def _claim(spark: SparkSession, root: str, owner: str) -> None:
    """Makes the claim file, which only one writer can."""
    store, base = pfs.FileSystem.from_uri(root)
    store.create_dir(base, recursive=True)
    try:
        if isinstance(store, pfs.LocalFileSystem):
            handle = os.open(f"{base}/{CLAIM}", os.O_CREAT | os.O_EXCL | os.O_WRONLY, 0o644)
            with os.fdopen(handle, "w") as out:
                out.write(owner)
        else:
            jvm, conf = spark._jvm, spark._jsparkSession.sessionState().newHadoopConf()
            place = jvm.org.apache.hadoop.fs.Path(f"{root}/{CLAIM}")
            out = place.getFileSystem(conf).create(place, False)
            out.writeBytes(owner)
            out.close()
    except Exception as error:
        if store.get_file_info(f"{base}/{CLAIM}").type == pfs.FileType.NotFound:
            raise
        raise Busy(f"{root} is claimed by another writer") from error


def _end(root: str, work: str, claimed: bool) -> None:
    store, base = pfs.FileSystem.from_uri(root)
    if store.get_file_info(f"{base}/{work}").type == pfs.FileType.Directory:
        store.delete_dir(f"{base}/{work}")
    if claimed:
        store.delete_file(f"{base}/{CLAIM}")


def _finish(spark: SparkSession, root: str, work: str, result: str) -> None:
    """Moves in what the list names and keeps the states in ``result``."""
    listed = spark.read.schema(_STAGED).parquet(f"{root}/{work}/list")
    listed.mapInArrow(_publisher(root), "path string, state string").write.mode("overwrite").parquet(result)


def publish(rows: DataFrame, root: str, result: str, create_only: bool = False, together: bool = False) -> DataFrame:
    """Writes rows (``path`` and ``text`` or ``content``, and ``expected``, a digest) under ``root``; ``path``, ``state``.

    ``root`` and ``result``, the folder of the table of states, are URIs that the
    driver and all executors share.
    """
    spark = rows.sparkSession
    owner = uuid.uuid4().hex
    work = f".folio-{owner}"
    data = F.col("content") if "content" in rows.columns else F.encode("text", "UTF-8")
    expected = F.col("expected") if "expected" in rows.columns else F.lit(None).cast("string")
    nth = F.row_number().over(Window.partitionBy("path").orderBy(F.desc_nulls_last("content")))
    asked = rows.select("path", data.alias("content"), expected.alias("expected"), F.lit(create_only).alias("create_only")).withColumn("nth", nth)
    claimed = False
    try:
        asked.mapInArrow(_stager(root, work), _STAGED).write.parquet(f"{root}/{work}/list")
        listed = spark.read.schema(_STAGED).parquet(f"{root}/{work}/list")
        if together and not listed.where("state in ('conflict', 'exists', 'refused')").isEmpty():
            listed.select("path", F.when(F.col("state") == "ready", "held").otherwise(F.col("state")).alias("state")).write.parquet(result)
        else:
            _claim(spark, root, owner)
            claimed = True
            _finish(spark, root, work, result)
    except Busy:
        _end(root, work, False)
        raise
    except BaseException:
        if not claimed:  # else the list and the claim stay for ``recover``
            _end(root, work, False)
        raise
    _end(root, work, claimed)
    return spark.read.schema("path string, state string").parquet(result)


def recover(spark: SparkSession, root: str, result: str) -> DataFrame | None:
    """Ends the work of a writer that died with the root claimed; None where the root is free."""
    store, base = pfs.FileSystem.from_uri(root)
    if store.get_file_info(f"{base}/{CLAIM}").type == pfs.FileType.NotFound:
        return None
    with store.open_input_stream(f"{base}/{CLAIM}") as source:
        work = f".folio-{source.read().decode()}"
    _finish(spark, root, work, result)
    _end(root, work, True)
    return spark.read.schema("path string, state string").parquet(result)
