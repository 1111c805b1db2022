"""A data source of files that follows no link: ``spark.read.format("guarded_files")``.

Options: ``path`` (a folder, or folders and files parted by ``;``), ``maxBytes``,
``suffixes`` and ``skip`` (names, parted by commas; hidden parts are always left out),
``content`` (``false`` lists only).  Each file is reached from the root through
directory handles, none of which may be a link; its size is tested before a byte
is read, and its identity, size and time again afterwards.

Cases: a link, a special file, one that is too large or that changes while it is
read is a row with a ``problem`` and no content; an empty folder has no rows; a
root that is a link or missing fails the query.  Filters on ``path`` (equal, among,
starts with) leave out folders and files before they are opened.
"""

from __future__ import annotations

import hashlib
import os
import stat
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringStartsWith

SCHEMA = "root string, path string, size long, sha256 string, content binary, problem string"
_ARROW = pa.schema([("root", pa.string()), ("path", pa.string()), ("size", pa.int64()), ("sha256", pa.string()), ("content", pa.binary()), ("problem", pa.string())])
#: Files that one task reads, about, and bytes of a batch.
PARTITION_FILES, BATCH_BYTES = 256, 16 << 20
_OPEN = os.O_RDONLY | os.O_NOFOLLOW | os.O_NONBLOCK | os.O_CLOEXEC


@dataclass
class Part(InputPartition):
    """Files of a root, by relative path."""

    root: str
    paths: list[str]


def _kind(mode: int) -> str | None:
    return None if stat.S_ISREG(mode) else "symlink" if stat.S_ISLNK(mode) else "not a regular file"


def opened(root: int, path: str) -> int:
    """A handle of a file below the handle of its root, reached without following a link."""
    *above, name = path.split("/")
    held = os.dup(root)
    try:
        for part in above:
            inner = os.open(part, _OPEN | os.O_DIRECTORY, dir_fd=held)
            os.close(held)
            held = inner
        return os.open(name, _OPEN, dir_fd=held)
    finally:
        os.close(held)


def _identity(found: os.stat_result) -> tuple:
    return found.st_dev, found.st_ino, found.st_size, found.st_mtime_ns


def bounded_bytes(root: int, path: str, most: int) -> tuple[int | None, bytes | None, str | None]:
    """Size, content and problem of one file."""
    try:
        handle = opened(root, path)
    except OSError as error:
        return None, None, "symlink" if error.errno in (40, 62) else type(error).__name__
    try:
        before = os.fstat(handle)
        problem = _kind(before.st_mode) or ("too large" if before.st_size > most else None)
        if problem:
            return before.st_size, None, problem
        with os.fdopen(os.dup(handle), "rb") as source:
            data = source.read(before.st_size + 1)
        if _identity(os.fstat(handle)) != _identity(before) or len(data) != before.st_size:
            return before.st_size, None, "changed"
        return before.st_size, data, None
    finally:
        os.close(handle)


class GuardedReader(DataSourceReader):
    def __init__(self, options: dict):
        roots = [p.removeprefix("file://").removeprefix("file:").rstrip("/") for p in (options.get("path") or "").split(";") if p]
        if not roots:
            raise ValueError("guarded_files needs a path")
        self.roots = roots
        self.most = int(options.get("maxbytes", 256 << 20))
        self.suffixes = tuple("." + s.strip().lower().lstrip(".") for s in options.get("suffixes", "").split(",") if s.strip())
        self.skip = {s.strip() for s in options.get("skip", "").split(",") if s.strip()}
        self.content = options.get("content", "true").lower() != "false"
        self.prefixes: list[str] = []
        self.only: set[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, StringStartsWith) and f.attribute == ("path",):
                self.prefixes.append(f.value)
            elif isinstance(f, (EqualTo, In)) and f.attribute == ("path",):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.only = values if self.only is None else self.only & values
            yield f  # Spark tests the rows again

    def wanted(self, path: str, folder: bool) -> bool:
        """Whether a file may be asked for, or a folder hold one that is."""
        name = path.rpartition("/")[2]
        if name.startswith(".") or name in self.skip or (not folder and self.suffixes and not name.lower().endswith(self.suffixes)):
            return False
        meets = (lambda p: p.startswith(f"{path}/")) if folder else (lambda p: p == path)
        fits = all(path.startswith(p) or (folder and f"{path}/".startswith(p[: len(path) + 1])) for p in self.prefixes)
        return fits and (self.only is None or any(map(meets, self.only)))

    def listed(self, handle: int, above: str) -> Iterator[str]:
        """Files below an open folder; links and special files count as files, so that they are told of."""
        with os.scandir(handle) as entries:
            found = sorted((e.name, e.is_dir(follow_symlinks=False)) for e in entries)
        for name, folder in found:
            path = f"{above}/{name}" if above else name
            if not self.wanted(path, folder):
                continue
            if not folder:
                yield path
                continue
            inner = os.open(name, _OPEN | os.O_DIRECTORY, dir_fd=handle)
            try:
                yield from self.listed(inner, path)
            finally:
                os.close(inner)

    def partitions(self) -> list[Part]:
        out = []
        for root in self.roots:
            mode = os.lstat(root).st_mode
            if stat.S_ISLNK(mode):
                raise ValueError(f"{root} is a link")
            if not stat.S_ISDIR(mode):
                folder, _, name = root.rpartition("/")
                found = [name] if self.wanted(name, False) else []
                root = folder or "/"
            else:
                handle = os.open(root, _OPEN | os.O_DIRECTORY)
                try:
                    found = list(self.listed(handle, ""))
                finally:
                    os.close(handle)
            out += [Part(root, found[k : k + PARTITION_FILES]) for k in range(0, len(found), PARTITION_FILES)]
        return out

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        handle = os.open(part.root, _OPEN | os.O_DIRECTORY)
        try:
            rows, held = [], 0
            for path in part.paths:
                size, data, problem = bounded_bytes(handle, path, self.most)
                digest = None if data is None else hashlib.sha256(data).hexdigest()
                rows.append({"root": part.root, "path": path, "size": size, "sha256": digest, "content": data if self.content else None, "problem": problem})
                held += len(data or b"") if self.content else 0
                if held > BATCH_BYTES:
                    yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)
        finally:
            os.close(handle)


class GuardedFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "guarded_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> GuardedReader:
        return GuardedReader(self.options)


def guarded_files(spark, path: str, **options: str):
    """The files under ``path``; registers the source and lets Spark push filters down to Python sources."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(GuardedFiles)
    return spark.read.format("guarded_files").options(**options).load(path)
