"""Files out of rows: notes, binary packages and slides, published one file at a time.

Rows are ``path`` (relative) and ``text`` or ``content``.  Every file is first
written beside its place and then renamed, so a reader sees the old or the new
one, and a task that runs again writes the same bytes.  ``expected`` (a digest)
guards against changes since the read: such a row is reported and not written.
The root is a path that all executors share.

Cases: a null text is reported and not written; paths that leave the root are
refused; of equal paths the batch's last row stays.
"""

from __future__ import annotations

import hashlib
import os
import re
import tempfile
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "path string, state string"
_UNSAFE = re.compile(r"^/|\\|^[A-Za-z]:|(^|/)\.{1,2}(/|$)|//|^$")


def _put(root: Path, name: str, data: bytes, expected: str | None, create_only: bool) -> str:
    if _UNSAFE.search(name):
        return "refused"
    place = root / name
    old = place.read_bytes() if place.is_file() else None
    if old == data:
        return "unchanged"
    if create_only and old is not None:
        return "exists"
    if expected is not None and hashlib.sha256(old or b"").hexdigest() != expected:
        return "conflict"
    place.parent.mkdir(parents=True, exist_ok=True)
    handle, temporary = tempfile.mkstemp(dir=place.parent, prefix=".folio-")
    try:
        with os.fdopen(handle, "wb") as out:
            out.write(data)
        os.chmod(temporary, 0o644)
        os.replace(temporary, place)
    except BaseException:
        os.unlink(temporary)
        raise
    return "written"


def publish(rows: DataFrame, root: str, create_only: bool = False) -> DataFrame:
    """Writes each row; ``path``, ``state``: written, unchanged, exists, conflict, refused or empty.

    The result is lazy and has the writing as its effect: act on it once.
    """
    data = F.col("content") if "content" in rows.columns else F.encode("text", "UTF-8")
    expected = F.col("expected") if "expected" in rows.columns else F.lit(None).cast("string")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for name, content, digest in zip(batch["path"], batch["content"], batch["expected"], strict=True):
                out.append((name, "empty" if content is None or name is None else _put(Path(root), name, bytes(content), digest, create_only)))
            yield pd.DataFrame(out, columns=["path", "state"])

    return rows.select("path", data.alias("content"), expected.alias("expected")).mapInPandas(run, SCHEMA)
