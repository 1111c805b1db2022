"""Fill-in-the-middle transformation of whole texts.

A text is cut at two token boundaries into prefix, middle and suffix and put
together anew around three marks.  Where the cuts lie, whether a text is
transformed and in which form follow from a hash of the seed and the row's id,
so that a task run again gives the same rows.

The kernel works on the UTF-8 buffers of many rows at once: a table of byte
classes, a mask of bytes at which a token begins, its running count over all
rows (a row's own count begins anew at its first byte), and one binary search
in that count for the cuts of all rows.

Cases: a null text is empty; an empty text, a text that holds one of the marks,
and texts that the hash leaves out stay ``plain``; a text of blanks only is one
token; a null id hashes as the empty string; repeated rows are transformed
alike; texts of any length stay whole; an empty table gives an empty result.
Columns of the input named like a result column are replaced by it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliospark.llm._common import bounded_batches, fresh, lean

MARKS = ("<P>", "<S>", "<M>")
#: Bytes of text that the kernel takes at once (one row at least).
KERNEL_BYTES = 4 << 20

_IS_BLANK = np.zeros(256, dtype=bool)
_IS_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_FORMS = np.array(["plain", "psm", "spm"])


def utf8_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts (nulls are empty) and the offsets of the rows in them."""
    filled = column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = filled.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[filled.offset : filled.offset + len(filled) + 1]
    held = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return held[at[0] : at[-1]], at - at[0]


def token_counts(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many tokens have begun before each byte, over all rows (one more entry than bytes)."""
    blank = _IS_BLANK[data]
    begins = blank.copy()
    begins[1:] &= ~blank[:-1]
    begins[at[:-1][at[1:] > at[:-1]]] = True
    return np.concatenate([[0], np.cumsum(begins, dtype=np.int64)])


def rows_holding(data: np.ndarray, at: np.ndarray, mark: bytes) -> np.ndarray:
    """Which rows hold the bytes of ``mark``."""
    out = np.zeros(len(at) - 1, dtype=bool)
    if len(data) >= len(mark):
        same = data[: len(data) - len(mark) + 1] == mark[0]
        for k in range(1, len(mark)):
            same &= data[k : len(data) - len(mark) + 1 + k] == mark[k]
        found = np.flatnonzero(same)
        row = np.searchsorted(at, found, side="right") - 1
        out[row[found + len(mark) <= at[row + 1]]] = True
    return out


def transform_texts(column: pa.Array, hashes: list[np.ndarray], marks: tuple[str, str, str], rate: int, spm_rate: int) -> list[pa.Array]:
    """Tokens, form, code points of prefix and of middle, and output of each text."""
    data, at = utf8_buffers(column)
    rows, first, last = len(column), at[:-1], at[1:]
    counts = token_counts(data, at)
    n = counts[last] - counts[first]
    # The byte at which so many tokens of a row are over: where the next one begins, or the row's end.
    units = np.sort(np.stack([hashes[0] % (n + 1), hashes[1] % (n + 1)]), axis=0)
    cuts = np.minimum(np.searchsorted(counts[1:], counts[first] + units + 1), last)

    encoded = [m.encode() for m in marks]
    plain = (first == last) | (hashes[2] % 100 >= rate)
    for mark in encoded:
        plain |= rows_holding(data, at, mark)
    form = np.where(plain, 0, np.where(hashes[3] % 100 < spm_rate, 2, 1))

    source = np.concatenate([data, np.frombuffer(b"".join(encoded), dtype=np.uint8)])
    size = np.array([len(m) for m in encoded])
    place = len(data) + np.cumsum(size) - size
    mark = [(np.full(rows, p), np.full(rows, s)) for p, s in zip(place, size, strict=True)]
    prefix, middle, suffix = (first, cuts[0] - first), (cuts[0], cuts[1] - cuts[0]), (cuts[1], last - cuts[1])
    none = (first, np.zeros(rows, dtype=np.int64))
    shapes = [
        [(first, last - first), none, none, none, none, none],
        [mark[0], prefix, mark[1], suffix, mark[2], middle],
        [mark[1], suffix, mark[0], prefix, mark[2], middle],
    ]
    begin = np.stack([np.choose(form, [s[k][0] for s in shapes]) for k in range(6)], axis=1).ravel()
    length = np.stack([np.choose(form, [s[k][1] for s in shapes]) for k in range(6)], axis=1).ravel()
    to = np.concatenate([[0], np.cumsum(length)])
    joined = source[np.arange(to[-1]) + np.repeat(begin - to[:-1], length)]
    texts = pa.LargeStringArray.from_buffers(rows, pa.py_buffer(np.ascontiguousarray(to[::6])), pa.py_buffer(joined))

    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80, dtype=np.int64)])
    return [
        pa.array(n),
        pa.array(_FORMS[form]),
        pa.array(points[cuts[0]] - points[first], mask=plain),
        pa.array(points[cuts[1]] - points[cuts[0]], mask=plain),
        texts.cast(pa.string()),
    ]


def _pieces(batch: pa.RecordBatch, text: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with so much text as the kernel takes at once."""
    sizes = np.diff(utf8_buffers(batch.column(text))[1])
    begin, held = 0, 0
    for k, size in enumerate(sizes.tolist()):
        if k > begin and held + size > KERNEL_BYTES:
            yield batch.slice(begin, k - begin)
            begin, held = k, 0
        held += size
    if batch.num_rows > begin:
        yield batch.slice(begin)


def fill_in_middle(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep_columns: list[str] | None = None,
    *,
    seed: int = 42,
    rate: int = 50,
    spm_rate: int = 80,
    marks: tuple[str, str, str] = MARKS,
) -> DataFrame:
    """The kept columns (all, if none are named) and ``folio_tokens``, ``folio_form``, ``folio_prefix_chars``, ``folio_middle_chars``, ``folio_output``.

    ``rate`` and ``spm_rate`` are the hundredths of texts that are transformed,
    and of those the hundredths with the suffix first.  ``marks`` stand before
    prefix, suffix and middle; none may be empty.
    """
    if not all(marks):
        raise ValueError("marks must not be empty")
    results = T.StructType().add("folio_tokens", "long").add("folio_form", "string").add("folio_prefix_chars", "long").add("folio_middle_chars", "long").add("folio_output", "string")
    named = {f.name.lower() for f in results}
    kept = [c for c in (docs.columns if keep_columns is None else keep_columns) if c.lower() not in named]
    own = fresh("folio_source", kept)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    words = [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]
    rows = docs.select(*(F.col(f"`{c}`") for c in kept), F.col(text_col).alias(own), *(w.alias(f"{own}{k}") for k, w in enumerate(words)))
    width = len(kept)
    schema = T.StructType([*rows.schema.fields[:width], *results.fields])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in _pieces(batch, width):
                hashes = [piece.column(width + 1 + k).to_numpy(zero_copy_only=False) for k in range(4)]
                made = transform_texts(piece.column(width), hashes, marks, rate, spm_rate)
                yield pa.RecordBatch.from_arrays([*piece.columns[:width], *made], names=schema.names)

    return bounded_batches(rows).mapInArrow(lean(task), schema)


def restored(form: Column, output: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text that ``fill_in_middle`` was given, from its form and output."""
    p, s, m = marks

    def parts(outer: str, inner: str) -> tuple[Column, Column, Column]:
        body = F.substr(output, F.lit(len(outer) + 1))
        rest = F.substring_index(body, inner, -1)
        return F.substring_index(body, inner, 1), F.substring_index(rest, m, 1), F.substring_index(rest, m, -1)

    prefix, suffix, middle = parts(p, s)
    psm = F.concat(prefix, middle, suffix)
    suffix, prefix, middle = parts(s, p)
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(F.concat(prefix, middle, suffix))
