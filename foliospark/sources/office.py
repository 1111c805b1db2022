"""Text of PDF, DOCX and legacy PPT files, one binary row at a time on the executors.

A file that cannot be read is a row with its problem; it never fails the others.
Inputs are the ``path`` and ``content`` columns of ``vault.files``.
"""

from __future__ import annotations

import importlib
import io
import re
import struct
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliospark.sources import pdf

# Input budgets, coverage thresholds and the record types of presentations.
MAX_BYTES, MAX_PAGES, MAX_CHARS = 256 << 20, 10_000, 64 << 20
LEAST_SHARE, LEAST_CHARS = 0.5, 20
PPT_NESTING, PPT_RECORDS = 64, 1_000_000
WIDE_TEXT, BYTE_TEXT, CONTAINER = {4000, 4026}, 4008, 0xF
BYTE_ENCODINGS = ["gbk", "cp1252", "utf-8"]
PRINTABLE_SHARE = 0.65
PLACEHOLDER = re.compile(r"(?:\d+|幻灯片\s*\d+|单击此处编辑.*|Click to edit.*|Microsoft PowerPoint.*)$", re.I)
CFB_MAGIC = bytes.fromhex("d0cf11e0a1b11ae1")
END_OF_CHAIN = 0xFFFFFFFA  # sector numbers from here on are marks
UNITS = "source string, unit_no int, text string, method string, problem string"
BATCH_ROWS, BATCH_CHARS = 500, 1 << 20  # units that leave a reader together, about


def _rows(files: DataFrame, read: Callable[[bytes], tuple[list[str], str]]) -> DataFrame:
    """One row per unit of each file; a file without units, or with a problem, is a row with unit 0."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["source", "unit_no", "text", "method", "problem"]
        held, chars = [], 0
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    if content is None or len(content) > MAX_BYTES:
                        raise ValueError("no content" if content is None else "too large")
                    units, method = read(content)
                    rows = [(path, n, text, method, None) for n, text in enumerate(units, 1)] or [(path, 0, None, method, "no units")]
                except Exception as error:  # foreign formats fail in many ways; the row tells how
                    rows = [(path, 0, None, None, f"{type(error).__name__}: {error}"[:240])]
                held += rows
                chars += sum(len(row[2] or "") for row in rows)
                if len(held) >= BATCH_ROWS or chars >= BATCH_CHARS:
                    yield pd.DataFrame(held, columns=columns)
                    held, chars = [], 0
        if held:
            yield pd.DataFrame(held, columns=columns)

    return files.select("path", "content").mapInPandas(run, UNITS)


def _by_pypdf(content: bytes) -> list[str]:
    return [page.extract_text() or "" for page in importlib.import_module("pypdf").PdfReader(io.BytesIO(content)).pages]


def _by_pdfplumber(content: bytes) -> list[str]:
    with importlib.import_module("pdfplumber").open(io.BytesIO(content)) as pdf:
        return [page.extract_text() or "" for page in pdf.pages]


#: Readers of PDF pages in order; those whose library is missing are passed over.
PDF_READERS: list[tuple[str, Callable[[bytes], list[str]]]] = [("pypdf", _by_pypdf), ("pdfplumber", _by_pdfplumber), ("plain", pdf.page_texts)]
_MISSING: set[Callable[[bytes], list[str]]] = set()  # readers without their library in this process, looked for once and not for each file


def covered(pages: list[str]) -> bool:
    """Half of the pages with text, and twenty characters a page."""
    filled, chars = sum(bool(p.strip()) for p in pages), sum(len(p.strip()) for p in pages)
    return bool(pages) and filled >= LEAST_SHARE * len(pages) and chars >= LEAST_CHARS * len(pages)


def _pdf(content: bytes) -> tuple[list[str], str]:
    """The first reader with enough text, else the one with most pages with text, characters and pages."""
    tried, problems = [], []
    for name, read in PDF_READERS:
        if read in _MISSING:
            continue
        try:
            pages = read(content)
        except ImportError:
            _MISSING.add(read)
            continue
        except Exception as error:
            problems.append(f"{name}: {error}")
            continue
        if len(pages) > MAX_PAGES or sum(map(len, pages)) > MAX_CHARS:
            raise ValueError("over the page or text limit")
        if covered(pages):
            return pages, name
        tried.append((sum(bool(p.strip()) for p in pages), sum(len(p.strip()) for p in pages), len(pages), pages, name))
    if not any(t[2] for t in tried):
        raise ValueError("; ".join(problems) or "no pages")
    best = max(tried, key=lambda t: t[:3])
    return best[3], best[4]


def pdf_pages(files: DataFrame) -> DataFrame:
    """``source``, ``unit_no``, ``text``, ``method``, ``problem`` of PDF pages."""
    return _rows(files, _pdf)


_WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def _docx(content: bytes) -> tuple[list[str], str]:
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        entry = archive.getinfo("word/document.xml")
        if entry.file_size > MAX_BYTES:
            raise ValueError("too large")
        root = ElementTree.fromstring(archive.read(entry))
    paragraphs = ("".join(t.text or "" for t in p.iter(f"{_WORD}t")) for p in root.iter(f"{_WORD}p"))
    return ["\n".join(p for p in paragraphs if p.strip())], "docx"


def docx_texts(files: DataFrame) -> DataFrame:
    """One unit per DOCX file: its paragraphs with text."""
    return _rows(files, _docx)


class Compound:
    """Streams of a compound file: sectors chained by a table, small ones inside the root's own stream."""

    def __init__(self, data: bytes) -> None:
        if data[:8] != CFB_MAGIC or len(data) < 512:
            raise ValueError("no compound file")
        self.data = data
        shift, mini_shift = struct.unpack_from("<HH", data, 30)
        if shift not in (9, 12) or mini_shift != 6:
            raise ValueError("sector sizes")
        self.size, self.mini_size = 1 << shift, 1 << mini_shift
        fat_count, directory, self.cutoff, mini_fat, _, difat, difat_count = struct.unpack_from("<II4xIIIII", data, 44)
        places = list(struct.unpack_from("<109I", data, 76))
        for _ in range(difat_count):
            if difat >= END_OF_CHAIN:
                raise ValueError("allocation table list shorter than declared")
            *more, difat = self._numbers(self._sector(difat))
            places += more
        held = [p for p in places if p < END_OF_CHAIN][:fat_count]
        if len(held) < fat_count:
            raise ValueError("allocation table shorter than declared")
        self.fat = [n for place in held for n in self._numbers(self._sector(place))]
        self.entries = self._directory(self._chain(directory))
        root = next((e for e in self.entries.values() if e[0] == 5), None)
        self.small = self._chain(root[1])[: root[2]] if root else b""
        self.mini_fat = self._numbers(self._chain(mini_fat))

    @staticmethod
    def _numbers(block: bytes) -> list[int]:
        return list(struct.unpack(f"<{len(block) // 4}I", block[: len(block) // 4 * 4]))

    def _sector(self, number: int) -> bytes:
        block = self.data[(number + 1) * self.size : (number + 2) * self.size]
        if len(block) < self.size:
            raise ValueError("sector outside the file")
        return block

    @staticmethod
    def _walk(start: int, table: list[int]) -> Iterator[int]:
        seen: set[int] = set()
        while start < END_OF_CHAIN and start not in seen:
            seen.add(start)
            yield start
            start = table[start] if start < len(table) else END_OF_CHAIN

    def _chain(self, start: int) -> bytes:
        return b"".join(map(self._sector, self._walk(start, self.fat)))

    @staticmethod
    def _directory(block: bytes) -> dict[str, tuple[int, int, int]]:
        out = {}
        for at in range(0, len(block) - 127, 128):
            length, kind = struct.unpack_from("<HB", block, at + 64)
            if length >= 2:
                start, size = struct.unpack_from("<IQ", block, at + 116)
                out[block[at : at + min(length, 64) - 2].decode("utf-16-le", "ignore")] = (kind, start, size)
        return out

    def stream(self, name: str) -> bytes:
        _, start, size = self.entries[name]
        if size >= self.cutoff:
            return self._chain(start)[:size]
        return b"".join(self.small[n * self.mini_size : (n + 1) * self.mini_size] for n in self._walk(start, self.mini_fat))[:size]


def ppt_lines(stream: bytes) -> list[str]:
    """Useful lines of the text records of a presentation stream, without runs of equal lines.

    Containers are opened by an own stack, so depth and number of records are bounded.
    """
    out: list[str] = []
    stack, left = [(0, len(stream))], PPT_RECORDS
    while stack:
        at, end = stack.pop()
        if at + 8 > end:
            continue
        left -= 1
        if left < 0 or len(stack) >= PPT_NESTING:
            raise ValueError("too many records")
        version, kind, length = struct.unpack_from("<HHI", stream, at)
        stop = at + 8 + length
        if stop > end:
            continue
        stack.append((stop, end))
        body = stream[at + 8 : stop]
        if kind in WIDE_TEXT or kind == BYTE_TEXT:
            readings = ["utf-16-le"] if kind in WIDE_TEXT else BYTE_ENCODINGS
            texts = (body.decode(e, "ignore") for e in readings)
            text = next((t for t in texts if t and sum(c.isprintable() or c in "\r\n\t" for c in t) > PRINTABLE_SHARE * len(t)), "")
            for line in (" ".join(x.replace("\0", "").split()) for x in text.splitlines()):
                if line and not PLACEHOLDER.match(line) and any(c.isalnum() for c in line) and out[-1:] != [line]:
                    out.append(line)
        if version & 0xF == CONTAINER and length:
            stack.append((at + 8, stop))
    return out


def _ppt(content: bytes) -> tuple[list[str], str]:
    return ["\n".join(ppt_lines(Compound(content).stream("PowerPoint Document")))], "legacy-ppt"


def legacy_ppt_texts(files: DataFrame) -> DataFrame:
    """One unit per legacy PPT file: all its text records, slides are not told apart."""
    return _rows(files, _ppt)


def extractability(units: DataFrame) -> DataFrame:
    """``source``, ``observed_units``, ``blank_units``, ``has_text``, ``low_coverage`` and ``problem`` of extracted units."""
    blank = F.coalesce(F.trim(F.regexp_replace("text", r"(?U)\s+", "")) == "", F.lit(True))
    unit = F.col("unit_no") > 0
    chars = F.sum(F.when(unit, F.length(F.trim("text"))))
    grouped = units.groupBy("source").agg(
        F.count_if(unit).alias("observed_units"),
        F.array_sort(F.collect_list(F.when(unit & blank, F.col("unit_no").cast("long")))).alias("blank_units"),
        chars.alias("chars"),
        F.max("problem").alias("problem"),
    )
    filled = F.col("observed_units") - F.size("blank_units")
    low = (filled < LEAST_SHARE * F.col("observed_units")) | (F.coalesce("chars", F.lit(0)) < LEAST_CHARS * F.col("observed_units")) | (F.col("observed_units") == 0)
    return grouped.select("source", "observed_units", "blank_units", (filled > 0).alias("has_text"), low.alias("low_coverage"), "problem")


def unit_totals(units: DataFrame, kind: str) -> DataFrame:
    """``source``, ``kind``, ``observed`` units (numbered from 1) and how many of them are ``blank`` (white space of any kind, or null)."""
    blank = ~F.coalesce(F.col("text").rlike(r"(?U)\S"), F.lit(False))
    return units.where("unit_no > 0").groupBy("source").agg(F.lit(kind).alias("kind"), F.count("*").alias("observed"), F.count_if(blank).alias("blank"))


def gaps(found: DataFrame) -> DataFrame:
    """Sources whose text has gaps, with what to do."""
    action = F.when(F.col("problem").isNotNull() & (F.col("observed_units") == 0), "repair or convert the file").when(~F.col("has_text"), "run OCR").when(F.size("blank_units") > 0, "look at the blank units").when(F.col("low_coverage"), "check the text against the file")
    return found.withColumn("action", action).where("action is not null")


def presentation_lines(shapes: DataFrame) -> DataFrame:
    """Lines of slides in document order: runs of equal lines once, slides without text left out."""
    each = shapes.where("text is not null and kind in ('text', 'table')").select("source", "slide_no", "pos", F.posexplode(F.split("text", "\n")).alias("k", "raw"))
    clean = each.withColumn("line", F.trim(F.regexp_replace("raw", r"(?U)\s+", " "))).where(F.col("line").rlike(r"[\p{L}\p{N}]"))
    before = F.lag("line").over(Window.partitionBy("source", "slide_no").orderBy("pos", "k"))
    return clean.withColumn("before", before).where(~F.col("line").eqNullSafe(F.col("before"))).select("source", "slide_no", "pos", "k", "line")
