"""Archives and slide packages, read from binary rows on the executors."""

from __future__ import annotations

import hashlib
import io
import posixpath
import re
import tarfile
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Budgets of a package.
MAX_ENTRIES, MAX_MEMBER, MAX_TOTAL, MAX_RATIO = 100_000, 512 << 20, 2 << 30, 1000
# Parts that every slide package has.
DECK_PARTS = ["[Content_Types].xml", "_rels/.rels", "ppt/presentation.xml"]
_TEXT = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
_SHAPE = "{http://schemas.openxmlformats.org/presentationml/2006/main}"


def members(files: DataFrame) -> DataFrame:
    """Entries of ZIP files: ``path``, ``pos``, ``name``, ``size``, ``sha256``, ``problem`` (null if sound)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as archive:
                        for pos, entry in enumerate(archive.infolist()):
                            problem = _entry_problem(entry, pos)
                            data = b"" if problem else archive.read(entry)
                            rows.append((path, pos, entry.filename, entry.file_size, hashlib.sha256(data).hexdigest(), problem))
                except (zipfile.BadZipFile, RuntimeError, NotImplementedError) as error:
                    rows.append((path, -1, None, None, None, type(error).__name__))
            yield pd.DataFrame(rows, columns=["path", "pos", "name", "size", "sha256", "problem"])

    return files.select("path", "content").mapInPandas(run, "path string, pos int, name string, size long, sha256 string, problem string")


def _entry_problem(entry: zipfile.ZipInfo, pos: int) -> str | None:
    if pos >= MAX_ENTRIES:
        return "too many entries"
    if entry.flag_bits & 1:
        return "encrypted"
    if entry.file_size > MAX_MEMBER or entry.file_size > MAX_RATIO * max(1, entry.compress_size):
        return "too large"
    return None


def tar_members(files: DataFrame, prefix: str = "") -> DataFrame:
    """Regular files of tar archives below ``prefix``: ``path``, ``name`` (relative), ``size``, ``sha256``; an unreadable archive is one row with a ``problem``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    with tarfile.open(fileobj=io.BytesIO(content), mode="r:") as archive:
                        for entry in archive:
                            if entry.isfile() and entry.name.startswith(prefix):
                                data = archive.extractfile(entry).read()
                                rows.append((path, entry.name[len(prefix) :], len(data), hashlib.sha256(data).hexdigest(), None))
                except tarfile.TarError as error:
                    rows.append((path, None, None, None, type(error).__name__))
            yield pd.DataFrame(rows, columns=["path", "name", "size", "sha256", "problem"]).astype({"size": "Int64"})

    return files.select("path", "content").mapInPandas(run, "path string, name string, size long, sha256 string, problem string")


def deck_problems(files: DataFrame, expected: DataFrame) -> DataFrame:
    """``path``, ``slides``, ``problem`` of slide packages: unreadable, without parts that a deck needs, with another number of slides than ``expected`` (path, slides), or with a gap in their numbers."""
    found = members(files)
    number = F.regexp_extract("name", r"^ppt/slides/slide([0-9]+)\.xml$", 1)
    counted = found.groupBy("path").agg(
        F.max("problem").alias("broken"),
        F.count_if(F.col("name").isin(DECK_PARTS)).alias("parts"),
        F.count_if(number != "").alias("slides"),
        F.max(F.when(number != "", number.cast("int"))).alias("last"),
    )
    joined = expected.select("path", F.col("slides").alias("wanted")).join(counted, "path", "left")
    problem = F.when(F.col("slides").isNull(), "missing").when(F.col("broken").isNotNull(), F.col("broken")).when(F.col("parts") < len(DECK_PARTS), "parts").when(F.col("slides") != F.col("wanted"), "slides").when(F.col("last") != F.col("slides"), "numbers")
    return joined.select("path", F.coalesce("slides", F.lit(0)).alias("slides"), problem.alias("problem"))


def safe_entry(name: Column) -> Column:
    """A relative, normalised path without parent steps, drive letters or backslashes."""
    return ~(name.rlike(r"^/|\\|^[A-Za-z]:|(^|/)\.{1,2}(/|$)|//") | (name == ""))


def running_total(entries: DataFrame) -> DataFrame:
    """Adds ``total`` so far within an archive and ``over`` where the budget is passed."""
    line = Window.partitionBy("path").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return entries.withColumn("total", F.sum("size").over(line)).withColumn("over", F.col("total") > MAX_TOTAL)


def slide_shapes(files: DataFrame) -> DataFrame:
    """What slides of PPTX files show: ``source``, ``slide_no``, ``pos``, ``top``, ``left``, ``text``, ``kind``.

    Kinds are text, table (a line for each row, cells parted by bars), image and
    chart (with a placeholder as text) and notes (of the speaker).  Places are the
    slide's, also of shapes in nested groups.  A part larger than
    ``MAX_MEMBER`` and a package that cannot be read are a row without text, of
    slide 0; a slide without anything is one of its own number.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as archive:
                        found = [(path, number, pos, *shape) for number, name in _slides(archive) for pos, shape in enumerate(_slide(archive, name) or [(None, None, None, None)])]
                    rows += found
                except (zipfile.BadZipFile, ElementTree.ParseError, ValueError, KeyError, TypeError):
                    rows.append((path, 0, 0, None, None, None, None))
            yield pd.DataFrame(rows, columns=["source", "slide_no", "pos", "top", "left", "text", "kind"]).astype({"top": "Int64", "left": "Int64"})

    return files.select("path", "content").mapInPandas(run, "source string, slide_no int, pos int, top long, left long, text string, kind string")


_RELATION = "{http://schemas.openxmlformats.org/package/2006/relationships}Relationship"
EMPTY_NOTE = "click to add notes"


def _slides(archive: zipfile.ZipFile) -> list[tuple[int, str]]:
    return sorted((int(m[1]), name) for name in archive.namelist() if (m := re.fullmatch(r"ppt/slides/slide(\d+)\.xml", name)))


def _part(archive: zipfile.ZipFile, name: str) -> ElementTree.Element:
    if archive.getinfo(name).file_size > MAX_MEMBER:
        raise ValueError("too large")
    return ElementTree.fromstring(archive.read(name))


def _slide(archive: zipfile.ZipFile, name: str) -> list[tuple]:
    """Place, text and kind of everything on a slide, then its notes."""
    root = _part(archive, name)
    tree = root.find(f".//{_SHAPE}spTree")
    out = list(_shapes(root if tree is None else tree, (1.0, 0.0, 1.0, 0.0)))
    relations = f"{posixpath.dirname(name)}/_rels/{posixpath.basename(name)}.rels"
    if relations in archive.namelist():
        for relation in _part(archive, relations).iter(_RELATION):
            target = posixpath.normpath(posixpath.join(posixpath.dirname(name), relation.get("Target", ""))).lstrip("/")
            if relation.get("Type", "").endswith("/notesSlide") and target in archive.namelist():
                notes = (_paragraphs(shape) for shape in _part(archive, target).iter(f"{_SHAPE}sp"))
                out += [(None, None, text, "notes") for text in notes if text and text.lower() != EMPTY_NOTE]
    return out


def _paragraphs(node: ElementTree.Element) -> str:
    """Paragraphs with text, line breaks kept."""
    lines = ["".join("\n" if part.tag == f"{_TEXT}br" else part.text or "" for part in p.iter() if part.tag in (f"{_TEXT}t", f"{_TEXT}br")) for p in node.iter(f"{_TEXT}p")]
    return "\n".join(x for x in lines if x.strip())


def _numbers(node: ElementTree.Element | None, *names: str) -> list[int]:
    return [int(node.get(n, 0) or 0) if node is not None else 0 for n in names]


def _shapes(tree: ElementTree.Element | None, space: tuple[float, float, float, float]) -> Iterator[tuple]:
    """Shapes of a tree; ``space`` (scale and shift of x and y) leads from the tree's coordinates to the slide's."""
    for shape in tree if tree is not None else ():
        kind = shape.tag.removeprefix(_SHAPE)
        frame = shape.find(f"{_SHAPE}xfrm") if kind == "graphicFrame" else shape.find(f"{_SHAPE}{'grpSpPr' if kind == 'grpSp' else 'spPr'}/{_TEXT}xfrm")
        x, y = _numbers(frame.find(f"{_TEXT}off") if frame is not None else shape.find(f".//{_TEXT}off") if kind == "sp" else None, "x", "y")
        if kind == "grpSp":
            yield from _shapes(shape, _inner(frame, x, y, space))
            continue
        place = (round(space[2] * y + space[3]), round(space[0] * x + space[1]))
        name = next((p.get("name", "") for p in shape.iter(f"{_SHAPE}cNvPr")), "")
        if kind == "sp" and (text := _paragraphs(shape)):
            yield *place, text, "text"
        elif kind == "pic":
            yield *place, f"[Image placeholder: {name or 'picture'}]", "image"
        elif kind == "graphicFrame":
            rows = [[t for cell in row.iter(f"{_TEXT}tc") if (t := _paragraphs(cell).strip())] for row in shape.iter(f"{_TEXT}tr")]
            if any(rows):
                yield *place, "\n".join(dict.fromkeys(" | ".join(cells) for cells in rows if cells)), "table"
            elif any("/chart" in (d.get("uri") or "") for d in shape.iter(f"{_TEXT}graphicData")):
                yield *place, f"[Chart placeholder: {name or 'chart'}]", "chart"


def _inner(frame: ElementTree.Element | None, x: int, y: int, space: tuple[float, float, float, float]) -> tuple[float, float, float, float]:
    """The space of a group's children: their box is laid on the group's, mirrored where the group is."""
    if frame is None or frame.find(f"{_TEXT}chExt") is None:
        return space
    (width, height), (from_x, from_y), (inner_w, inner_h) = (_numbers(frame.find(f"{_TEXT}{n}"), *ks) for n, ks in (("ext", ("cx", "cy")), ("chOff", ("x", "y")), ("chExt", ("cx", "cy"))))
    sx, sy = width / inner_w if inner_w else 1.0, height / inner_h if inner_h else 1.0
    dx, dy = x - sx * from_x, y - sy * from_y
    if frame.get("flipH") in ("1", "true"):
        sx, dx = -sx, 2 * x + width - dx
    if frame.get("flipV") in ("1", "true"):
        sy, dy = -sy, 2 * y + height - dy
    return space[0] * sx, space[0] * dx + space[1], space[2] * sy, space[2] * dy + space[3]


def _shown() -> Column:
    """A slide's texts in the order of their places, repeated ones once, of its grouped shapes."""
    of_slide = F.col("text").isNotNull() & F.col("kind").isin("text", "table")
    ordered = F.array_sort(F.collect_list(F.when(of_slide, F.struct("top", "left", "pos", "text"))))
    return F.array_distinct(F.transform(ordered, lambda s: s["text"]))


def slide_texts(shapes: DataFrame) -> DataFrame:
    """One row per slide: shapes by (top, left), repeated texts once, and the title (first line); notes and placeholders are no text of the slide."""
    texts = shapes.where("text is not null and kind in ('text', 'table')").groupBy("source", "slide_no").agg(F.array_join(_shown(), "\n").alias("text"))
    return texts.withColumn("title", F.substring_index("text", "\n", 1))


def slide_counts(shapes: DataFrame, shown: int | None = None) -> DataFrame:
    """``source``, ``slides``, ``blank_slides`` (without text), ``media`` and ``notes`` of each file that could be read.

    With ``shown``, the number of a slide, also its ``text`` as ``slide_texts`` tells it (null without one): files are
    read once for both.
    """
    told = lambda *kinds: F.count_if(F.col("kind").isin(*kinds))
    parts = [told("text", "table").alias("t"), told("image", "chart").alias("m"), told("notes").alias("n")]
    wholes = [F.count("*").alias("slides"), F.count_if(F.col("t") == 0).alias("blank_slides"), F.sum("m").alias("media"), F.sum("n").alias("notes")]
    if shown is not None:
        parts.append(_shown().alias("shown"))
        wholes.append(F.max(F.when((F.col("slide_no") == shown) & (F.size("shown") > 0), F.array_join("shown", "\n"))).alias("text"))
    return shapes.where("slide_no > 0").groupBy("source", "slide_no").agg(*parts).groupBy("source").agg(*wholes)


def content_digest(records: DataFrame) -> DataFrame:
    """One digest over all (path, size, sha256) records in order of the path."""
    line = F.concat(F.lit('{"path":"'), F.col("path"), F.lit('","sha256":"'), F.col("sha256"), F.lit('","size":'), F.col("size").cast("string"), F.lit("}"))
    listed = records.groupBy().agg(F.array_sort(F.collect_list(F.struct("path", line.alias("line")))).alias("all"))
    return listed.select(F.sha2(F.concat(F.lit("["), F.array_join(F.transform("all", lambda x: x["line"]), ","), F.lit("]")), 256).alias("content_digest"))
