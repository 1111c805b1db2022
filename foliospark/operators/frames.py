"""Documents as rows of lines, headings, sections, paragraphs, sentences and list items.

Input is any table with ``path`` and ``text``.  Explosions stay in the row's
task; only windows over lines shuffle, by ``path``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliospark.functions.text import collapsed


def by_line():
    """Lines of a document in order."""
    return Window.partitionBy("path").orderBy("line_no")


MIN_CHARS = 24
# Line shapes that end a paragraph, sentence marks and lead-ins that are no prose.
FENCE = re.compile(r"\s*(```|~~~)")
NOT_PROSE = re.compile(r"\s*<!--.*-->\s*$|#{1,6}\s+|\s*\||\s*(?:[-*+] |\d+[.)]\s+)(.+?)\s*$|\s*> ")
SENTENCE = re.compile(r"[^。！？!?；;]+[。！？!?；;]*")  # the last of a paragraph may have no mark
CITATION = r"(?i)^(?:\[[^]]+\]\(https?://|https?://|DOI[:：]|arXiv[:：])"
LEAD_INS = ["关联阅读：", "**关联阅读", "来源说明", "**来源说明"]
CONTRACT = r"(?:生成[:：])?PPT/PDF\s*未提供独立可抽取例题[。.]?$"


def lines(docs: DataFrame) -> DataFrame:
    """``path``, ``line_no`` from 1, ``line``."""
    return docs.select("path", F.posexplode(F.split("text", "\r\n|\r|\n")).alias("i", "line")).select("path", (F.col("i") + 1).alias("line_no"), "line")


def without_frontmatter(docs: DataFrame) -> DataFrame:
    """Adds ``front`` (null without one) and ``body``; the block starts the text and is closed by ``---``."""
    shape = r"(?s)^---\n(.*?)\n---\n(.*)$"
    has = F.col("text").rlike(shape)
    return docs.withColumns({"front": F.when(has, F.regexp_extract("text", shape, 1)), "body": F.when(has, F.regexp_extract("text", shape, 2)).otherwise(F.col("text"))})


def frontmatter(docs: DataFrame) -> DataFrame:
    """``path``, ``keys`` (scalars, quotes off, the last wins) and ``lists`` (dashed or bracketed)."""
    rows = F.split("front", "\n")
    split = without_frontmatter(docs).where("front is not null")
    scalar = F.filter(rows, lambda x: x.rlike(r"^[A-Za-z_][A-Za-z0-9_-]*\s*:"))
    bare = lambda v: F.regexp_replace(F.trim(v), "^([\"'])(.*)\\1$", "$2")
    pairs = F.transform(scalar, lambda x: F.struct(F.regexp_extract(x, r"^([A-Za-z0-9_-]+)", 1).alias("key"), bare(F.regexp_extract(x, r"^[A-Za-z0-9_-]+\s*:(.*)$", 1)).alias("value")))
    # The last of equal keys: reversed, the first of each.
    last = F.reverse(pairs)
    kept = F.filter(last, lambda p, k: ~F.exists(F.slice(last, F.lit(1), k), lambda q: q["key"] == p["key"]))
    keys = F.map_from_entries(kept)
    blocks = F.regexp_extract_all("front", F.lit(r"(?m)^([A-Za-z_][A-Za-z0-9_-]*):[ \t]*\n((?:[ \t]*-[ \t]+.*(?:\n|$))+)"), F.lit(0))
    items = lambda b: F.transform(F.regexp_extract_all(b, F.lit(r"(?m)^[ \t]*-[ \t]+(.*)$"), F.lit(1)), bare)
    dashed = F.transform(blocks, lambda b: F.struct(F.regexp_extract(b, "^([^:]+):", 1).alias("key"), items(b).alias("value")))
    return split.select("path", keys.alias("keys"), dashed.alias("lists"))


def _paragraph_rows(min_chars: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, text in zip(batch["path"], batch["text"], strict=True):
                for k, part in enumerate(p for p in prose(text or "") if len(p[1]) >= min_chars):
                    rows.append((path, k, *part))
            yield pd.DataFrame(rows, columns=["path", "pos", "line_no", "paragraph"])

    return run


def prose(text: str) -> list[tuple[int, str]]:
    """First line and text of each run of prose lines; code, math, headings, tables, lists, quotes and comments end a run."""
    runs: list[tuple[int, list[str]]] = []
    code = math = False
    joined = False
    for number, line in enumerate(text.splitlines(), 1):
        plain = line.strip()
        if FENCE.match(line):
            code, usable = not code, False
        elif not code and plain == "$$":
            math, usable = not math, False
        else:
            usable = bool(plain) and not code and not math and not NOT_PROSE.match(line)
        if usable:
            words = " ".join(plain.split())
            if joined:
                runs[-1][1].append(words)
            else:
                runs.append((number, [words]))
        joined = usable
    return [(n, " ".join(parts)) for n, parts in runs]


def paragraphs(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """``path``, ``pos``, ``line_no``, ``paragraph`` of at least ``min_chars`` characters: an Arrow pass without a shuffle."""
    kind = dict(docs.dtypes)["path"]
    return docs.select("path", "text").mapInPandas(_paragraph_rows(min_chars), f"path {kind}, pos int, line_no int, paragraph string")


def _sentence_rows(min_chars: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, text in zip(batch["path"], batch["text"], strict=True):
                for k, (line_no, part) in enumerate(prose(text or "")):
                    cut = enumerate(raw.strip(" ") for raw in SENTENCE.findall(part))
                    rows += [(path, k, line_no, nth, sentence) for nth, sentence in cut if len(sentence) >= min_chars]
            yield pd.DataFrame(rows, columns=["path", "pos", "line_no", "nth", "sentence"])

    return run


def sentences(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """``path``, ``pos``, ``nth``, ``sentence``; there is no ASCII full stop among the marks.

    Paragraphs are cut where they are found, so that only sentences of ``min_chars`` leave the Arrow pass.
    """
    kind = dict(docs.dtypes)["path"]
    # Paragraphs have single blanks already.
    kept = docs.select("path", "text").mapInPandas(_sentence_rows(min_chars), f"path {kind}, pos int, line_no int, nth int, sentence string")
    for lead in LEAD_INS:
        kept = kept.where(~F.col("sentence").startswith(lead))
    return kept.where(~F.col("sentence").rlike(CITATION) & ~F.col("sentence").rlike(CONTRACT)).select("path", "pos", "line_no", "nth", "sentence")


def openings(docs: DataFrame) -> DataFrame:
    """The first paragraph of each document."""
    return paragraphs(docs).where("pos = 0").select("path", "line_no", "paragraph")


def list_items(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """Language-like list items: punctuated, no link, code or citation, outside fences."""
    fenced = F.sum(F.col("line").rlike(r"^\s*(```|~~~)").cast("int")).over(by_line().rowsBetween(Window.unboundedPreceding, 0)) % 2
    rows = lines(docs).withColumn("fenced", fenced).where("fenced = 0 and line not rlike '^\\\\s*(```|~~~)'")
    item = collapsed(F.regexp_extract("line", r"^\s*(?:[-*+] |\d+[.)]\s+)(.+?)\s*$", 1))
    kept = rows.withColumn("item", item).where(F.length("item") >= min_chars)
    return kept.where(~F.col("item").rlike(r"^(https?://|\[\[|`)") & ~F.col("item").rlike(CITATION) & F.col("item").rlike("[，。！？：:；;,]")).select("path", "line_no", "item")


def headings(docs: DataFrame, underlined: bool = False) -> DataFrame:
    """``path``, ``line_no``, ``level``, ``title`` of headings outside frontmatter and fences (by a running toggle).

    With ``underlined`` a line of ``=`` or ``-`` under a line of text makes that
    line a heading of the first or second level, as anchors count it; closing
    marks are off the title.
    """
    fenced = F.sum(F.col("line").rlike("^ {0,3}(`{3,}|~{3,})").cast("int")).over(by_line().rowsBetween(Window.unboundedPreceding, 0)) % 2
    # Frontmatter keeps its lines, blanked, so that numbers do not move.
    front = F.regexp_extract("text", r"(?s)\A(---\n.*?\n---(?:\n|\z))", 1)
    blanked = F.concat(F.regexp_replace(front, r"[^\n]", ""), F.substr("text", F.length(front) + 1))
    heads = docs.where(F.col("text").rlike(r"(?m)^ {0,3}(#{1,6}\s+\S|=+[ \t]*$|-+[ \t]*$)" if underlined else r"(?m)^ {0,3}#{1,6}\s+\S")).select("path", blanked.alias("text"))
    lead = " {0,3}" if underlined else ""
    atx = F.col("line").rlike(rf"^{lead}#{{1,6}}\s+\S")
    if underlined:
        told = lines(heads).withColumn("below", F.lead("line").over(by_line()))
    else:  # only fences and headings meet the window
        told = lines(heads).where(atx | F.col("line").rlike("^ {0,3}(`{3,}|~{3,})")).withColumn("below", F.lit(None).cast("string"))
    rows = told.withColumn("fenced", fenced).where("fenced = 0 and line not rlike '^ {0,3}(`{3,}|~{3,})'")
    under = F.col("below").rlike(r"^ {0,3}(=+|-+)[ \t]*$") & F.col("line").rlike(r"^ {0,3}[^\s#>|\-*+=]")
    level = F.when(atx, F.length(F.regexp_extract("line", "^ {0,3}(#{1,6})", 1))).when(F.col("below").rlike("^ {0,3}="), 1).otherwise(2)
    named = F.regexp_extract("line", r"^ {0,3}#{1,6}\s+(.+?)\s*$", 1)
    title = F.when(atx, F.regexp_replace(named, r"[ \t]+#+[ \t]*$", "") if underlined else named).otherwise(F.col("line"))
    return rows.where(atx | (F.lit(underlined) & F.coalesce(under, F.lit(False)))).select("path", "line_no", level.alias("level"), F.trim(title).alias("title"))


def sections(docs: DataFrame, level: int = 2) -> DataFrame:
    """``path``, ``section`` (number), ``title``, ``body`` under headings of up to ``level`` marks."""
    rows = lines(docs)
    is_head = F.col("line").rlike(rf"^#{{1,{level}}}\s+\S")
    numbered = rows.withColumn("section", F.sum(is_head.cast("int")).over(by_line().rowsBetween(Window.unboundedPreceding, 0))).where("section > 0")
    parts = F.array_sort(F.collect_list(F.struct("line_no", "line")))
    grouped = numbered.groupBy("path", "section").agg(parts.alias("p"))
    title = F.trim(F.regexp_replace(F.element_at("p", 1)["line"], "^#+", ""))
    body = F.array_join(F.transform(F.slice("p", F.lit(2), F.size("p")), lambda x: x["line"]), "\n")
    return grouped.select("path", "section", title.alias("title"), body.alias("body"))


def formulas(docs: DataFrame) -> DataFrame:
    """``path``, ``pos``, ``formula``: what stands between pairs of ``$$``."""
    parts = F.split("text", r"\$\$")
    inner = F.filter(parts, lambda x, k: (k % 2 == 1) & (k < F.size(parts) - 1))
    return docs.select("path", F.posexplode(inner).alias("pos", "formula"))
