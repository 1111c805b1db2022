"""Markdown scanners whose state spans lines: Arrow functions, one document per row."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliospark.functions.commonmark import blocks, code_spans


_UNBROKEN = re.compile(r"[^\r\n]+")


def _blank(text: str) -> str:
    return _UNBROKEN.sub(lambda m: " " * len(m[0]), text)


def mask_inline(text: str, escapes: bool = True) -> str:
    """Code spans of equal backtick runs, within one block of lines, blanked in place; each run is looked at once."""
    if "`" not in text:
        return text
    runs = [(m.start(), m.end()) for m in re.finditer("`+", text) if not (escapes and m.start() and text[m.start() - 1] == "\\")]
    later: dict[int, list[int]] = {}
    for k in range(len(runs) - 1, -1, -1):
        later.setdefault(runs[k][1] - runs[k][0], []).append(k)  # the nearest run of a length is last
    out, done, k = [], 0, 0
    while k < len(runs):
        a, b = runs[k]
        same = later[b - a]
        while same and same[-1] <= k:
            same.pop()
        if not same:
            k += 1
            continue
        close = same.pop()
        out += [text[done:a], _blank(text[a : runs[close][1]])]
        done, k = runs[close][1], close + 1
    return "".join([*out, text[done:]])


def _masked(text: str) -> tuple[str, bool, bool]:
    """Fenced, indented and inline code blanked in place, and whether a fence was left open at the text's end, or there or by its container.

    Blocks are those of ``functions.commonmark``; whole lines of block code are
    blanked, containers' marks stay where there is none.  Positions do not move.
    """
    pieces = re.split("(\r\n|\r|\n)", text)
    lines, ends = pieces[::2], pieces[1::2] + [""]
    out, unclosed, left = list(lines), False, False
    for block in blocks(lines):
        if block.kind in ("fence", "indented"):
            left |= block.kind == "fence" and block.open
            unclosed |= block.kind == "fence" and block.open and block.last
            for number, _, _ in block.lines:
                out[number] = " " * len(lines[number])
        elif block.kind == "text" and any("`" in lines[n] for n, _, _ in block.lines):
            _mask_spans(block.lines, lines, out)
    return "".join(x for pair in zip(out, ends, strict=True) for x in pair), unclosed, left


def mask_code(text: str) -> tuple[str, bool]:
    """Fenced, indented and inline code blanked in place, and whether a fence is open at the text's end."""
    return _masked(text)[:2]


def _mask_spans(parts: list[tuple[int, int, int]], lines: list[str], out: list[str]) -> None:
    """Blanks the code spans of a paragraph or heading in its lines."""
    spans = iter(code_spans("\n".join(lines[n][start:end] for n, start, end in parts)))
    at, span = 0, next(spans, None)
    for n, start, end in parts:
        done, made = 0, [lines[n][:start]]
        while span and span[0] <= at + end - start:
            low, high = max(span[0] - at, 0), min(span[1] - at, end - start)
            made += [lines[n][start + done : start + low], " " * (high - low)]
            done = high
            if span[1] - at > end - start:  # goes on in the next line
                break
            span = next(spans, None)
        out[n] = "".join(made) + lines[n][start + done :]
        at += end - start + 1


@F.pandas_udf(T.StructType().add("masked", T.StringType()).add("unclosed", T.BooleanType()).add("left_open", T.BooleanType()))
def masked_code(text: pd.Series) -> pd.DataFrame:
    """``masked``, ``unclosed`` (a fence, at the text's end) and ``left_open`` (there, or where its container ended)."""
    rows = [(None, None, None) if t is None else _masked(t) for t in text]
    return pd.DataFrame(rows, columns=["masked", "unclosed", "left_open"])


def without_code(text: Column) -> Column:
    """The text with code blanked; only texts that hold a mark or an indentation of code go to Python."""
    may = text.rlike("`|~~~| {4}|\\t")
    return F.when(may, masked_code(F.when(may, text))["masked"]).otherwise(text)


_COMMENT = re.compile(r"<!--.*?(?:-->|\Z)|%%.*?(?:%%|\Z)", re.S)


@F.pandas_udf(T.StringType())
def masked_comments(text: pd.Series) -> pd.Series:
    """HTML comments and ``%%`` spans blanked in place; one without an end runs to the end of the text."""
    return text.map(lambda t: None if t is None else _COMMENT.sub(lambda m: _blank(m[0]), t))


_PLAIN_FENCE = re.compile(r" {0,3}(?:(`{3,})(?!.*`)|(~{3,})).*")


@F.pandas_udf(T.StringType())
def visible_text(text: pd.Series) -> pd.Series:
    """The text without the contents of frontmatter, fences at a line's start and HTML comments; lines keep their numbers, but for those inside comments."""

    def one(value: str) -> str:
        rows = re.split("\r\n|\r|\n", value)
        front = rows.index("---", 1) + 1 if rows[0].strip() == "---" and "---" in rows[1:] else 0
        kept, mark = [""] * front, ""
        for line in rows[front:]:
            m = _PLAIN_FENCE.fullmatch(line)
            if mark:
                run = line.strip(" ")
                ends = m and run[0] == mark[0] and len(run.rstrip()) >= len(mark) and not run.strip(mark[0] + " \t")
                mark = "" if ends else mark
                kept.append("")
            elif m:
                mark = m[1] or m[2]
                kept.append("")
            else:
                kept.append(line)
        return re.sub(r"<!--.*?-->", "", "\n".join(kept), flags=re.S)

    return text.map(lambda t: None if t is None else one(t))


_FENCE = re.compile(r" {0,3}(`{3,}|~{3,})")


def mask_plain(text: str) -> str:
    """The simpler masking: fences, lines of four blanks or a tab, then code spans over the whole text."""
    out, fence = [], None
    for line in text.splitlines(keepends=True):
        m = _FENCE.match(line)
        if fence:
            out.append(_blank(line))
            if m and m[1][0] == fence[0] and len(m[1]) >= len(fence):
                fence = None
        elif m:
            fence = m[1]
            out.append(_blank(line))
        else:
            out.append(_blank(line) if line.startswith(("    ", "\t")) else line)
    return mask_inline("".join(out))


@F.pandas_udf(T.StringType())
def masked_plain(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else mask_plain(t))


def inline_links(text: str, depth: int = 32) -> list[tuple[str, int, int]]:
    """Inline links (no images): destination, start and end; labels nest, destinations balance up to ``depth``."""
    found, k, n = [], 0, len(text)
    while k < n:
        if text[k] == "\\":
            k += 2
            continue
        if text[k] != "[" or (k and text[k - 1] == "!"):
            k += 1
            continue
        level, j = 0, k
        while j < n:
            if text[j] == "\\":
                j += 1
            elif text[j] == "[":
                level += 1
            elif text[j] == "]":
                level -= 1
                if not level:
                    break
            j += 1
        if j + 1 >= n or text[j + 1] != "(":
            k += 1
            continue
        target = _destination(text, j + 2, depth)
        if target is None:
            k += 1
            continue
        found.append((target[0], k, target[1]))
        k = target[1]
    return found


def _destination(text: str, at: int, depth: int) -> tuple[str, int] | None:
    n = len(text)
    while at < n and text[at] in " \t\n":
        at += 1
    if at < n and text[at] == "<":
        end = at + 1
        while end < n and text[end] not in ">\n<":
            end += 2 if text[end] == "\\" else 1
        if end >= n or text[end] != ">":
            return None
        target, at = text[at + 1 : end], end + 1
    else:
        level, start = 0, at
        while at < n and text[at] not in " \t\n":
            if text[at] == "\\":
                at += 1
            elif text[at] == "(":
                level += 1
                if level > depth:
                    return None
            elif text[at] == ")":
                if not level:
                    break
                level -= 1
            at += 1
        if level:
            return None
        target = text[start:at]
    while at < n and text[at] in " \t\n":
        at += 1
    if at < n and text[at] in "\"'(":
        close = ")" if text[at] == "(" else text[at]
        at += 1
        while at < n and text[at] != close:
            at += 2 if text[at] == "\\" else 1
        at += 1
        while at < n and text[at] in " \t\n":
            at += 1
    return (target, at + 1) if at < n and text[at] == ")" else None


@F.pandas_udf(T.ArrayType(T.StructType().add("target", T.StringType()).add("start", T.IntegerType()).add("stop", T.IntegerType())))
def markdown_links(text: pd.Series) -> pd.Series:
    """Inline links of a text whose code is masked."""
    return text.map(lambda t: None if t is None else [{"target": a, "start": b, "stop": c} for a, b, c in inline_links(t)])


_WIKILINK = re.compile(r"(!?)\[\[([^\]\n]+)\]\]")


def visible_line(line: str) -> str:
    """A line as a reader sees it: code spans and embeds blanked in place, of a wikilink its label, or the name and the heading."""

    def shown(m: re.Match) -> str:
        if m[1]:
            return " " * len(m[0])
        target, bar, label = m[2].partition("|")
        if not bar:
            place, _, heading = target.partition("#")
            name = place.rsplit("/", 1)[-1]
            label = f"{name}#{heading}" if name and heading else name or heading
        return f" {label.strip()} "

    return _WIKILINK.sub(shown, mask_inline(line, escapes=False))


@F.pandas_udf(T.StringType())
def visible_prose(line: pd.Series) -> pd.Series:
    return line.map(lambda x: None if x is None else visible_line(x) if "`" in x or "[[" in x else x)
