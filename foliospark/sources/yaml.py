"""YAML documents as rows of scalars: block and flow collections, quoted, literal and folded scalars.

The reader follows the public grammar's core: comments and blank lines are
white space, indentation opens and closes block collections, ``- `` opens an
entry, brackets and braces hold flow collections that may run over lines, and
plain scalars are resolved by the core schema.  Anchors, aliases, tags,
directives, complex keys and several documents are refused, never guessed at.

Cases: a null or empty text has no rows; every fault raises ``YamlError``,
which names the line; a repeated key is a fault.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_KEY = re.compile(r"""("(?:[^"\\]|\\.)*"|'(?:[^']|'')*'|[^\s\-?:,\[\]{}#&*!|>'"%@`](?:[^:#]|:(?=\S)|(?<!\s)#)*?|-(?=[^\s])(?:[^:#]|:(?=\S)|(?<!\s)#)*?)\s*:(?=\s|$)""")
_BLOCK = re.compile(r"([|>])(?:([1-9])([+-]?)|([+-])([1-9])?)?\s*(?:#.*)?$")
_NULLS, _TRUE, _FALSE = {"", "~", "null", "Null", "NULL"}, {"true", "True", "TRUE"}, {"false", "False", "FALSE"}
_INT = re.compile(r"[-+]?[0-9]+|0o[0-7]+|0x[0-9a-fA-F]+")
_FLOAT = re.compile(r"[-+]?(?:\.[0-9]+|[0-9]+(?:\.[0-9]*)?)(?:[eE][-+]?[0-9]+)?|[-+]?\.(?:inf|Inf|INF)|\.(?:nan|NaN|NAN)")
# Escapes of double-quoted scalars.
_ESCAPES = {"0": "\0", "a": "\a", "b": "\b", "t": "\t", "\t": "\t", "n": "\n", "v": "\v", "f": "\f", "r": "\r", "e": "\x1b", " ": " ", '"': '"', "/": "/", "\\": "\\", "N": "\x85", "_": "\xa0", "L": "\u2028", "P": "\u2029"}
_CODED = {"x": 2, "u": 4, "U": 8}


class YamlError(ValueError):
    """What keeps a text from being read, and in which line."""

    def __init__(self, line: int, what: str):
        super().__init__(f"line {line}: {what}")


@dataclass(frozen=True)
class Scalar:
    """A leaf: its text, its type (``str``, ``bool``, ``int``, ``float`` or ``null``), whether it was quoted or a block, and its line."""

    text: str
    type: str
    quoted: bool
    line: int


def _plain(text: str, line: int) -> Scalar:
    if text in _NULLS:
        return Scalar("", "null", False, line)
    if text in _TRUE or text in _FALSE:
        return Scalar("true" if text in _TRUE else "false", "bool", False, line)
    if _INT.fullmatch(text):
        return Scalar(str(int(text, 0) if text[:2] in ("0o", "0x") else int(text)), "int", False, line)
    return Scalar(text, "float" if _FLOAT.fullmatch(text) else "str", False, line)


class _Document:
    """A cursor over the lines of a text."""

    def __init__(self, text: str):
        self.lines = re.split("\r\n|\r|\n", text.removeprefix("\ufeff"))
        self.at = 0
        if self.indent() == 0 and re.match(r"---(?:\s|$)", self.lines[self.at]):
            self.lines[self.at] = "   " + self.lines[self.at][3:]
        end = next((k for k, line in enumerate(self.lines) if re.match(r"(?:---|\.\.\.)(?:\s|$)", line)), len(self.lines))
        further = next((k for k in range(end + 1, len(self.lines)) if self.lines[k].strip() and not self.lines[k].lstrip().startswith("#")), None)
        if further is not None or self.lines[end:][:1] and self.lines[end].startswith("---"):
            raise YamlError((end if further is None else further) + 1, "several documents")
        self.lines, self.at = self.lines[:end], 0

    def fault(self, what: str) -> YamlError:
        return YamlError(max(0, min(self.at, len(self.lines) - 1)) + 1, what)

    def indent(self) -> int:
        """The indentation of the next line with content, to which the cursor goes; -1 at the end."""
        while self.at < len(self.lines):
            line = self.lines[self.at]
            body = line.lstrip(" ")
            if body.startswith("\t") and body.strip() and not body.strip().startswith("#"):
                raise self.fault("tab")
            if body.strip() and not body.lstrip().startswith("#"):
                return len(line) - len(body)
            self.at += 1
        return -1

    def block(self, least: int):
        """The node that begins at the cursor, if it is indented by ``least`` or more; else null."""
        indent = self.indent()
        if indent < least:
            return Scalar("", "null", False, self.at + 1)
        body = self.lines[self.at][indent:]
        if re.match(r"-(?:\s|$)", body):
            return self.sequence(indent)
        if _KEY.match(body):
            return self.mapping(indent)
        return self.value(indent, indent)

    def sequence(self, indent: int) -> list:
        out = []
        while self.indent() == indent and (m := re.match(r"-(?:\s+|$)", self.lines[self.at][indent:])):
            rest = self.lines[self.at][indent + m.end() :]
            if not rest or rest.startswith("#"):
                self.at += 1
                out.append(self.block(indent + 1))
            elif re.match(r"-(?:\s|$)", rest) or (_KEY.match(rest) and rest[0] not in "[{"):  # a collection that begins in the entry's own line
                self.lines[self.at] = " " * (indent + m.end()) + rest
                out.append(self.block(indent + 1))
            else:
                out.append(self.value(indent + m.end(), indent + 1))
        self.closed(indent)
        return out

    def mapping(self, indent: int) -> dict:
        out: dict = {}
        while self.indent() == indent:
            body = self.lines[self.at][indent:]
            m = _KEY.match(body)
            if not m:
                raise self.fault("no key")
            key = self.key(m[1])
            if key in out:
                raise self.fault("repeated key")
            rest = body[m.end() :].lstrip()
            if not rest or rest.startswith("#"):
                self.at += 1
                # The entries of a sequence may stand as far in as its key.
                inner = indent if self.indent() == indent and re.match(r"-(?:\s|$)", self.lines[self.at][indent:]) else indent + 1
                out[key] = self.block(inner)
            else:
                out[key] = self.value(len(self.lines[self.at]) - len(rest), indent + 1)
        self.closed(indent)
        return out

    def closed(self, indent: int) -> None:
        if self.indent() > indent:
            raise self.fault("indentation")

    def key(self, raw: str) -> str:
        return _Flow(raw, self.at + 1).node().text if raw[0] in "'\"" else raw.strip()

    def value(self, column: int, least: int):
        """A scalar or a flow collection from ``column`` of the cursor's line; its further lines are indented by ``least``."""
        first, line = self.lines[self.at][column:], self.at + 1
        if first[0] in "&*!%@`?" and not (first[0] == "?" and first[1:2].strip()):
            raise self.fault("not supported")
        if re.match(r"-\s", first):
            raise self.fault("indentation")
        if m := _BLOCK.match(first):
            self.at += 1
            return Scalar(self.literal(m[1], int(m[2] or m[5] or 0), m[3] or m[4] or "", least), "str", True, line)
        if first[0] in "|>":
            raise self.fault("block header")
        if first[0] in "[{'\"":
            return self.flow(first, least)
        words = [re.sub(r"(?:^|\s+)#.*$", "", first).strip()]
        self.at += 1
        while words[-1] == first.strip() or len(words) > 1:  # a comment ends a plain scalar
            blanks = self.at
            if self.indent() < least or re.match(r"-(?:\s|$)", self.lines[self.at].lstrip()):
                break
            if _KEY.match(self.lines[self.at].lstrip()):
                raise self.fault("indentation")
            raw = self.lines[self.at].strip()
            words += [""] * (self.at - blanks) + [re.sub(r"\s+#.*$", "", raw)]
            self.at += 1
            if words[-1] != raw:
                break
        text = _folded(words)
        if re.search(r":\s", text):
            raise YamlError(line, "no key")
        return _plain(text, line)

    def flow(self, first: str, least: int):
        """A quoted scalar or flow collection, read on over lines until it is closed."""
        start, text = self.at, first
        while True:
            reader = _Flow(text, start + 1)
            try:
                found = reader.node()
            except _Open:
                self.at += 1
                if self.at >= len(self.lines) or (self.lines[self.at].strip() and len(self.lines[self.at]) - len(self.lines[self.at].lstrip()) < least):
                    raise YamlError(start + 1, "not closed") from None
                text += "\n" + self.lines[self.at]
                continue
            if not re.fullmatch(r"\s*(?:(?<=\s)#.*)?", text[reader.at :]):
                raise YamlError(self.at + 1, "text after a value")
            self.at += 1
            return found

    def literal(self, style: str, given: int, chomp: str, least: int) -> str:
        """A block scalar from the cursor's line on."""
        start = self.at
        while self.at < len(self.lines) and (not self.lines[self.at].strip(" ") or len(self.lines[self.at]) - len(self.lines[self.at].lstrip(" ")) >= max(least, 1)):
            self.at += 1
        raw = self.lines[start : self.at]
        indent = least - 1 + given if given else min((len(x) - len(x.lstrip(" ")) for x in raw if x.strip(" ")), default=least)
        rows = [x[indent:] for x in raw]
        while rows and not rows[-1].strip(" "):
            rows.pop()
        trailing = len(raw) - len(rows) - (self.at == len(self.lines) and not self.lines[-1])
        body = "\n".join(rows) if style == "|" else _folded_block(rows)
        return body + {"-": "", "": "\n" if rows else "", "+": "\n" * (bool(rows) + max(0, trailing))}[chomp]


def _folded(words: list[str]) -> str:
    """Lines of a flow scalar: one break is a blank, more are one break less."""
    out, breaks = words[0], 0
    for word in words[1:]:
        breaks += 1
        if word:
            out += (" " if breaks == 1 else "\n" * (breaks - 1)) + word
            breaks = 0
    return out


def _folded_block(rows: list[str]) -> str:
    """Lines of a folded block: breaks between lines of text fold, those around further indented lines stay."""
    out, breaks, before = "", 0, None
    for k, row in enumerate(rows):
        breaks += k > 0
        if row:
            kept = before is None or row[0] in " \t" or before[0] in " \t"
            out += ("\n" * breaks if kept else " " if breaks == 1 else "\n" * (breaks - 1)) + row
            before, breaks = row, 0
    return out


class _Open(Exception):
    """A flow node that goes on in the next line."""


class _Flow:
    """Tokens of a flow node: marks, quoted scalars and plain scalars."""

    def __init__(self, text: str, line: int):
        self.text, self.line, self.at = text, line, 0

    def fault(self, what: str) -> YamlError:
        return YamlError(self.line + self.text.count("\n", 0, self.at), what)

    def peek(self) -> str:
        m = re.compile(r"(?:\s|(?<=\s)#[^\n]*)*").match(self.text, self.at)
        self.at = m.end()
        if self.at >= len(self.text):
            raise _Open
        return self.text[self.at]

    def node(self):
        mark = self.peek()
        if mark == "[":
            return self.collection("]", [])
        if mark == "{":
            return self.collection("}", {})
        return self.quoted(mark) if mark in "'\"" else self.plain()

    def collection(self, end: str, out):
        self.at += 1
        while self.peek() != end:
            item = self.node()
            if isinstance(out, dict) or self.peek() == ":":
                value = Scalar("", "null", False, self.line)
                if not isinstance(item, Scalar):
                    raise self.fault("not supported")
                if self.peek() == ":":
                    self.at += 1
                    value = self.node() if self.peek() not in ",]}" else value
                if isinstance(out, dict):
                    if item.text in out:
                        raise self.fault("repeated key")
                    out[item.text] = value
                else:
                    out.append({item.text: value})
            else:
                out.append(item)
            if self.peek() == ",":
                self.at += 1
            elif self.peek() != end:
                raise self.fault("no comma")
        self.at += 1
        return out

    def plain(self) -> Scalar:
        m = re.compile(r"(?:[^\s,\[\]{}:#&*!|>'\"%@`]|:(?=[^\s,\[\]{}]))(?:[^,\[\]{}:#\n]|:(?=[^\s,\[\]{}])|(?<!\s)#)*").match(self.text, self.at)
        if not m:
            raise self.fault("not supported")
        line = self.line + self.text.count("\n", 0, self.at)
        self.at = m.end()
        return _plain(m[0].strip(), line)

    def quoted(self, mark: str) -> Scalar:
        line = self.line + self.text.count("\n", 0, self.at)
        shape = r"'((?:[^']|'')*)'(?!')" if mark == "'" else r'"((?:[^"\\]|\\.|\\\n)*)"'
        m = re.compile(shape, re.S).match(self.text, self.at)
        if not m:
            raise _Open
        self.at = m.end()
        if mark == "'":
            return Scalar(_unbroken(m[1]).replace("''", "'"), "str", True, line)
        joined = _unbroken(re.sub(r"(?<!\\)((?:\\\\)*)\\\n[ \t]*", r"\1", m[1]))
        return Scalar(re.sub(r"\\(?:x(.{0,2})|u(.{0,4})|U(.{0,8})|(.))", self.escape, joined, flags=re.S), "str", True, line)

    def escape(self, m: re.Match) -> str:
        if m[4] is not None:
            if m[4] not in _ESCAPES:
                raise self.fault("escape")
            return _ESCAPES[m[4]]
        digits = m[1] if m[1] is not None else m[2] if m[2] is not None else m[3]
        if len(digits) != _CODED[m[0][1]] or not re.fullmatch("[0-9a-fA-F]+", digits) or int(digits, 16) > 0x10FFFF:
            raise self.fault("escape")
        return chr(int(digits, 16))


def _unbroken(text: str) -> str:
    """A quoted scalar's lines folded, the blanks around breaks off."""
    first, *rest = text.split("\n")
    if not rest:
        return text
    return _folded([first.rstrip(" \t"), *(x.strip(" \t") for x in rest[:-1]), rest[-1].lstrip(" \t")]) + ("" if rest[-1].strip(" \t") else " ")


def read(text: str):
    """The document as dictionaries, lists and ``Scalar`` leaves."""
    document = _Document(text)
    found = document.block(0)
    if document.indent() >= 0:
        raise document.fault("indentation")
    return found


def leaves(node, path: str = "") -> Iterator[tuple[str, str, str, bool, int]]:
    """Path (``a.b[0].c``), text, type, whether quoted, and line of each leaf; empty collections are leaves."""
    if isinstance(node, Scalar):
        yield path, node.text, node.type, node.quoted, node.line
    elif isinstance(node, dict):
        for key, value in node.items():
            yield from leaves(value, f"{path}.{key}" if path else key)
        if not node:
            yield path, "", "map", False, 0
    else:
        for k, value in enumerate(node):
            yield from leaves(value, f"{path}[{k}]")
        if not node:
            yield path, "", "list", False, 0


LEAF = T.StructType().add("key", "string").add("value", "string").add("type", "string").add("quoted", "boolean").add("line", "integer")
_LEAVES = T.StructType().add("leaves", T.ArrayType(LEAF)).add("problem", "string")


@F.pandas_udf(_LEAVES)
def yaml_leaves(text: pd.Series) -> pd.DataFrame:
    """``leaves`` of a YAML mapping, or the ``problem`` that keeps it from being read."""
    rows = []
    for value in text:
        try:
            found = read(value or "")
            if isinstance(found, Scalar) and found.type == "null":
                found = {}
            if not isinstance(found, dict):
                raise YamlError(1, "no key")
            rows.append(([dict(zip(LEAF.names, leaf, strict=True)) for leaf in leaves(found) if leaf[0]], None))
        except YamlError as error:
            rows.append((None, str(error)))
    return pd.DataFrame(rows, columns=["leaves", "problem"])
