"""Block structure of Markdown by the public CommonMark rules: where code and inline text stand.

A stack of open containers (quotes and list items) and one open leaf are
carried from line to line.  Each line first goes on in the containers that it
matches, then opens new ones, and what is left joins a leaf; a paragraph takes a
line that has left its containers without opening anything else (a lazy line).

Cases: an empty text has no blocks; tabs count to the next multiple of four,
also where a container takes only part of one; a fence that its container or the
text's end closes counts as left open.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

# Names of elements that begin a block of HTML.
_HTML_NAMES = (
    "address|article|aside|base|basefont|blockquote|body|caption|center|col|colgroup|dd|details|dialog|dir|div|dl|dt|fieldset|figcaption|figure|footer|form|frame|frameset|h1|h2|h3|h4|h5|h6|head|header|hr|html|iframe|legend|li|link|main|menu|menuitem|nav|noframes|ol|optgroup|option|p|param|search|section|summary|table|tbody|td|tfoot|th|thead|title|tr|track|ul"
)
_ATTRIBUTES = r"(?:\s+[A-Za-z_:][A-Za-z0-9_.:-]*(?:\s*=\s*(?:[^\s\"'=<>`]+|'[^']*'|\"[^\"]*\"))?)*"
_TAG = rf"<[A-Za-z][A-Za-z0-9-]*{_ATTRIBUTES}\s*/?>|</[A-Za-z][A-Za-z0-9-]*\s*>"
#: How a block of HTML begins and the expression that ends it (none: a blank line).
_HTML = [
    (re.compile(r"<(?:script|pre|style|textarea)(?:\s|>|$)", re.I), re.compile(r"</(?:script|pre|style|textarea)>", re.I)),
    (re.compile(r"<!--"), re.compile(r"-->")),
    (re.compile(r"<\?"), re.compile(r"\?>")),
    (re.compile(r"<![A-Za-z]"), re.compile(r">")),
    (re.compile(r"<!\[CDATA\["), re.compile(r"\]\]>")),
    (re.compile(rf"</?(?:{_HTML_NAMES})(?:\s|/?>|$)", re.I), None),
    (re.compile(rf"(?:{_TAG})\s*$"), None),
]
_RULE = re.compile(r"(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$")
_HEADING = re.compile(r"#{1,6}(?:[ \t]|$)")
_UNDERLINE = re.compile(r"(?:=+|-+)[ \t]*$")
_FENCE = re.compile(r"(`{3,})([^`]*)$|(~{3,})(.*)$")
_MARKER = re.compile(r"([-+*])(?=[ \t]|$)|(\d{1,9})([.)])(?=[ \t]|$)")
#: What inline text holds besides code: escapes, tags and addresses in angle brackets, runs of backticks.
_INLINE = re.compile(rf"\\[!-/:-@\[-`{{-~]|`+|(?:{_TAG})|<!--(?:>|->|.*?-->)|<\?.*?\?>|<![A-Za-z][^>]*>|<!\[CDATA\[.*?\]\]>|<[A-Za-z][A-Za-z0-9.+-]{{1,31}}:[^\s<>]*>", re.S)
#: A line that defines a link; a paragraph of nothing else has no text for an underline.
_DEFINITION = re.compile(r" {0,3}\[(?:[^\[\]\\]|\\.)+\]:[ \t]*(?:<[^<>]*>|[^\s<]\S*)(?:[ \t]+(?:\"[^\"]*\"|'[^']*'|\([^)]*\)))?[ \t]*$")


@dataclass
class Block:
    """A leaf: its kind (``text``, ``fence``, ``indented``, ``html``) and, for each of its lines, number, start and end of its content."""

    kind: str
    lines: list[tuple[int, int, int]] = field(default_factory=list)
    open: bool = False
    last: bool = False  # ended by the text's end


class _Cursor:
    """A line that is eaten by columns."""

    def __init__(self, line: str):
        self.line, self.at, self.column, self.rest = line, 0, 0, 0

    def indent(self) -> tuple[int, int]:
        """Columns of white space ahead, and where it ends."""
        at, column = self.at, self.column + self.rest
        while at < len(self.line) and self.line[at] in " \t":
            column += 1 if self.line[at] == " " else 4 - column % 4
            at += 1
        return column - self.column, at

    def eat(self, columns: int) -> None:
        """Takes white space, or one other character for each column; a tab may be taken in part."""
        while columns > 0 and (self.rest or self.at < len(self.line)):
            if self.rest:
                taken = min(self.rest, columns)
                self.rest -= taken
                self.column += taken
                columns -= taken
                continue
            if self.line[self.at] == "\t":
                self.rest = 4 - self.column % 4
                self.at += 1
                continue
            self.at += 1
            self.column += 1
            columns -= 1

    def blank(self) -> bool:
        return self.indent()[1] >= len(self.line)

    def ahead(self) -> str:
        return self.line[self.indent()[1] :]


@dataclass
class _Item:
    """An open list item: the columns that its lines are indented by, and whether it holds nothing yet."""

    width: int
    empty: bool


class _Blocks:
    def __init__(self) -> None:
        self.stack: list[_Item | None] = []  # a quote is None
        self.leaf: Block | None = None
        self.mark, self.size, self.ends = "", 0, None  # of an open fence; what ends open HTML
        self.out: list[Block] = []

    def close(self) -> None:
        """Ends the open leaf."""
        if self.leaf is not None:
            while self.leaf.kind == "indented" and self.leaf.lines and self.leaf.lines[-1][1] == self.leaf.lines[-1][2]:
                self.leaf.lines.pop()  # blank lines at the end of code are none of it
            self.out.append(self.leaf)
        self.leaf = None

    def begin(self, kind: str) -> None:
        self.close()
        self.leaf = Block(kind, open=kind == "fence")

    def kind(self) -> str:
        return self.leaf.kind if self.leaf else ""

    def matched(self, line: _Cursor) -> int:
        """How many open containers the line goes on in."""
        for k, item in enumerate(self.stack):
            indent, at = line.indent()
            blank = at >= len(line.line)
            if item is None:
                if indent > 3 or blank or line.line[at] != ">":
                    return k
                line.eat(indent + 1)
                if line.indent()[0]:
                    line.eat(1)
            elif blank:
                if item.empty:
                    return k
                line.eat(min(indent, item.width))
            elif indent >= item.width:
                line.eat(item.width)
            else:
                return k
        return len(self.stack)

    def filled(self, upto: int | None = None) -> None:
        for item in self.stack[:upto]:
            if item is not None:
                item.empty = False

    def leave(self, keep: int) -> None:
        """Closes the containers above ``keep``, and the leaf in them."""
        if keep < len(self.stack):
            self.close()
            del self.stack[keep:]

    def marker(self, line: _Cursor, interrupts: bool) -> tuple[re.Match, bool] | None:
        m = _MARKER.match(line.ahead())
        if m and not (interrupts and (not line.ahead()[m.end() :].strip() or (m[2] and int(m[2]) != 1))):
            return m, not line.ahead()[m.end() :].strip()
        return None

    def feed(self, number: int, text: str) -> None:
        line = _Cursor(text)
        keep = self.matched(line)
        inside = keep == len(self.stack)
        if inside and self.kind() in ("fence", "html") and self.leaf.open:
            self.verbatim(number, line)
            return
        lazy = self.kind() == "text" and self.leaf.open
        opened = False
        while not line.blank():
            indent, at = line.indent()
            ahead = line.ahead()
            # A paragraph is there to go on in only while nothing has been opened on this line.
            para = lazy and not opened
            if indent > 3:
                break
            if ahead[0] == ">":
                self.leave(keep)
                self.close()
                self.filled()
                line.eat(indent + 1)
                if line.indent()[0]:
                    line.eat(1)
                self.stack.append(None)
            elif para and inside and _UNDERLINE.match(ahead) and not all(_DEFINITION.match(text_) for text_ in self.held):
                self.leaf.open = False
                self.close()
                return
            elif _RULE.match(ahead) or _HEADING.match(ahead):
                self.leave(keep)
                self.close()
                self.filled()
                if _HEADING.match(ahead):
                    self.out.append(Block("text", [(number, at, len(text))]))
                return
            elif m := _FENCE.match(ahead):
                self.leave(keep)
                self.begin("fence")
                self.filled()
                token = m[1] or m[3]
                self.mark, self.size = token[0], len(token)
                self.leaf.lines.append((number, at, len(text)))
                return
            elif self.html(ahead, para):
                self.leave(keep)
                self.begin("html")
                self.filled()
                self.leaf.open = True
                self.verbatim(number, line)
                return
            elif (found := self.marker(line, para and inside)) is not None:
                m, bare = found
                self.leave(keep)
                self.close()
                self.filled()
                line.eat(indent + m.end())
                gap = line.indent()[0]
                taken = gap if 1 <= gap <= 4 and not bare else 1
                line.eat(taken)
                self.stack.append(_Item(indent + m.end() + taken, bare))
            else:
                break
            keep, opened, inside = len(self.stack), True, True
        self.rest(number, line, keep, lazy and not opened, opened)

    def rest(self, number: int, line: _Cursor, keep: int, para: bool, opened: bool) -> None:
        """What is left of a line after its containers."""
        indent, at = line.indent()
        if line.blank():
            if not opened:
                self.leave(keep)
            if self.kind() == "indented":
                self.leaf.lines.append((number, len(line.line), len(line.line)))
            else:
                self.close()
            return
        if para:  # also a lazy line, whatever containers it has left
            self.leaf.lines.append((number, at, len(line.line)))
            self.held.append(line.line[at:])
            return
        self.leave(keep)
        self.filled()
        if indent > 3:
            if self.kind() != "indented":
                self.begin("indented")
            self.leaf.lines.append((number, line.at, len(line.line)))
            return
        self.begin("text")
        self.leaf.open = True
        self.held = [line.line[at:]]
        self.leaf.lines.append((number, at, len(line.line)))

    held: list[str] = []

    def html(self, ahead: str, para: bool) -> bool:
        for k, (begins, ends) in enumerate(_HTML):
            if begins.match(ahead) and not (para and k == len(_HTML) - 1):
                self.ends = ends
                return True
        return False

    def verbatim(self, number: int, line: _Cursor) -> None:
        """A line of an open fence or of open HTML."""
        indent, at = line.indent()
        if self.kind() == "fence":
            self.leaf.lines.append((number, line.at, len(line.line)))
            run = line.ahead().rstrip(" \t")
            if indent <= 3 and len(run) >= self.size and run == self.mark * len(run):
                self.leaf.open = False
                self.close()
            return
        if self.ends is None and line.blank():
            self.leaf.open = False
            self.close()
            return
        self.leaf.lines.append((number, at, len(line.line)))
        if self.ends is not None and self.ends.search(line.ahead()):
            self.leaf.open = False
            self.close()


def blocks(lines: list[str]) -> list[Block]:
    """The leaves of a text, given as lines without their ends."""
    state = _Blocks()
    for number, line in enumerate(lines):
        state.feed(number, line)
    if state.leaf is not None:
        state.leaf.last = True
    state.close()
    return state.out


def code_spans(text: str) -> Iterator[tuple[int, int]]:
    """Start and end of the code spans of one inline text; each run of backticks is looked at once."""
    runs: dict[int, list[int]] = {}
    for m in re.finditer("`+", text):
        runs.setdefault(len(m[0]), []).append(m.start())
    for starts in runs.values():
        starts.reverse()  # the next of a length is last
    at = 0
    while m := _INLINE.search(text, at):
        at = m.end()
        if m[0][0] != "`":
            continue
        same = runs.get(len(m[0]), [])
        while same and same[-1] < m.end():
            same.pop()
        if same:
            at = same[-1] + len(m[0])
            yield m.start(), at
