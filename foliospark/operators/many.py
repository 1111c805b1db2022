"""Many patterns at once: literals by one automaton, expressions gated by a literal that they need.

All patterns of a part go to every task as one closure of checked size; a text
is read once, and an expression is only tried on a line that holds the literal
without which it cannot match.  Expressions without one are tried on every line.
A list larger than ``PART_BYTES`` is worked off in parts, one scan of the texts each.

Cases: null and empty texts have no hits; null and empty patterns are left out;
an expression that cannot be compiled fails the job with its own message.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

try:
    from re import _constants as _codes
    from re import _parser as _parser
except ImportError:  # before Python 3.11
    import sre_constants as _codes
    import sre_parse as _parser

#: Bytes of pattern text that go to the tasks at once.
PART_BYTES = 16 << 20
_BREAK = re.compile("\r\n|\r|\n")


def needed_literal(pattern: str) -> str:
    """The longest literal that every match of an expression holds; empty if none is sure."""
    best = ""

    def walk(items) -> str:
        """Looks for runs of literals; returns the run that the items end with."""
        nonlocal best
        run = ""
        for code, value in items:
            if code is _codes.LITERAL:
                run += chr(value)
            elif code is _codes.SUBPATTERN and not value[1] and not value[2]:
                best = max(best, run, walk(value[3]), key=len)
                run = ""
            elif code in (_codes.MAX_REPEAT, _codes.MIN_REPEAT) and value[0] >= 1:
                best = max(best, run, walk(value[2]), key=len)
                run = ""
            elif code is _codes.AT:
                continue
            else:
                best, run = max(best, run, key=len), ""
        best = max(best, run, key=len)
        return run

    parsed = _parser.parse(pattern)
    if parsed.state.flags & (re.IGNORECASE | re.VERBOSE):
        return ""
    walk(parsed)
    return best if "\n" not in best and "\r" not in best else ""


class _Matcher:
    """The patterns of a part in order; the first that fits a line counts."""

    def __init__(self, patterns: list[str]):
        self.patterns = patterns
        self.compiled: dict[int, re.Pattern] = {}
        self.always: list[int] = []
        by_literal: dict[str, list[int]] = {}
        for k, pattern in enumerate(patterns):
            literal = needed_literal(pattern)
            (by_literal.setdefault(literal, []) if literal else self.always).append(k)
        self.automaton = ahocorasick.Automaton()
        for literal, numbers in by_literal.items():
            self.automaton.add_word(literal, numbers)
        if by_literal:
            self.automaton.make_automaton()

    def fits(self, k: int, line: str) -> bool:
        if k not in self.compiled:
            self.compiled[k] = re.compile(self.patterns[k])
        return self.compiled[k].search(line) is not None

    def first(self, line: str) -> int | None:
        held = {k for _, numbers in self.automaton.iter(line) for k in numbers} if len(self.automaton) else set()
        return next((k for k in sorted(held.union(self.always)) if self.fits(k, line)), None)


_MATCHERS: dict[int, _Matcher] = {}


def _matcher(patterns: tuple[str, ...]) -> _Matcher:
    """One matcher a worker and list."""
    key = hash(patterns)
    if key not in _MATCHERS or _MATCHERS[key].patterns != list(patterns):
        _MATCHERS.clear()
        _MATCHERS[key] = _Matcher(list(patterns))
    return _MATCHERS[key]


def _parts(patterns: DataFrame, text: str) -> Iterator[list[tuple]]:
    """The list in its order, in parts of ``PART_BYTES``."""
    part, size = [], 0
    for row in patterns.select("id", text).where(f"{text} is not null and {text} <> ''").orderBy("id").toLocalIterator():
        if part and size + len(row[1]) > PART_BYTES:
            yield part
            part, size = [], 0
        part.append((row[0], row[1]))
        size += len(row[1])
    if part:
        yield part


def first_patterns(docs: DataFrame, patterns: DataFrame) -> DataFrame:
    """``path``, ``line_no``, ``id`` of the first fitting expression (``id``, ``regex``, Python's syntax) of every line that one fits."""
    kinds = docs.select("path").schema["path"], patterns.select("id").schema["id"]
    schema = T.StructType([kinds[0], T.StructField("line_no", T.IntegerType()), T.StructField("nth", T.IntegerType())])

    def of(part: list[tuple]) -> DataFrame:
        listed = tuple(regex for _, regex in part)
        for regex in listed:
            re.compile(regex)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            matcher = _matcher(listed)
            for batch in batches:
                rows = [(path, n, k) for path, text in zip(batch["path"], batch["text"], strict=True) for n, line in enumerate(_BREAK.split(text), 1) if (k := matcher.first(line)) is not None]
                yield pd.DataFrame(rows, columns=["path", "line_no", "nth"])

        names = docs.sparkSession.createDataFrame([(k, id_) for k, (id_, _) in enumerate(part)], T.StructType([T.StructField("nth", T.IntegerType()), kinds[1]]))
        found = docs.where("text is not null").select("path", "text").mapInPandas(run, schema)
        return found.join(F.broadcast(names), "nth").select("path", "line_no", "id")

    every = [of(part) for part in _parts(patterns, "regex")]
    if not every:
        return docs.limit(0).select("path", F.lit(0).alias("line_no"), F.lit(None).cast(kinds[1].dataType).alias("id"))
    found = reduce(DataFrame.unionByName, every)
    return found.groupBy("path", "line_no").agg(F.min("id").alias("id")) if len(every) > 1 else found


def containing(docs: DataFrame, key: str, literals: DataFrame) -> DataFrame:
    """``id``, ``key`` of every literal (``id``, ``text``) that a document's ``text`` holds."""
    kinds = literals.select("id").schema["id"], docs.select(key).schema[key]
    schema = T.StructType([T.StructField("nth", T.IntegerType()), kinds[1]])

    def of(part: list[tuple]) -> DataFrame:
        numbers: dict[str, list[int]] = {}
        for k, (_, text) in enumerate(part):
            numbers.setdefault(text, []).append(k)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            automaton = ahocorasick.Automaton()
            for text, ks in numbers.items():
                automaton.add_word(text, ks)
            automaton.make_automaton()
            for batch in batches:
                rows = [(k, name) for name, text in zip(batch[key], batch["text"], strict=True) for k in sorted({k for _, ks in automaton.iter(text) for k in ks})]
                yield pd.DataFrame(rows, columns=["nth", key])

        names = docs.sparkSession.createDataFrame([(k, id_) for k, (id_, _) in enumerate(part)], T.StructType([T.StructField("nth", T.IntegerType()), kinds[0]]))
        return docs.where("text is not null").select(key, "text").mapInPandas(run, schema).join(F.broadcast(names), "nth").select("id", key)

    every = [of(part) for part in _parts(literals, "text")]
    return reduce(DataFrame.unionByName, every) if every else docs.limit(0).select(F.lit(None).cast(kinds[0].dataType).alias("id"), key)
