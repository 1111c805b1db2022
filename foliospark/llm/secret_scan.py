"""Secrets in whole texts: credential patterns, and random strings by token efficiency.

Three patterns name a secret by its surroundings or its form: an assignment to
a credential's name, an access key, a hexadecimal string.  The fourth kind
needs no pattern: a byte-pair vocabulary learned from prose and code spends few
characters a token on random strings and many on words, so a run of key
characters with few characters a token is reported, after digests, numbered
identifiers, words joined by marks and strings known to be harmless have been
set aside.

Cases: a null text is empty and an empty text has no span; places are code
points; a run of any length is counted whole, in pieces of ``PIECE_CHARS`` for the
encoder; rows are scanned one by one, so repeats and null ids stay; a run inside
a span of the patterns is not reported again; an empty table gives an empty
result.  Columns of the input named like a result column are replaced by it.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from foliospark.llm._common import bounded_batches, fresh, lean

#: The kinds of span, in the order in which spans of one start are listed.
KINDS = ("assign", "access", "hex", "random")


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_NAMES = "|".join(map(_either_case, ["password", "passwd", "secret", "token", "api_?key"]))
_ASSIGN = re.compile(rf"""(?:{_NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile("AKIA[A-Z0-9]{14,}")
_HEX = re.compile("[0-9a-f]{16,}")
#: Characters of an assigned value from which it counts.
ASSIGNED_CHARS = 12

_RUN = re.compile("[A-Za-z0-9+/_=-]{20,}")
#: A run of so many characters for a hundred tokens, or fewer, is random.
CHARS_PER_100_TOKENS = 200
#: Characters that the encoder takes at once.
PIECE_CHARS = 4096
# Lengths of hexadecimal digests in common use, 128 to 512 bits, and the form of universal identifiers.
_DIGEST = re.compile("(?:[0-9a-f]+|[0-9A-F]+)")
_DIGEST_CHARS = {32, 40, 48, 56, 64, 96, 128}
_UNIVERSAL = re.compile("[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")
# A word in one case or with humps, with at most four digits behind it, or a number.
_PART = re.compile("(?:(?:[A-Z]?[a-z]{2,}|[A-Z]{2,})*[0-9]{0,4}|[0-9]+)")
_JOINTS = re.compile("[+/_=-]+")


@lru_cache(maxsize=2)
def _encoder(path: str, pattern: str) -> tiktoken.Encoding:
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("folio", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def is_identifier(run: str) -> bool:
    """A digest, a universal identifier, or words and numbers joined by marks."""
    if _UNIVERSAL.fullmatch(run) or (len(run) in _DIGEST_CHARS and _DIGEST.fullmatch(run)):
        return True
    return all(_PART.fullmatch(part) for part in _JOINTS.split(run))


def pattern_spans(text: str) -> list[tuple[int, int, str]]:
    """Spans of the three patterns: start, end, kind."""
    out = [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if len(m.group(1)) >= ASSIGNED_CHARS]
    out += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text)]
    return out + [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]


def random_spans(text: str, encoder: tiktoken.Encoding, known: frozenset[str], chars_per_100: int) -> Iterator[tuple[int, int, str]]:
    """Runs of key characters on which the vocabulary spends few characters a token."""
    for m in _RUN.finditer(text):
        run = m.group()
        if run not in known and not is_identifier(run):
            tokens = sum(len(encoder.encode_ordinary(run[k : k + PIECE_CHARS])) for k in range(0, len(run), PIECE_CHARS))
            if 100 * len(run) <= chars_per_100 * tokens:
                yield m.start(), m.end(), "random"


def scan_text(text: str, encoder: tiktoken.Encoding, known: frozenset[str] = frozenset(), chars_per_100: int = CHARS_PER_100_TOKENS) -> list[tuple[int, int, str]]:
    """All spans by start, then kind as listed in ``KINDS``."""
    spans = pattern_spans(text)
    held, reach = [], -1
    for start, end, _ in sorted(spans):  # ranges that no earlier one holds
        if end > reach:
            held.append((start, end))
            reach = end
    at = 0
    for start, end, kind in random_spans(text, encoder, known, chars_per_100):
        while at < len(held) and held[at][1] < end:
            at += 1
        if at == len(held) or held[at][0] > start:
            spans.append((start, end, kind))
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2])))


def find_secrets(
    docs: DataFrame,
    vocabulary: str,
    word_pattern: str,
    text_col: str = "text",
    keep_columns: list[str] | None = None,
    *,
    known: frozenset[str] = frozenset(),
    chars_per_100: int = CHARS_PER_100_TOKENS,
) -> DataFrame:
    """The kept columns (all, if none are named) and ``folio_secrets``: an array of kind, start and end.

    ``vocabulary`` is the path of a tiktoken file on every executor and
    ``word_pattern`` the expression that cuts its words.  ``known`` are harmless
    strings, as many as a task's memory may hold.
    """
    kept = [c for c in (docs.columns if keep_columns is None else keep_columns) if c.lower() != "folio_secrets"]
    own = fresh("folio_source", kept)
    rows = docs.select(*(docs[f"`{c}`"] for c in kept), docs[text_col].alias(own))
    width = len(kept)
    span = T.StructType().add("kind", "string").add("start", "long").add("end", "long")
    schema = T.StructType([*rows.schema.fields[:width], T.StructField("folio_secrets", T.ArrayType(span))])
    arrow = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(vocabulary, word_pattern)
        for batch in batches:
            found = [[{"kind": k, "start": s, "end": e} for s, e, k in scan_text(text.as_py() or "", encoder, known, chars_per_100)] for text in batch.column(width)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], pa.array(found, type=arrow)], names=schema.names)

    return bounded_batches(rows).mapInArrow(lean(task), schema)
