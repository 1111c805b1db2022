"""Text of PDF pages without other libraries: object and cross-reference streams, filters, predictors and character maps.

A file is read through its cross-reference chain, or by a scan for objects where
that is broken.  Streams pass Flate, LZW, ASCII85, hexadecimal and run-length
filters and the predictors of images and tables.  The codes of a font become
text by its ToUnicode map, else by its byte encoding and differences.

Cases: an encrypted file and one without pages raise ``PdfError``; a reference to
nothing is null; cycles of pages, forms and cross-references end at the second
visit; codes without a known character give none; output is bounded by
``MAX_BYTES`` a stream.
"""

from __future__ import annotations

import re
import struct
import unicodedata
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np

#: Bytes that one stream may unpack to, and how deep objects and forms may nest.
MAX_BYTES, MAX_DEPTH = 256 << 20, 64
#: Thousandths of an em that a gap inside a line needs to be a blank.
WORD_GAP = 180
#: Bytes of a character map that files may share.
SHARED_MAP = 64 << 10

_SPACE = b"\0\t\n\f\r "
_SKIPPED, _NUMERIC = _SPACE + b"%", b"+-.0123456789"
_CONSTANTS = {b"true": True, b"false": False, b"null": None}
_SKIP = re.compile(rb"(?:[\0\t\n\f\r ]+|%[^\r\n]*)*")
_REGULAR = re.compile(rb"[^\0\t\n\f\r ()<>\[\]{}/%]+")
_NUMBER = re.compile(rb"[-+]?(?:\d+\.?\d*|\.\d+)$")
_REF = re.compile(rb"(\d+)[\0\t\n\f\r ]+(\d+)[\0\t\n\f\r ]+R(?![^\0\t\n\f\r ()<>\[\]{}/%])")
_OBJECT = re.compile(rb"(?<![0-9])(\d+)[\0\t\n\f\r ]+(\d+)[\0\t\n\f\r ]+obj\b")
_ENTRY = re.compile(rb"\s*(\d{1,10})\s+(\d{1,5})\s+([nf])")
# Escapes of strings, and names of glyphs that are no letters.
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
_GLYPHS = {
    "space": " ", "exclam": "!", "quotedbl": '"', "numbersign": "#", "dollar": "$", "percent": "%", "ampersand": "&", "quotesingle": "'", "quoteright": "’", "quoteleft": "‘", "parenleft": "(", "parenright": ")", "asterisk": "*", "plus": "+",
    "comma": ",", "hyphen": "-", "period": ".", "slash": "/", "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9", "colon": ":", "semicolon": ";", "less": "<",
    "equal": "=", "greater": ">", "question": "?", "at": "@", "bracketleft": "[", "backslash": "\\", "bracketright": "]", "underscore": "_", "grave": "`", "braceleft": "{", "bar": "|", "braceright": "}", "asciitilde": "~", "endash": "–",
    "emdash": "—", "bullet": "•", "ellipsis": "…", "quotedblleft": "“", "quotedblright": "”", "germandbls": "ß", "ae": "æ", "AE": "Æ", "oe": "œ", "OE": "Œ", "oslash": "ø", "Oslash": "Ø", "fi": "fi", "fl": "fl", "Euro": "€", "degree": "°",
}
_ACCENTS = {"acute": "́", "grave": "̀", "circumflex": "̂", "dieresis": "̈", "tilde": "̃", "ring": "̊", "cedilla": "̧", "caron": "̌"}


class PdfError(ValueError):
    """What keeps a file from being read."""


class Name(str):
    """A name object."""


class Word(bytes):
    """An operator or other bare word."""


@dataclass(frozen=True)
class Ref:
    number: int


@dataclass
class Stream:
    head: dict
    data: bytes


class _Reader:
    """Objects one after the other from bytes."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def skip(self) -> None:
        if self.data[self.at : self.at + 1] in _SKIPPED:  # also at the end
            self.at = _SKIP.match(self.data, self.at).end()

    def object(self, depth: int = 0):
        """The next object; ``None`` for null, ``Word`` for anything bare, and ``StopIteration`` at the end."""
        self.skip()
        data, at = self.data, self.at
        if at >= len(data):
            raise StopIteration
        if depth > MAX_DEPTH:
            raise PdfError("nested too deep")
        one = data[at : at + 1]
        if one == b"<":
            if data.startswith(b"<<", at):
                self.at += 2
                items = self.until(b">>", depth)
                return {k: v for k, v in zip(items[::2], items[1::2], strict=False) if isinstance(k, Name)}
            end = data.find(b">", at)
            end = len(data) if end < 0 else end
            raw, self.at = data[at + 1 : end], end + 1
            try:
                return bytes.fromhex(raw.decode("ascii"))
            except ValueError:  # an odd number of digits, or something between them
                digits = re.sub(rb"[^0-9A-Fa-f]", b"", raw)
                return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
        if one == b"[":
            self.at += 1
            return self.until(b"]", depth)
        if one == b"(":
            return self.string()
        if one == b"/":
            m = _REGULAR.match(data, at + 1)
            raw = m[0] if m else b""
            self.at += 1 + len(raw)
            if b"#" in raw:
                raw = re.sub(rb"#([0-9A-Fa-f]{2})", lambda x: bytes([int(x[1], 16)]), raw)
            return Name(raw.decode("latin-1"))
        if one.isdigit() and (m := _REF.match(data, at)):
            self.at = m.end()
            return Ref(int(m[1]))
        m = _REGULAR.match(data, at)
        if not m:
            self.at += 1
            return Word(one)
        self.at, raw = m.end(), m[0]
        if one in _NUMERIC and _NUMBER.match(raw):
            return float(raw) if b"." in raw else int(raw)
        return _CONSTANTS[raw] if raw in _CONSTANTS else Word(raw)

    def until(self, end: bytes, depth: int) -> list:
        out = []
        while True:
            self.skip()
            if self.at >= len(self.data) or self.data.startswith(end, self.at):
                self.at += len(end)
                return out
            out.append(self.object(depth + 1))

    def string(self) -> bytes:
        out, open_, at = [], 1, self.at + 1
        part = re.compile(rb"[^()\\]+|\\(?:[0-7]{1,3}|\r\n|.)|[()]", re.S)
        while open_ and (m := part.match(self.data, at)):
            at, token = m.end(), m[0]
            if token[:1] == b"\\" and len(token) > 1:
                body = token[1:]
                token = bytes([int(body, 8) & 255]) if body[:1].isdigit() and body[0] < 0x38 else b"" if body in (b"\n", b"\r", b"\r\n") else _ESCAPES.get(body, body)
            elif token in b"()":
                open_ += 1 if token == b"(" else -1
                if not open_:
                    break
            out.append(token)
        self.at = at
        return b"".join(out)


def _flate(data: bytes) -> bytes:
    """Unpacks what can be unpacked, as files are often cut short."""
    engine, out, size = zlib.decompressobj(), [], 0
    try:
        while data and size <= MAX_BYTES:
            out.append(engine.decompress(data, 1 << 20))
            size += len(out[-1])
            data = engine.unconsumed_tail
    except zlib.error:
        if not out:
            raise PdfError("damaged stream") from None
    if size > MAX_BYTES:
        raise PdfError("stream too large")
    return b"".join(out)


def _lzw(data: bytes, early: int) -> bytes:
    table: list[bytes] = []
    out, size, last, width, held, bits = [], 0, b"", 9, 0, 0
    for byte in data:
        held, bits = (held << 8 | byte) & 0xFFFFFF, bits + 8
        if bits < width:
            continue
        bits -= width
        code = held >> bits & ((1 << width) - 1)
        if code == 257:
            break
        if code == 256 or not table:
            table, width, last = [bytes([k]) for k in range(256)] + [b"", b""], 9, b""
            if code == 256:
                continue
        entry = table[code] if code < len(table) else last + last[:1]
        if last and len(table) < 4096:
            table.append(last + entry[:1])
        out.append(entry)
        size += len(entry)
        if size > MAX_BYTES:
            raise PdfError("stream too large")
        last = entry
        width = 9 if len(table) + early < 512 else 10 if len(table) + early < 1024 else 11 if len(table) + early < 2048 else 12
    return b"".join(out)


def _ascii85(data: bytes) -> bytes:
    digits = re.sub(rb"[\0\t\n\f\r ]", b"", data).removeprefix(b"<~").split(b"~", 1)[0]
    digits = digits.replace(b"z", b"!!!!!")  # four zero bytes
    short = -len(digits) % 5
    if short == 4:  # a single digit holds no byte
        digits, short = digits[:-1], 0
    values = np.frombuffer(digits + b"u" * short, dtype=np.uint8).astype(np.int64).reshape(-1, 5) - 33
    whole = (np.clip(values, 0, 84) @ np.array([85**k for k in (4, 3, 2, 1, 0)])) & 0xFFFFFFFF
    out = whole.astype(">u4").tobytes()
    return out[: len(out) - short]


def _run_length(data: bytes) -> bytes:
    out, at = bytearray(), 0
    while at < len(data) and data[at] != 128:
        n = data[at]
        out += data[at + 1 : at + 2 + n] if n < 128 else data[at + 1 : at + 2] * (257 - n)
        at += n + 2 if n < 128 else 2
        if len(out) > MAX_BYTES:
            raise PdfError("stream too large")
    return bytes(out)


def _unpredicted(data: bytes, parms: dict) -> bytes:
    """Rows of samples as they were before a predictor."""
    kind, colors, depth, columns = (int(parms.get(k, d) or d) for k, d in (("Predictor", 1), ("Colors", 1), ("BitsPerComponent", 8), ("Columns", 1)))
    if kind < 2:
        return data
    step, width = max(1, colors * depth // 8), (colors * depth * columns + 7) // 8
    out, above = bytearray(), bytes(width)
    if kind == 2:
        for k in range(0, len(data), width):
            row = bytearray(data[k : k + width])
            for i in range(step, len(row) if depth == 8 else 0):
                row[i] = (row[i] + row[i - step]) & 255
            out += row
        return bytes(out)
    for k in range(0, len(data), width + 1):
        how, row = data[k], bytearray(data[k + 1 : k + 1 + width])
        for i in range(len(row)):
            left, up, corner = row[i - step] if i >= step else 0, above[i], above[i - step] if i >= step else 0
            if how == 1:
                row[i] = (row[i] + left) & 255
            elif how == 2:
                row[i] = (row[i] + up) & 255
            elif how == 3:
                row[i] = (row[i] + (left + up) // 2) & 255
            elif how == 4:
                guess = left + up - corner
                row[i] = (row[i] + min((left, up, corner), key=lambda v: abs(guess - v))) & 255
        out += row
        above = bytes(row) + bytes(width - len(row))
    return bytes(out)


class Document:
    """Objects of a file by number."""

    def __init__(self, data: bytes):
        self.data = data
        self.places: dict[int, int | tuple[int, int]] = {}  # an offset, or number in an object stream
        self.trailer: dict = {}
        self.known: dict[int, object] = {}
        self.packed: dict[int, list] = {}
        try:
            self.chain()
            sound = isinstance(self.get(self.trailer.get("Root")), dict)
        except (PdfError, ValueError, StopIteration, IndexError, TypeError, AttributeError):
            sound = False
        if not sound:
            self.scan()
        if self.trailer.get("Encrypt") is not None:
            raise PdfError("encrypted")

    def chain(self) -> None:
        """The cross-reference sections from the last to the first; the newest place of an object counts."""
        at = self.data.rfind(b"startxref")
        todo, seen = [int(re.match(rb"startxref\s*(\d+)", self.data[at : at + 64])[1])], set()
        while todo:
            at = todo.pop(0)
            if at in seen or at < 0:
                continue
            seen.add(at)
            head = self.table(at) if self.data[at : at + 64].lstrip(_SPACE).startswith(b"xref") else self.stream_table(at)
            for key, value in head.items():
                self.trailer.setdefault(key, value)
            todo = [int(head[k]) for k in ("XRefStm", "Prev") if isinstance(head.get(k), (int, float))] + todo

    def table(self, at: int) -> dict:
        reader = _Reader(self.data, self.data.index(b"xref", at) + 4)
        while isinstance(first := reader.object(), int):
            for k in range(reader.object()):
                m = _ENTRY.match(self.data, reader.at)
                reader.at = m.end()
                if m[3] == b"n":
                    self.places.setdefault(first + k, int(m[1]))
        return reader.object()

    def stream_table(self, at: int) -> dict:
        found = self.at(at)
        widths, rows = found.head["W"], self.unpacked(found)
        index, size = found.head.get("Index") or [0, found.head["Size"]], sum(widths)
        numbers = (n for first, count in zip(index[::2], index[1::2], strict=True) for n in range(first, first + count))
        for k, n in enumerate(numbers):
            row, parts, at = rows[k * size : (k + 1) * size], [], 0
            for w in widths:
                parts.append(int.from_bytes(row[at : at + w], "big") if w else None)
                at += w
            kind = 1 if parts[0] is None else parts[0]
            if len(row) == size and kind in (1, 2):
                self.places.setdefault(n, parts[1] if kind == 1 else (parts[1], parts[2] or 0))
        return found.head

    def scan(self) -> None:
        """All objects of the bytes, the last of a number, and those inside object streams."""
        self.known.clear()
        self.packed.clear()
        self.places = {int(m[1]): m.start() for m in _OBJECT.finditer(self.data)}
        for m in re.finditer(rb"trailer", self.data):
            try:
                head = _Reader(self.data, m.end()).object()
            except StopIteration:
                continue
            self.trailer |= head if isinstance(head, dict) else {}
        for number in list(self.places):
            found = self.get(Ref(number))
            kind = found.head.get("Type") if isinstance(found, Stream) else found.get("Type") if isinstance(found, dict) else None
            if kind == "ObjStm":
                for k, (inner, _) in enumerate(self.members(number)):
                    self.places.setdefault(inner, (number, k))
            elif kind == "XRef":
                self.trailer |= {k: v for k, v in found.head.items() if k in ("Root", "Encrypt")}
            elif kind == "Catalog" and "Root" not in self.trailer:
                self.trailer["Root"] = Ref(number)
        for number in list(self.places):  # a catalogue may lie in an object stream
            if "Root" not in self.trailer and isinstance(found := self.get(Ref(number)), dict) and found.get("Type") == "Catalog":
                self.trailer["Root"] = Ref(number)

    def at(self, at: int):
        m = _OBJECT.match(self.data, _SKIP.match(self.data, at).end())
        if not m:
            raise PdfError("no object where one is said to be")
        reader = _Reader(self.data, m.end())
        found = reader.object()
        reader.skip()
        if isinstance(found, dict) and self.data.startswith(b"stream", reader.at):
            start = reader.at + 6
            start += 2 if self.data.startswith(b"\r\n", start) else self.data[start : start + 1] in (b"\n", b"\r")
            length = self.get(found.get("Length"))
            end = start + int(length) if isinstance(length, (int, float)) else -1
            if end < 0 or not re.compile(rb"\s*endstream").match(self.data, end):
                end = self.data.find(b"endstream", start)
                end = len(self.data) if end < 0 else end
            return Stream(found, self.data[start:end])
        return found

    def members(self, number: int) -> list[tuple[int, object]]:
        """Number and object of everything in an object stream."""
        if number not in self.packed:
            self.packed[number] = []
            holder = self.get(Ref(number))
            data, first = self.unpacked(holder), int(self.get(holder.head["First"]))
            reader = _Reader(data)
            pairs = [(reader.object(), reader.object()) for _ in range(int(self.get(holder.head["N"])))]
            self.packed[number] = [(n, _Reader(data, first + at).object()) for n, at in pairs]
        return self.packed[number]

    def get(self, value):
        """The object that a reference leads to, through references to references."""
        for _ in range(MAX_DEPTH):
            if not isinstance(value, Ref):
                return value
            number = value.number
            if number not in self.known:
                self.known[number] = None  # of a cycle
                place = self.places.get(number)
                if isinstance(place, tuple):
                    self.known[number] = dict(self.members(place[0])).get(number)
                elif place is not None:
                    self.known[number] = self.at(place)
            value = self.known[number]
        return None

    def unpacked(self, stream: Stream) -> bytes:
        """A stream's bytes after its filters."""
        as_list = lambda v: v if isinstance(v, list) else [] if v is None else [v]
        filters = as_list(self.get(stream.head.get("Filter", stream.head.get("F"))))
        parms = as_list(self.get(stream.head.get("DecodeParms", stream.head.get("DP"))))
        data = stream.data
        for k, raw in enumerate(filters):
            name = self.get(raw)
            parm = self.get(parms[k]) if k < len(parms) else None
            parm = {key: self.get(v) for key, v in parm.items()} if isinstance(parm, dict) else {}
            if name in ("FlateDecode", "Fl"):
                data = _unpredicted(_flate(data), parm)
            elif name in ("LZWDecode", "LZW"):
                data = _unpredicted(_lzw(data, int(parm.get("EarlyChange", 1))), parm)
            elif name in ("ASCII85Decode", "A85"):
                data = _ascii85(data)
            elif name in ("ASCIIHexDecode", "AHx"):
                digits = re.sub(rb"[^0-9A-Fa-f]", b"", data.split(b">", 1)[0])
                data = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
            elif name in ("RunLengthDecode", "RL"):
                data = _run_length(data)
            else:
                raise PdfError(f"filter {name}")
        return data

    def pages(self) -> Iterator[tuple[dict, dict]]:
        """Page and resources in reading order."""
        root = self.get(self.trailer.get("Root"))
        if not isinstance(root, dict):  # no tree: every page there is, by its number
            loose = (self.get(Ref(n)) for n in sorted(self.places))
            yield from ((p, self.get(p.get("Resources")) or {}) for p in loose if isinstance(p, dict) and p.get("Type") == "Page")
        todo, seen = [(root.get("Pages"), {})] if isinstance(root, dict) else [], set()
        while todo:
            ref, above = todo.pop()
            if isinstance(ref, Ref):
                if ref in seen:
                    continue
                seen.add(ref)
            node = self.get(ref)
            if not isinstance(node, dict):
                continue
            own = self.get(node.get("Resources"))
            own = own if isinstance(own, dict) else above
            kids = self.get(node.get("Kids"))
            if isinstance(kids, list):
                todo += [(kid, own) for kid in reversed(kids)]
            else:
                yield node, own


def _glyph(name: str) -> str:
    """The text of a glyph's name, by rule."""
    base = name.split(".", 1)[0]
    if base in _GLYPHS:
        return _GLYPHS[base]
    if len(base) == 1:
        return base
    if m := re.fullmatch(r"uni((?:[0-9A-F]{4})+)|u([0-9A-F]{4,6})", base):
        return bytes.fromhex(m[1]).decode("utf-16-be", "replace") if m[1] else chr(min(int(m[2], 16), 0x10FFFF))
    if base[1:] in _ACCENTS:
        return unicodedata.normalize("NFC", base[0] + _ACCENTS[base[1:]])
    return ""


@dataclass
class Font:
    """How codes become text: the lengths of codes by their first bytes, what they stand for, and a byte encoding for the rest."""

    spaces: list[tuple[int, bytes, bytes]] = field(default_factory=list)
    texts: dict[bytes, str] = field(default_factory=dict)
    ranges: list[tuple[bytes, bytes, bytes]] = field(default_factory=list)
    bytewise: dict[int, str] | None = None
    known: dict[int, str] | None = None  # texts of codes of one length, as numbers

    def text(self, data: bytes) -> str:
        out, at = [], 0
        if len({n for n, _, _ in self.spaces}) == 1:  # codes of one length
            size = self.spaces[0][0]
            if size <= 2:
                whole = data[: len(data) // size * size]
                known = self.known if self.known is not None else _Codes(self, size)
                self.known = known
                out = ["".join(map(known.__getitem__, whole if size == 1 else struct.unpack(f">{len(whole) // 2}H", whole)))]
            else:
                out = [self.one(data[k : k + size]) for k in range(0, len(data), size)]
            at = len(data)
        while at < len(data):
            size = next((n for n, low, high in self.spaces if all(a <= b <= c for a, b, c in zip(low, data[at : at + n], high, strict=False)) and at + n <= len(data)), self.spaces[0][0] if self.spaces else 1)
            code = data[at : at + size]
            at += size
            out.append(self.one(code))
        whole = "".join(out)
        return whole if whole.isascii() else whole.encode("utf-16-be", "surrogatepass").decode("utf-16-be", "replace")

    def one(self, code: bytes) -> str:
        """The text of one code; ranges are searched once for each code that occurs."""
        found = self.texts.get(code)
        if found is None:
            found = (self.bytewise or {}).get(code[0], "") if len(code) == 1 else ""
            for low, high, first in self.ranges:
                if len(low) == len(code) and low <= code <= high:
                    shift = int.from_bytes(code, "big") - int.from_bytes(low, "big")
                    found = (int.from_bytes(first, "big") + shift).to_bytes(len(first) + 1, "big")[-len(first) :].decode("utf-16-be", "surrogatepass")
                    break
            self.texts[code] = found
        return found


class _Codes(dict):
    """The texts of a font's codes of one length, found when they first occur."""

    def __init__(self, font: Font, size: int):
        super().__init__()
        self.font, self.size = font, size

    def __missing__(self, code: int) -> str:
        self[code] = text = self.font.one(code.to_bytes(self.size, "big"))
        return text


def _character_map(data: bytes, font: Font) -> None:
    """Reads a ToUnicode map into a font."""
    reader, held = _Reader(data), []
    while True:
        try:
            token = reader.object()
        except StopIteration:
            break
        if not isinstance(token, Word):
            held.append(token)
            continue
        if token == b"endcodespacerange":
            font.spaces += [(len(a), a, b) for a, b in zip(held[::2], held[1::2], strict=False) if isinstance(a, bytes) and a]
        elif token == b"endbfchar":
            font.texts |= {a: b.decode("utf-16-be", "surrogatepass") if len(b) % 2 == 0 else b.decode("latin-1") for a, b in zip(held[::2], held[1::2], strict=False) if isinstance(a, bytes) and isinstance(b, bytes)}
        elif token == b"endbfrange":
            for low, high, first in zip(held[::3], held[1::3], held[2::3], strict=False):
                if isinstance(first, list):
                    codes = range(int.from_bytes(low, "big"), int.from_bytes(high, "big") + 1)
                    font.texts |= {n.to_bytes(len(low), "big"): t.decode("utf-16-be", "surrogatepass") for n, t in zip(codes, first, strict=False) if isinstance(t, bytes)}
                elif isinstance(first, bytes) and isinstance(low, bytes):
                    font.ranges.append((low, high, first if len(first) > 1 else b"\0" + first))
        held = []
    font.spaces.sort()
    font.ranges.sort()


@lru_cache(maxsize=8)
def _composite(map_: bytes) -> Font:
    """The font of a character map alone, with the codes that it has met: files of one writer share few maps."""
    font = Font()
    _character_map(map_, font)
    font.spaces = font.spaces or [(2, b"\0\0", b"\xff\xff")]
    return font


@lru_cache(maxsize=8)
def _encoding(name: str) -> dict[int, str]:
    codec = {"MacRomanEncoding": "mac_roman"}.get(name, "cp1252")
    return {k: bytes([k]).decode(codec, "ignore") for k in range(256)}


def _font(document: Document, raw) -> Font:
    head, font = document.get(raw), Font()
    if not isinstance(head, dict):
        return Font(bytewise=_encoding(""))
    stream = document.get(head.get("ToUnicode"))
    map_ = document.unpacked(stream) if isinstance(stream, Stream) else b""
    if head.get("Subtype") == "Type0":
        shared = _composite(map_) if len(map_) <= SHARED_MAP else None
        few = shared and all(size <= 2 for size, _, _ in shared.spaces)  # codes, that a shared font may keep
        return shared if few else _composite.__wrapped__(map_)
    encoding = document.get(head.get("Encoding"))
    base = encoding.get("BaseEncoding", "") if isinstance(encoding, dict) else encoding or ""
    font.bytewise = dict(_encoding(str(base)))
    code = 0
    for item in (document.get(encoding.get("Differences")) or []) if isinstance(encoding, dict) else []:
        if isinstance(item, Name):
            font.bytewise[code] = _glyph(item)
            code += 1
        elif isinstance(item, (int, float)):
            code = int(item)
    _character_map(map_, font)
    font.spaces = [(1, b"\0", b"\xff")]
    return font


class _Page:
    """What a page shows, line by line."""

    def __init__(self, document: Document):
        self.document, self.out = document, []
        self.fonts: dict[int, Font] = {}
        self.font = Font(bytewise=_encoding(""))
        self.line_y, self.shown = 0.0, False

    def moved(self, y: float, x_only: bool) -> None:
        """The next text stands elsewhere: on another line, or further on this one."""
        if self.out and self.shown:
            self.out.append(" " if x_only else "\n")
        self.shown = False
        self.line_y = y

    def show(self, data) -> None:
        if isinstance(data, bytes) and data:
            self.out.append(self.font.text(data))
            self.shown = True

    def run(self, code: bytes, resources: dict, depth: int = 0) -> None:
        reader, held = _Reader(code), []
        named = lambda kind, name: (self.document.get(resources.get(kind)) or {}).get(name)
        number = lambda k: float(held[k]) if len(held) >= -k and isinstance(held[k], (int, float)) else 0.0
        while True:
            try:
                token = reader.object()
            except StopIteration:
                return
            if not isinstance(token, Word):
                held.append(token)
                continue
            if token == b"Tf" and len(held) >= 2:
                raw = named("Font", held[-2])
                key = raw.number if isinstance(raw, Ref) else id(raw)
                if key not in self.fonts:
                    self.fonts[key] = _font(self.document, raw)
                self.font = self.fonts[key]
            elif token in (b"Td", b"TD"):
                self.moved(self.line_y + number(-1), number(-1) == 0)
            elif token == b"Tm":
                self.moved(number(-1), number(-1) == self.line_y)
            elif token in (b"T*", b"'", b'"', b"BT"):
                self.moved(self.line_y, False)
                if token in (b"'", b'"') and held:
                    self.show(held[-1])
            elif token == b"Tj" and held:
                self.show(held[-1])
            elif token == b"TJ" and held and isinstance(held[-1], list):
                for item in held[-1]:
                    if isinstance(item, bytes):
                        self.show(item)
                    elif isinstance(item, (int, float)) and -item >= WORD_GAP and self.shown:
                        self.out.append(" ")
            elif token == b"Do" and held and depth < MAX_DEPTH:
                form = self.document.get(named("XObject", held[-1]))
                if isinstance(form, Stream) and form.head.get("Subtype") == "Form":
                    own = self.document.get(form.head.get("Resources"))
                    self.run(self.document.unpacked(form), own if isinstance(own, dict) else resources, depth + 8)
            elif token == b"ID":  # an image between words
                m = re.compile(rb"[\0\t\n\f\r ]EI(?=[\0\t\n\f\r ]|$)").search(code, reader.at)
                reader.at = m.end() if m else len(code)
            held = []


def page_texts(content: bytes) -> list[str]:
    """The text of each page."""
    document = Document(content)
    out = []
    for page, resources in document.pages():
        parts = document.get(page.get("Contents"))
        streams = [document.get(p) for p in (parts if isinstance(parts, list) else [parts])]
        code = b"\n".join(document.unpacked(s) for s in streams if isinstance(s, Stream))
        shown = _Page(document)
        shown.run(code, resources)
        out.append("".join(shown.out).rstrip(" \n"))
    if not out:
        raise PdfError("no pages")
    return out
