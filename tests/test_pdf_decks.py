"""PDF files of every way of packing, fonts by their encodings, and damaged files."""

import random
import zlib

import pytest

from foliospark.sinks import packages as pack
from foliospark.sinks import pdf as pdf_sink
from foliospark.sources import office, packages, pdf

TEXTS = ["hello\nworld", "", "é漢😀 a\n\nb " + "x\n" * 120, "(a) <b> \\ \x00\x01 z", "one line " * 400]


@pytest.mark.parametrize("way", pdf_sink.WAYS)
@pytest.mark.parametrize("text", TEXTS)
def test_round_trip(text, way):
    pages = pdf.page_texts(pdf_sink.pdf_of(text, way))
    assert len(pages) == -(-len(text.split("\n")) // pdf_sink.PAGE_LINES) and "\n".join(pages).split() == text.split()


def file_of(objects, stream_filter=""):
    out = b"%PDF-1.4\n" + b"".join(f"{n} 0 obj\n".encode() + body + b"\nendobj\n" for n, body in objects.items())
    return out + b"trailer << /Root 1 0 R >>"


def page_of(code, font=b"<< /Type /Font /Subtype /Type1 >>", head=b"", more=None):
    objects = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Kids [3 0 R] >>", 3: b"<< /Type /Page /Contents 4 0 R /Resources << /Font << /F 5 0 R >> /XObject << /X 6 0 R >> >> >>"}
    objects |= {4: b"<< " + head + b" >>\nstream\n" + code + b"\nendstream", 5: font}
    return pdf.page_texts(file_of(objects | (more or {})))[0]


def test_operators_and_strings():
    assert page_of(rb"BT /F 9 Tf (a\(b\)\101\
c\n(d)) Tj 0 -12 Td <48 69 2> Tj 5 0 Td [(x) -300 (y) 20 (z)] TJ T* (q) ' ET BT 1 0 0 1 9 9 Tm (r) Tj ET") == "a(b)Ac\n(d)\nHi  x yz\nq\nr"


def test_forms_and_inline_images():
    form = b"<< /Subtype /Form /Length 99 >>\nstream\nBT /F 1 Tf (inner) Tj ET /X Do\nendstream"
    assert page_of(b"BT (a) Tj ET BI /W 1 ID \x00(no) Tj\xff EI /X Do", more={6: form}).startswith("a\ninner")


def test_byte_encodings():
    mac = b"<< /Subtype /Type1 /Encoding /MacRomanEncoding >>"
    differences = b"<< /Subtype /Type1 /Encoding << /Differences [65 /eacute /uni6F22 /u1F600 66 /space.x /nothing 97 /fi] >> >>"
    assert page_of(b"BT /F 9 Tf (caf\x8e) Tj ET", mac) == "café" and page_of(b"BT /F 9 Tf (caf\xe9) Tj ET") == "café"
    assert page_of(b"BT /F 9 Tf (ABCa) Tj ET", differences) == "é fi"


def test_character_maps():
    cmap = b"2 begincodespacerange <00> <7F> <8000> <FFFF> endcodespacerange 1 beginbfchar <41> <00660066> endbfchar 2 beginbfrange <8001> <8003> <4E00> <9000> <9001> [<0061> <00620063>] endbfrange"
    font = b"<< /Subtype /Type0 /Encoding /Identity-H /ToUnicode 6 0 R >>"
    more = {6: b"<< /Length 0 >>\nstream\n" + cmap + b"\nendstream"}
    assert page_of(b"BT /F 9 Tf <41 8002 9000 9001 9999 42> Tj ET", font, more=more) == "ff一abc".replace("一", "丁")


def lzw(data):
    """Codes of nine bits only, cleared before the table grows."""
    bits = "".join(format(code, "09b") for k in range(0, len(data), 200) for code in [256, *data[k : k + 200]]) + format(257, "09b")
    return int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")


def greedy_lzw(data):
    """Codes of growing width over a growing table."""
    table, width, out, word = {bytes([k]): k for k in range(256)}, 9, [(256, 9)], b""
    size = 258
    for byte in data:
        if word + bytes([byte]) in table:
            word += bytes([byte])
            continue
        out.append((table[word], width))
        table[word + bytes([byte])] = size
        size += 1
        width = 9 if size < 512 else 10 if size < 1024 else 11 if size < 2048 else 12
        if size == 4094:
            out.append((256, width))
            table, width, size = {bytes([k]): k for k in range(256)}, 9, 258
        word = bytes([byte])
    out += [(table[word], width), (257, width)]
    bits = "".join(format(c, f"0{w}b") for c, w in out)
    return int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")


def run_length(data):
    return b"".join(bytes([len(data[k : k + 100]) - 1]) + data[k : k + 100] for k in range(0, len(data), 100)) + b"\xff \x80"


def test_filters():
    code = b"BT (some shown text) Tj ET % " + bytes(random.Random(3).choices(b"abc ", k=900))
    for name, data in (("/LZWDecode", lzw(code)), ("/ASCIIHexDecode", code.hex().encode() + b">"), ("/RunLengthDecode", run_length(code)), ("[/AHx /Fl]", zlib.compress(code).hex().encode() + b">")):
        assert page_of(data, head=b"/Filter " + name.encode()) == "some shown text"
    long = bytes(random.Random(4).choices(b"abcdefgh", k=60_000))
    assert pdf._lzw(greedy_lzw(long), 1) == long


@pytest.mark.parametrize("kind", [2, 10, 11, 12, 13, 14])
def test_predictors(kind):
    rng, columns, colors = random.Random(kind), 7, 3
    rows = [bytes(rng.choices(range(256), k=columns * colors)) for _ in range(9)]
    out, above = bytearray(), bytes(columns * colors)
    for row in rows:
        left = bytes(colors) + row[:-colors]
        corner = bytes(colors) + above[:-colors]
        paeth = [min((a, b, c), key=lambda v, p=a + b - c: abs(p - v)) for a, b, c in zip(left, above, corner, strict=True)]
        guess = {2: left, 10: bytes(len(row)), 11: left, 12: above, 13: [(a + b) // 2 for a, b in zip(left, above, strict=True)], 14: paeth}[kind]
        out += (b"" if kind == 2 else bytes([kind - 10])) + bytes((x - g) & 255 for x, g in zip(row, guess, strict=True))
        above = row
    assert pdf._unpredicted(bytes(out), {"Predictor": kind, "Columns": columns, "Colors": colors}) == b"".join(rows)


def test_damaged_files(spark):
    good = pdf_sink.pdf_of("some words on a page that are enough", "plain")
    cycle = file_of({1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Kids [2 0 R 3 0 R] >>", 3: b"<< /Type /Page /Contents 3 0 R >>"})
    rows = [
        ("good", good), ("cut", good[: len(good) - 60]), ("shifted", b"junk\n" + good), ("none", b"no file"), ("empty", b""), ("null", None), ("cycle", cycle), ("locked", good.replace(b"/Root 1 0 R", b"/Root 1 0 R /Encrypt << /V 1 >>")),
    ]
    found = {r["source"]: (r["unit_no"], r["text"], r["problem"]) for r in office.pdf_pages(spark.createDataFrame(rows, "path string, content binary")).collect()}
    text = "some words on a page that are enough"
    assert found["good"][:2] == found["cut"][:2] == found["shifted"][:2] == (1, text) and found["cycle"][1] == ""
    assert all(found[k][2] for k in ("none", "empty", "null", "locked")) and "encrypted" in found["locked"][2]


def test_slides_with_groups_tables_and_notes(spark):
    text = lambda t, x=0, y=0: {"kind": "text", "x": x, "y": y, "text": t}
    group = lambda items, x=0, y=0, ext=(100, 100), off=(0, 0), child=(100, 100), **more: {"kind": "group", "x": x, "y": y, "ext": ext, "child_off": off, "child_ext": child, "items": items, **more}
    table = {"kind": "table", "x": 3, "y": 50, "rows": [["a", "b\nc"], ["", "d"], ["", ""], ["", "d"]]}
    inner = group([text("deep", 10, 10)], 20, 20, (20, 20), (0, 0), (10, 10))
    first = [text("last", 0, 900), group([text("in", 50, 60), inner], 1000, 0, (200, 400), (0, 50), (100, 100)), table, {"kind": "picture", "x": 4, "y": 5}, group([text("flip", 30, 0)], 0, 7, flip=True), text("last", 0, 950)]
    bare = group([text("nowhere", 1, 2)], 5, 5, child=(0, 0))
    decks = [("a", pack.laid_deck([{"items": first, "notes": "say\nthis"}, {"items": [bare], "notes": "Click to add notes"}, {"items": []}])), ("b", b"junk"), ("c", None)]
    shapes = packages.slide_shapes(spark.createDataFrame(decks, "path string, content binary"))
    rows = sorted((r["slide_no"], r["top"] if r["top"] is not None else 10**9, r["left"], r["text"], r["kind"]) for r in shapes.collect() if r["source"] == "a")
    places = {t: (top, left) for _, top, left, t, _ in rows}
    assert places["in"] == (4 * (60 - 50), 1000 + 2 * 50) and places["deep"] == (4 * (20 + 2 * 10 - 50), 1000 + 2 * (20 + 2 * 10)) and places["flip"] == (7, 70) and places["nowhere"] == (7, 6)
    assert places["a | b\nc\nd"] == (50, 3) and "say\nthis" in places and "Click to add notes" not in places and places["[Image placeholder: picture 5]"] == (5, 4)
    told = {r["slide_no"]: r["text"] for r in packages.slide_texts(shapes).collect()}
    assert told == {1: "deep\nflip\nin\na | b\nc\nd\nlast", 2: "nowhere"}
    assert [tuple(r) for r in packages.slide_counts(shapes).collect()] == [("a", 3, 1, 1, 1)]
