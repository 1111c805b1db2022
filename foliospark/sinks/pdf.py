"""PDF files of plain lines, in several ways of packing objects, streams and characters.

Cases: a null text is a file of one empty page; every character is kept, as codes
are UTF-16 units that a character map turns back; a text of any length is cut
into pages of ``PAGE_LINES`` lines.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

PAGE_LINES = 48
LEVEL = 1  # of packing: the others take thrice the time
#: How a file is packed: objects as they stand, in object streams with a predicted cross-reference stream, or with streams in text form; ``broken`` has no cross-reference at all.
WAYS = ("plain", "packed", "text", "broken")


def _map(codes: bytes) -> bytes:
    """The character map of codes that are UTF-16 units, for the high bytes that a text has."""
    rows = [f"<{k:02X}00> <{k:02X}FF> <{k:02X}00>" for k in sorted(set(codes[::2]))]
    groups = ["\n".join([f"{len(rows[k : k + 100])} beginbfrange", *rows[k : k + 100], "endbfrange"]) for k in range(0, len(rows), 100)]
    return "\n".join(["/CIDInit /ProcSet findresource begin 12 dict begin begincmap", "1 begincodespacerange <0000> <FFFF> endcodespacerange", *groups, "endcmap end end"]).encode()


def _stream(data: bytes, way: str) -> bytes:
    packed, names = zlib.compress(data, LEVEL), "/FlateDecode"
    if way == "text":
        packed, names = base64.a85encode(packed) + b"~>", "[/ASCII85Decode /FlateDecode]"
    return f"<< /Length {len(packed)} /Filter {names} >>\nstream\n".encode() + packed + b"\nendstream"


def _predicted(rows: list[bytes]) -> bytes:
    """Rows with the predictor that keeps differences to the row above."""
    above, out = bytes(len(rows[0])), bytearray()
    for row in rows:
        out += b"\x02" + bytes((a - b) & 255 for a, b in zip(row, above, strict=True))
        above = row
    return bytes(out)


def pdf_of(text: str, way: str) -> bytes:
    """One file."""
    lines = text.split("\n")
    pages = [lines[k : k + PAGE_LINES] for k in range(0, len(lines), PAGE_LINES)]
    kids = " ".join(f"{5 + 2 * k} 0 R" for k in range(len(pages)))
    objects = {
        1: b"<< /Type /Catalog /Pages 2 0 R >>",
        2: f"<< /Type /Pages /Count {len(pages)} /Kids [{kids}] /Resources << /Font << /F1 3 0 R >> >> /MediaBox [0 0 612 792] >>".encode(),
        3: b"<< /Type /Font /Subtype /Type0 /BaseFont /F /Encoding /Identity-H /DescendantFonts [<< /Type /Font /Subtype /CIDFontType2 /BaseFont /F /CIDSystemInfo << /Registry (Adobe) /Ordering (Identity) /Supplement 0 >> >>] /ToUnicode 4 0 R >>",
        4: _stream(_map(text.encode("utf-16-be", "surrogatepass")), way),
    }
    for k, page in enumerate(pages):
        shown = "\n".join(f"<{line.encode('utf-16-be', 'surrogatepass').hex()}> Tj T*" for line in page)
        objects[5 + 2 * k] = f"<< /Type /Page /Parent 2 0 R /Contents {6 + 2 * k} 0 R >>".encode()
        objects[6 + 2 * k] = _stream(f"BT /F1 10 Tf 12 TL 40 750 Td\n{shown}\nET".encode(), way)
    out, places = bytearray(b"%PDF-1.7\n"), {}
    inside = [n for n, body in objects.items() if not body.endswith(b"endstream")] if way == "packed" else []
    for number, body in objects.items():
        if number not in inside:
            places[number] = (1, len(out), 0)
            out += f"{number} 0 obj\n".encode() + body + b"\nendobj\n"
    size = max(objects) + 1
    if way == "packed":
        at, offsets, bodies = 0, [], []
        for k, number in enumerate(inside):
            offsets.append(f"{number} {at}")
            bodies.append(objects[number])
            at += len(objects[number]) + 1
            places[number] = (2, size, k)
        head = (" ".join(offsets) + "\n").encode()
        packed = zlib.compress(head + b"\n".join(bodies))
        places[size] = (1, len(out), 0)
        out += f"{size} 0 obj\n<< /Type /ObjStm /N {len(inside)} /First {len(head)} /Length {len(packed)} /Filter /FlateDecode >>\nstream\n".encode() + packed + b"\nendstream\nendobj\n"
        start = len(out)
        places[size + 1] = (1, start, 0)
        rows = [bytes(7)] + [places[n][0].to_bytes(1, "big") + places[n][1].to_bytes(4, "big") + places[n][2].to_bytes(2, "big") for n in range(1, size + 2)]
        table = zlib.compress(_predicted(rows))
        parms = "<< /Predictor 12 /Columns 7 >>"
        out += f"{size + 1} 0 obj\n<< /Type /XRef /Size {size + 2} /W [1 4 2] /Root 1 0 R /Length {len(table)} /Filter /FlateDecode /DecodeParms {parms} >>\nstream\n".encode() + table + b"\nendstream\nendobj\n"
    elif way != "broken":
        start = len(out)
        out += f"xref\n0 {size}\n0000000000 65535 f \n".encode() + b"".join(f"{places[n][1]:010d} 00000 n \n".encode() for n in range(1, size)) + f"trailer\n<< /Size {size} /Root 1 0 R >>\n".encode()
    if way != "broken":
        out += f"startxref\n{start}\n%%EOF\n".encode()
    return bytes(out)


def pdf_files(docs: DataFrame, batch_rows: int = 64) -> DataFrame:
    """``path``, ``content`` of a PDF for each row (``path``, ``text``, ``way``)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for k in range(0, len(batch), batch_rows):
                some = batch.iloc[k : k + batch_rows]
                yield pd.DataFrame({"path": some["path"], "content": [pdf_of(t or "", w) for t, w in zip(some["text"], some["way"], strict=True)]})

    return docs.select("path", "text", "way").mapInPandas(run, "path string, content binary")
