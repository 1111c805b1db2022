"""Readers of PDF, DOCX and legacy PPT over files made here."""

import io
import struct
import zipfile
import zlib

import pytest

from foliospark.sources import office


def pdf(*codes):
    body = b"%PDF-1.4\n"
    for k, code in enumerate(codes):
        data = zlib.compress(code)
        body += b"%d 0 obj << /Type /Page /Contents %d 0 R >> endobj\n" % (2 * k + 10, 2 * k + 11)
        body += b"%d 0 obj << /Filter /FlateDecode /Length %d >>\nstream\n" % (2 * k + 11, len(data)) + data + b"\nendstream endobj\n"
    return body + b"9 0 obj << /Type /Pages >> endobj\n"


def docx(xml):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", xml)
    return out.getvalue()


def record(kind, body, version=0):
    return struct.pack("<HHI", version, kind, len(body)) + body


def compound(stream, cutoff=4096):
    """A compound file with 512-byte sectors: directory, table, then the stream or the mini stream and its table."""
    small = len(stream) < cutoff
    unit = 64 if small else 512
    data = stream + b"\0" * (-len(stream) % 512)
    count = len(data) // 512
    fat = [0xFFFFFFFE, 0xFFFFFFFD, 0xFFFFFFFE] + [k + 4 for k in range(count - 1)] + [0xFFFFFFFE]
    minis = [k + 1 for k in range(-(-len(stream) // 64) - 1)] + [0xFFFFFFFE]

    def entry(name, kind, start, size):
        raw = name.encode("utf-16-le") + b"\0\0"
        return raw.ljust(64, b"\0") + struct.pack("<HB", len(raw), kind) + b"\0" * 49 + struct.pack("<IQ", start, size)

    def sector(numbers):
        return struct.pack(f"<{len(numbers)}I", *numbers).ljust(512, b"\xff")

    directory = (entry("Root Entry", 5, 3 if small else 0xFFFFFFFE, len(stream) if small else 0) + entry("PowerPoint Document", 2, 0 if small else 3, len(stream))).ljust(512, b"\0")
    head = office.CFB_MAGIC + b"\0" * 22 + struct.pack("<HH", 9, 6) + b"\0" * 10
    head += struct.pack("<IIIIIIII", 1, 0, 0, cutoff, 2, 1, 0xFFFFFFFE, 0) + struct.pack("<109I", 1, *[0xFFFFFFFF] * 108)
    assert len(head) == 512 and unit
    return head + directory + sector(fat) + sector(minis) + data


def files(spark, **contents):
    return spark.createDataFrame(list(contents.items()), "path string, content binary")


def test_pdf_pages(spark):
    long = b"BT (A page with \\(enough\\) text to be) Tj T* [(cov) -20 (ered)] TJ ET"
    rows = office.pdf_pages(files(spark, a=pdf(long, b"BT <48 69> Tj ET", b""), b=b"junk", c=None)).orderBy("source", "unit_no").collect()
    assert [(r["source"], r["unit_no"], r["text"]) for r in rows] == [("a", 1, "A page with (enough) text to be\ncovered"), ("a", 2, "Hi"), ("a", 3, ""), ("b", 0, None), ("c", 0, None)]
    assert rows[3]["problem"] and "no content" in rows[4]["problem"]
    found = {r["source"]: r for r in office.extractability(office.pdf_pages(files(spark, a=pdf(long, b"", long), b=b"junk"))).collect()}
    assert found["a"]["blank_units"] == [2] and found["a"]["has_text"] and not found["a"]["low_coverage"]
    assert not found["b"]["has_text"] and found["b"]["observed_units"] == 0 and found["b"]["low_coverage"]
    acts = {r["source"]: r["action"] for r in office.gaps(office.extractability(office.pdf_pages(files(spark, a=pdf(long, b""), b=b"junk", c=pdf(b""))))).collect()}
    assert acts == {"a": "look at the blank units", "b": "repair or convert the file", "c": "run OCR"}


def test_docx(spark):
    xml = '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:p><w:r><w:t>one </w:t><w:t>two</w:t></w:r></w:p><w:p/><w:p><w:r><w:t>three</w:t></w:r></w:p></w:document>'
    rows = {r["source"]: r for r in office.docx_texts(files(spark, a=docx(xml), b=docx("<bad"))).collect()}
    assert rows["a"]["text"] == "one two\nthree" and rows["b"]["unit_no"] == 0 and "ParseError" in rows["b"]["problem"]


@pytest.mark.parametrize("filler", [0, 300])
def test_legacy_ppt(spark, filler):
    texts = record(4000, "标题 One".encode("utf-16-le")) + record(4008, b"plain line\r\n---\r\nplain line") + record(4000, "12".encode("utf-16-le"))
    deep = record(1000, record(1001, texts, 0xF), 0xF) + b"".join(record(4026, f"line {k}".encode("utf-16-le")) for k in range(filler))
    row = office.legacy_ppt_texts(files(spark, a=compound(deep))).first()
    assert row["problem"] is None and row["text"].split("\n") == ["标题 One", "plain line", *[f"line {k}" for k in range(filler)]]


def test_record_bounds():
    nested = b"x"
    for _ in range(80):
        nested = record(1000, nested, 0xF)
    with pytest.raises(ValueError):
        office.ppt_lines(nested)
    assert office.ppt_lines(record(4000, b"")) == [] and office.ppt_lines(b"") == []
