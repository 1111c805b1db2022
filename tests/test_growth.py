"""Work that has to grow with the input alone: what leaves a pass, how often it runs, and results as before."""

import contextlib
import io
import re

import pandas as pd
from pyspark.sql import functions as F

from foliospark.catalog import queries
from foliospark.functions import markdown
from foliospark.functions.text import holds
from foliospark.operators import frames, gate, rules
from foliospark.sinks import pdf as pdf_sink
from foliospark.sources import office, pdf


def plan_of(rows):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        rows.explain()
    return out.getvalue()


def test_sentences_are_cut_where_paragraphs_are_found(spark):
    texts = ["One sentence that is long enough! Short? And the last of them has no mark at all", "!!! marks come before this sentence of words；；and 24 characters are just here; too short", "", None, "# T\n\nfirst paragraph, one line of it\nand its second line。\n\nx" * 3]
    docs = spark.createDataFrame(list(enumerate(texts)), "path long, text string")
    found = frames.sentences(docs)
    assert "regexp_extract_all" not in plan_of(found)
    pattern = "[^。！？!?；;]+[。！？!?；;]+|[^。！？!?；;]+$"
    wanted = [(k, pos, n, nth, s) for k, text in enumerate(texts) for pos, (n, p) in enumerate(frames.prose(text or "")) for nth, raw in enumerate(re.findall(pattern, p)) if len(s := raw.strip(" ")) >= frames.MIN_CHARS]
    assert len(wanted) > 4 and sorted(tuple(r) for r in found.collect()) == sorted(wanted)


def test_pdf_units_leave_together_and_missing_readers_are_looked_for_once(spark, monkeypatch):
    tried = []

    def missing(content):
        tried.append(content)
        raise ImportError

    monkeypatch.setattr(office, "PDF_READERS", [("missing", missing), ("plain", pdf.page_texts)])
    made = [pdf_sink.pdf_of(f"page of file {k} with enough words on it\n" * 50, pdf_sink.WAYS[k % 4]) for k in range(8)]
    texts = [office._pdf(content) for content in made]
    assert len(tried) == 1 and all(method == "plain" and len(pages) == 2 for pages, method in texts)

    class Files:  # the function that the pass runs
        select = lambda self, *names: self
        mapInPandas = lambda self, run, schema: run  # noqa: E731, N815

    run = office.pdf_pages(Files())
    batches = list(run(iter([pd.DataFrame({"path": list("abcdefgh"), "content": made})])))
    assert len(batches) == 1 and batches[0]["source"].tolist() == [x for x in "abcdefgh" for _ in range(2)]
    assert batches[0]["text"].tolist() == [p for pages, _ in texts for p in pages]


def test_fonts_of_one_map_are_shared_and_others_are_not():
    text = {way: pdf.page_texts(pdf_sink.pdf_of("shared map, é漢😀", way)) for way in pdf_sink.WAYS}
    before = pdf._composite.cache_info().misses
    assert all(pdf.page_texts(pdf_sink.pdf_of("shared map, é漢😀", way)) == text[way] == ["shared map, é漢😀"] for way in pdf_sink.WAYS)
    assert pdf._composite.cache_info().misses == before
    assert pdf.page_texts(pdf_sink.pdf_of("another map: ж", "plain")) == ["another map: ж"]


def test_decks_are_made_and_read_once(spark):
    assert plan_of(queries()["deck_layouts"](spark, "/root/testdata/sf0.001")).count("MapInPandas") == 2


def test_metadata_is_read_once(spark):
    assert plan_of(queries()["package_metadata"](spark, "/root/testdata/sf0.001")).count("ArrowEvalPython") == 1


def test_literal_markers_are_found_as_their_pattern_finds_them(spark):
    assert all(re.fullmatch(gate.RESIDUE, m) for m in gate.MARKERS) and len(gate.MARKERS) == gate.RESIDUE.count("|") + 1
    texts = [None, "", "plain", "..", "a... b", "a.b.c", "x\ty", "   y", "    z", "~~", "~~~", *(f"before {m} after" for m in gate.MARKERS), *(m[:-1] for m in gate.MARKERS)]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select("text", holds(F.col("text"), gate.MARKERS).alias("m"), holds(F.col("text"), gate.MAY_BE_CODE).alias("c"))
    for text, marked, code in rows.collect():
        assert (marked, code) == ((None, None) if text is None else (bool(re.search(gate.RESIDUE, text)), bool(re.search("`|~~~| {4}|\t", text))))


def test_masked_texts_are_not_taken_apart_by_characters():
    for text in ("no code", "a `b\r\nc` d `e", "```\n\x0bcode\r```\nafter `x`", "\\`not` `yes` ``no`", "    four\n\ttab\nplain"):
        blanked = "".join(c if c in "\r\n" else " " for c in text)
        assert markdown._blank(text) == blanked and len(markdown.mask_plain(text)) == len(text)
    assert markdown.mask_inline("a `b\r\nc` d `e") == "a   \r\n   d `e" and markdown.mask_inline("\\`not` `yes` ``no`") == "\\`not   yes       "


def test_left_overs_are_found_by_containment_where_the_pattern_is_literal(spark):
    docs = spark.createDataFrame([("a", "x\nTODO TBD\n待补充 y"), ("b", "none"), ("c", None), ("d", "FIXME")], "path string, text string")
    wanted = [("a", 2, "TODO"), ("a", 3, "待补"), ("d", 1, "FIXME")]
    for pattern in (rules.RESIDUE, f"(?:{rules.RESIDUE})"):
        found = rules.residue(docs, pattern)
        assert sorted((r["path"], r["line_no"], r["message"]) for r in found.collect()) == wanted
        assert ("RLIKE" in plan_of(found)) == (pattern != rules.RESIDUE)
    assert sorted(r["message"] for r in rules.residue(docs, "T.D|F[I]XME").collect()) == ["FIXME", "TOD"]
