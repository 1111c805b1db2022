"""The manifest contract, its closure and the rewriting of manifests."""

from pyspark.sql import functions as F

from foliospark.operators import manifests as M

GOOD = "| `C/L1.pdf` | `.pdf` | 12 | pdftotext | [[C/L1]] | 已映射：正文 | 例题见笔记 | OCR 未做，第 3-5 页空白 | 2024-01-01 |"


def notes(spark, **texts):
    return spark.createDataFrame([(k.replace("__", "/") + ".md", v) for k, v in texts.items()], "path string, text string")


def found(frame):
    return sorted((r["rule"], r["line_no"]) for r in frame.collect())


def test_records_and_contract(spark):
    bad = "| x | .pdf | 0 |  | none | 完整覆盖 | - |  | 2030-01-01 |"
    docs = notes(spark, C__source_manifest="\n".join(["# M", M.HEADER, M.RULE, GOOD, GOOD, bad, "| a |", "", GOOD]))
    rows = M.records(docs)
    assert [(r["line_no"], r["source"], r["count"]) for r in rows.orderBy("line_no").collect()] == [(4, "C/L1.pdf", 12), (5, "C/L1.pdf", 12), (6, "x", None)]
    got = found(M.record_issues(rows, F.lit("2025-01-01").cast("date")))
    assert ("SOURCE_DUPLICATE", 5) in got and not any(n == 4 for _, n in got)
    assert {r for r, n in got if n == 6} == {"SOURCE_IDENTITY_INVALID", "SOURCE_TYPE_INVALID", "SOURCE_COUNT_INVALID", "EXTRACTION_METHOD_MISSING", "MAPPING_LINK_MISSING", "COVERAGE_STATE_INVALID", "EXAMPLE_STATE_INVALID", "LIMITATIONS_MISSING", "CHECKED_DATE_INVALID"}
    assert found(M.table_issues(docs)) == [("MANIFEST_COLUMNS_INVALID", 7)]


def test_headers_and_web_rows(spark):
    docs = notes(spark, a="no table", b=M.HEADER_START + " x |", c=M.WEB_HEADER + "\n|---|---|---|---|---|\n| s | ftp://x | k | a |  |\n| s | https://x | k |")
    assert found(M.table_issues(docs)) == [("MANIFEST_HEADER_INVALID", 0), ("MANIFEST_HEADER_INVALID", 0), ("MANIFEST_ROWS_MISSING", 0), ("OTHER_CONTRACT_ISSUE", 3), ("WEB_SOURCE_COLUMNS_INVALID", 4), ("WEB_SOURCE_URL_INVALID", 3)]


def test_links_and_closure(spark):
    docs = notes(spark, C__source_manifest="\n".join([M.HEADER, M.RULE, GOOD]), C__L1="", C__d__L2="", D__x="")
    rows = M.records(docs)
    assert found(M.mapping_issues(rows, docs)) == []
    assert found(M.mapping_issues(rows, docs.where("path <> 'C/L1.md'"))) == [("MAPPING_LINK_BROKEN", 3)]
    declared = spark.createDataFrame([("C/L1.md", "C/L1.pdf"), ("C/d/L2.md", "C/L1.pdf"), ("C/d/L2.md", "C/none.pdf"), ("D/x.md", "C/L1.pdf")], "path string, source string")
    got = {(r["rule"], r["path"]) for r in M.closure_issues(declared, rows, docs.where("path like '%source_manifest.md'")).collect()}
    assert got == {("SOURCE_NOTE_MAPPING_MISSING", "C/d/L2.md"), ("SOURCE_NOT_IN_APPLICABLE_MANIFEST", "C/d/L2.md"), ("APPLICABLE_MANIFEST_MISSING", "D/x.md")}
    types = spark.createDataFrame([("C/L1.md", "vault_audit")], "path string, note_type string")
    assert found(M.contract_issues(docs, types)) == [("FORBIDDEN_AUDIT_NOTE_TYPE", 0), ("MANIFEST_NOTE_TYPE_INVALID", 0)]


def test_units_and_extractability(spark):
    texts = spark.createDataFrame([("第 3-5 页空白; Tesseract 5.5.3, pages 9, 11",), ("2024-01-01",), ("空白页：7",), (None,)], "t string")
    assert [r["u"] for r in texts.select(M.mentioned_units(F.col("t")).alias("u")).collect()] == [[3, 4, 5, 9, 11], [], [7], None]
    rows = M.records(notes(spark, a="\n".join([M.HEADER, M.RULE, GOOD])))
    seen = spark.createDataFrame([("C/L1.pdf", 11, [4, 6], True)], "source string, observed_units long, blank_units array<bigint>, has_text boolean")
    assert {(r["rule"], r["message"]) for r in M.extractability_issues(rows, seen).collect()} == {("COUNT_MISMATCH", "12 for 11"), ("BLANK_UNITS_UNDECLARED", "6")}


def test_sections(spark):
    docs = notes(spark, a="## Pages\n| Kind | Error |\n|---|---|\n| a \\| b | - |\n| x |\n## Other\n| K |\n| --- | --- |\n| v |\n")
    rows = M.section_rows(docs).orderBy("line_no").collect()
    assert [(r["section"], r["values"]) for r in rows] == [("Pages", {"Kind": "a | b", "Error": "-"}), ("Other", {"K": "v"})]
    states = spark.createDataFrame([({"Access": "Login_Required"},), ({"Error": "N/A"},), ({"Error": "boom"},)], "v map<string,string>")
    assert [r["i"] for r in states.select(M.inaccessible(F.col("v")).alias("i")).collect()] == [True, False, True]


def test_rewrites(spark):
    docs = notes(spark, a="x\n| 源文件 | y |\n|---|---|\n|`q`|\n| `C/a.pdf`|b|c|d|e|f|g|h|i |\nz\n|---|---|\n", b="| `a` |b|c|d|e|f |\n")
    rows = {r["path"]: r for r in M.normalized(docs).collect()}
    assert rows["a.md"]["text"] == f"x\n{M.HEADER}\n{M.RULE}\n|`q`|\n| `C/a.pdf` | b | c | d | e | f | g | h | i |\nz\n|---|---|\n"
    assert rows["b.md"]["unsafe"] and rows["b.md"]["text"] == "| `a` |b|c|d|e|f |\n"
    cut = notes(spark, a="# T\ntext\n\n## Gone\nx\n### sub\n\n## Kept\ny\n", b="## Gone\nx", c="## Gone too\nx\n")
    got = {r["path"]: (r["text"], r["changed"]) for r in M.without_section(cut, "## Gone").collect()}
    assert got == {"a.md": ("# T\ntext\n\n## Kept\ny\n", True), "b.md": ("", True), "c.md": ("## Gone too\nx\n", False)}


def test_empty_and_null(spark):
    for rows in ([], [("a.md", None), (None, ""), ("a.md", "")]):
        docs = spark.createDataFrame(rows, "path string, text string")
        for make in (M.records, M.web_rows, M.section_rows, M.normalized, M.table_issues):
            make(docs).collect()
