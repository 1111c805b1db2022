"""Operators on small literal tables."""

import zipfile

from pyspark.sql import functions as F

from foliospark.operators import coverage, frames, links, matching, rules, state
from foliospark.sources import packages, vault
from foliospark.streaming import incremental


def notes(spark, **texts):
    return spark.createDataFrame(list(texts.items()), "path string, text string")


def test_frontmatter(spark):
    docs = notes(spark, a="---\ncourse: X\nnote_type: \"template\"\ncourse: 'Y'\ntags:\n  - one\n  - two\n---\nbody", b="none")
    row = frames.frontmatter(docs).collect()
    assert len(row) == 1 and row[0]["keys"]["course"] == "Y" and row[0]["keys"]["note_type"] == "template"
    assert row[0]["lists"][0]["value"] == ["one", "two"]
    found = rules.invalid_frontmatter(frames.frontmatter(docs), F.lit("2024-01-01").cast("date")).collect()
    assert [r["message"] for r in found] == ["missing: source_files,coverage,last_checked"]


def test_paragraphs_and_sections(spark):
    docs = notes(spark, a="# T\nThis is a paragraph that is long\nenough to count.\n```\ncode that is long enough to count\n```\n- a list item, long enough to count\n## S\nbody\n## U\n")
    assert [r["paragraph"] for r in frames.paragraphs(docs).collect()] == ["This is a paragraph that is long enough to count."]
    assert [r["item"] for r in frames.list_items(docs).collect()] == ["a list item, long enough to count"]
    assert [(r["title"], r["body"].strip()) for r in frames.sections(docs).orderBy("section").collect()][1:] == [("S", "body"), ("U", "")]
    assert [r["formula"] for r in frames.formulas(notes(spark, a="x $$ a $$ y $$ b")).collect()] == [" a "]


def test_empty_and_null_tables(spark):
    empty = spark.createDataFrame([], "path string, text string")
    null = spark.createDataFrame([("a", None), (None, "x")], "path string, text string")
    for docs in (empty, null):
        for make in (frames.lines, frames.paragraphs, frames.sentences, frames.headings, frames.list_items, links.wikilinks, rules.odd_math, rules.private_data, rules.table_issues):
            make(docs).collect()


def test_resolution_tiers(spark):
    docs = notes(spark, **{"a.md": "[[b]] [[x/b]] [[/b]] [[c#h|see]] [[]] ![[b]]", "b.md": "[[b]]", "x/b.md": "", "x/d.md": "[[b]] [[b.md]]", "y/c.md": "", "z/c.md": ""})
    found = {(r["path"], r["raw"]): (r["status"], r["hit"]) for r in links.resolve_wikilinks(links.wikilinks(docs), docs).collect()}
    assert found[("a.md", "b")] == ("ambiguous", None)  # the vault-wide name fits two notes
    assert found[("a.md", "x/b")] == ("ok", "x/b.md")
    assert found[("a.md", "/b")] == ("ok", "b.md")
    assert found[("a.md", "c#h|see")] == ("ambiguous", None)
    assert found[("x/d.md", "b")] == ("ok", "x/b.md")
    assert found[("x/d.md", "b.md")] == ("ok", "x/b.md")


def test_matching_is_maximum(spark):
    edges = spark.createDataFrame([(1, 1), (1, 2), (2, 1), (3, 2), (3, 3), (4, 3), (5, 9)], "left long, right long")
    out = {r["left"]: r["right"] for r in matching.match(edges).collect()}
    used = [v for v in out.values() if v is not None]
    assert len(out) == 5 and len(used) == len(set(used)) == 4


def test_state(spark):
    rows = spark.createDataFrame([("a", k, t) for k, t in enumerate(["x", "", "", "", "x", "x"])], "path string, line_no int, text string")
    assert state.compact_blanks(rows, "path", "line_no", "text").count() == 5
    assert [r["text"] for r in state.without_repeats(rows, "path", "line_no", "text").orderBy("line_no").collect()] == ["x", "", "x"]
    assert [r["p"] for r in state.previous_filled(rows, "path", "line_no", "text", "p").orderBy("line_no").collect()] == [None, "x", "x", "x", "x", "x"]
    ranges = spark.createDataFrame([("a", 1, 9), ("a", 2, 3), ("a", 8, 12), ("b", 2, 3)], "path string, first int, last int")
    assert state.outermost(ranges).count() == 3


def test_coverage(spark):
    old, new = (spark.createDataFrame(x, "path string, sha256 string") for x in ([("a", "1"), ("b", "1"), ("c", "1")], [("a", "1"), ("b", "2"), ("d", "1")]))
    assert {r["path"]: r["state"] for r in coverage.tree_diff(old, new).collect()} == {"a": "unchanged", "b": "changed", "c": "stale", "d": "added"}
    entries = spark.createDataFrame([("C1", "C1/L1.pdf", "L1.pdf", "L1.pdf", "L1"), ("C2", "C2/L1.pdf", "L1.pdf", "L1.pdf", "L1"), ("C1", "C1/L2.pdf", "L2.pdf", "L2.pdf", "L2")], "course string, root_relative string, course_relative string, name string, stem string")
    refs = spark.createDataFrame([("L1.pdf",), ("l2.pdf",), ("C2/L1.pdf",), ("none",)], "ref string")
    assert {r["ref"]: r["status"] for r in coverage.matched_references(refs, entries).collect()} == {"L1.pdf": "ambiguous", "l2.pdf": "ok", "C2/L1.pdf": "ok", "none": "unknown"}
    assert coverage.adjacent_parts(entries).count() == 2


def test_vault_scan_and_packages(spark, tmp_path):
    for name in ("a.md", "sub/b.md", "scripts/c.md", "AGENT.md"):
        (tmp_path / "v" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "v" / name).write_bytes(b"caf\xe9")
    found = vault.organizer_notes(spark, f"file://{tmp_path}/v").collect()
    assert sorted(r["path"] for r in found) == ["a.md", "sub/b.md"] and found[0]["text"] == "caf�"
    slide = '<p:sld xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main">{}</p:sld>'
    shape = '<p:sp><p:spPr><a:xfrm><a:off x="{}" y="{}"/></a:xfrm></p:spPr><p:txBody><a:p><a:r><a:t>{}</a:t></a:r></a:p></p:txBody></p:sp>'
    (tmp_path / "s").mkdir()
    with zipfile.ZipFile(tmp_path / "s/deck.pptx", "w") as z:
        z.writestr("ppt/slides/slide1.xml", slide.format(shape.format(0, 50, "low") + shape.format(0, 10, "top") + shape.format(5, 60, "low")))
    files = vault.files(spark, f"file://{tmp_path}/s")
    texts = packages.slide_texts(packages.slide_shapes(files)).collect()
    assert [(r["text"], r["title"]) for r in texts] == [("top\nlow", "top")]
    assert packages.members(files).first()["problem"] is None


def test_incremental(spark, tmp_path):
    notes(spark, **{"a.md": "TODO", "b.md": "ok"}).write.parquet(f"{tmp_path}/in")
    for _ in range(2):  # the second run finds nothing new
        incremental.run_rules(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/ckpt", {"residue": rules.residue}).awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 1


def test_structure_rules_reach_every_document(spark):
    from conftest import DATA

    from foliospark import catalog

    found = catalog.queries()["document_structure"](spark, DATA).groupBy("path").agg(F.count("*").alias("n")).collect()
    per = {r["path"]: r["n"] for r in found}
    ids = [r["doc_id"] for r in spark.read.parquet(f"{DATA}/documents.parquet").where("text is not null").select("doc_id").collect()]
    assert {p for p in per if p not in "abcd"} >= {str(i) for i in ids if i % 5 in (1, 2, 4)}
    assert {k: per.get(k) for k in "abcd"} == {"a": 4, "b": 4, "c": 1, "d": 1}
