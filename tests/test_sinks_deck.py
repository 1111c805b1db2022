"""Frontmatter rewriting, decks, reports and packages: small inputs and round trips."""

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from foliospark.functions import text as T
from foliospark.operators import deck, frontmatter, manifests
from foliospark.sinks import files, packages, reports
from foliospark.sources import packages as read


def notes(spark, **texts):
    return spark.createDataFrame([(k.replace("__", "/") + ".md", v) for k, v in texts.items()], "path string, text string")


def test_frontmatter_rewrite(spark):
    old = '---\ntitle: Mine\ntags: [x, "course/Old"]\nlast_checked: \'2024-01-02\'\naliases:\n  - "A \\"b\\""\nother: 1\n---\n\n\n# Head\nbody\n'
    docs = notes(spark, C__n=old, D__none="plain\n", e=None).withColumn("note_type", F.lit("course_note"))
    sources = spark.createDataFrame([("C/n.md", ["C/a.pdf"])], "path string, sources array<string>")
    rows = {r["path"]: r for r in frontmatter.rewritten(docs, sources).collect()}
    want = '---\ntitle: Mine\nother: 1\n\ncourse: "C"\nnote_type: "course_note"\naliases:\n  - "A \\"b\\""\n  - "Head"\n  - "n"\nsource_files:\n  - "C/a.pdf"\ncoverage: "source_mapped"\nlast_checked: "2024-01-02"\ntags:\n  - "x"\n  - "course/C"\n  - "type/course_note"\n---\n\n# Head\nbody\n'
    assert rows["C/n.md"]["text"] == want and rows["C/n.md"]["changed"]
    assert rows["D/none.md"]["problem"] == "missing last_checked" and not rows["D/none.md"]["changed"]
    assert rows["e.md"]["text"] is None and rows["e.md"]["problem"] is None
    again = frontmatter.rewritten(notes(spark, C__n=want).withColumn("note_type", F.lit("course_note")), sources).first()
    assert not again["changed"]
    dated = {r["path"]: r["text"] for r in frontmatter.rewritten(docs, sources, "2025-05-05").collect()}
    assert dated["D/none.md"].startswith('---\ncourse: "D"\n') and dated["D/none.md"].endswith("---\n\nplain\n")


def test_source_map(spark):
    row = "| `C/a.pdf` | `.pdf` | 1 | x | [[C/n#h]] [[C/m.md]] | s | e | l | d |"
    found = frontmatter.source_map(manifests.records(notes(spark, m="\n".join([manifests.HEADER, row])))).orderBy("path").collect()
    assert [(r["path"], r["sources"]) for r in found] == [("C/m.md", ["C/a.pdf"]), ("C/n.md", ["C/a.pdf"])]


NOTE = "---\na: b\n---\n# Title\n## 方法 method\n[x](http://a.b/c) [[w]] ![[p.png]] ![[d.zip]]\n$$\ny\n$$\n| a | b |\n| --- | --- |\n## 结果\n"


def test_summaries_and_backlog(spark):
    found = deck.summaries(notes(spark, n=NOTE, empty=None))
    rows = {r["path"]: r for r in found.collect()}
    r = rows["n.md"]
    assert (r["title"], len(r["headings"]), r["wiki_links"], r["images"], r["attachments"], r["tables"], r["math_blocks"]) == ("Title", 3, ["w"], 1, 1, 1, 1)
    assert rows["empty.md"]["title"] == "empty" and rows["empty.md"]["words"] == 0
    items = [(x["title"], x["role"], x["proof"]) for x in deck.backlog(found).orderBy("pos").collect()]
    assert items == [("方法 method", "method/mechanism", "mechanism diagram"), ("结果", "evidence/results", "result/comparison table")]
    assert {x["path"]: x["gaps"] for x in deck.evidence(found).collect()}["n.md"] == ["limitations not explicit"]
    assert deck.deck_mode(found).first()["mode"] == "paper-reading"
    assert deck.language(found).first()["language"] == "en"


def test_mode_first_of_equals(spark):
    found = deck.summaries(notes(spark, a="# lecture", b="# thesis"))
    assert deck.deck_mode(found).first()["mode"] == "teaching"


BRIEF = "# Deck\n- Maximum total slide count: 5\n## Draft Slide Backlog\n- [limitations] Turn `L` into. Proof object: own proof.\n## Suggested Scientific Deck Spine\n1. Method overview\n2. Risk\n3. Closing\n4. More\n## End\n9. no\n"


def test_briefs(spark):
    briefs = spark.createDataFrame([("d", BRIEF), ("e", "- Maximum total slide count: 1"), ("f", None)], "deck string, text string")
    slides = deck.spine(briefs)
    got = [(r["title"], r["role"], r["proof"]) for r in slides.orderBy("pos").collect()]
    assert got == [("Method overview", "method/mechanism", deck.DEFAULT_PROOF), ("Risk", "limitations", "own proof"), ("Closing", "claim", deck.DEFAULT_PROOF), ("More", "claim", deck.DEFAULT_PROOF)]
    assert {r["deck"]: (r["total"], r["valid"]) for r in deck.total_slides(briefs).collect()} == {"d": (5, True), "e": (1, False), "f": (None, True)}
    for most, want in [(None, ["Method overview", "Risk", "Closing", "More", "Appendix index"]), (1, ["Method overview"]), (2, ["Method overview", "Risk"]), (4, ["Method overview", "Closing", "Risk", "Appendix index"])]:
        assert [r["title"] for r in deck.within_budget(slides, most).orderBy("pos").collect()] == want, most
    titles = spark.createDataFrame([("d", 1, "ok"), ("d", 2, " "), ("d", 3, "a\nb"), ("d", 4, "x" * 181), ("d", 5, "宽" * 70)], "deck string, pos int, title string")
    found = deck.title_issues(titles.withColumn("units", T.title_units("title"))).orderBy("pos").collect()
    assert [(r["pos"], r["issue"]) for r in found] == [(2, "empty"), (3, "several lines"), (4, "too long"), (5, "too wide")]


def test_deck_round_trip(spark):
    slides = spark.createDataFrame([("d", 2, "Second & last", "claim", "p"), ("d", 1, "First <one>", "claim", None)], "deck string, pos int, title string, role string, proof string")
    made = packages.decks(slides)
    texts = read.slide_texts(read.slide_shapes(made)).orderBy("slide_no").collect()
    assert [(r["slide_no"], r["title"]) for r in texts] == [(1, "d"), (2, "First <one>"), (3, "Second & last")]
    assert read.members(made).where("problem is not null").isEmpty()


def test_archives_are_fixed_and_whole(spark):
    rows = spark.createDataFrame([("p", "b.md", b"two"), ("p", "a.md", b"one"), ("p", "c.md", None)], "package string, name string, content binary")
    one, two = packages.archives(rows).first(), packages.archives(rows.orderBy("name")).first()
    assert one["path"] == "p.zip" and one["content"] == two["content"]
    with zipfile.ZipFile(io.BytesIO(one["content"])) as z:
        manifest = json.loads(z.read(packages.MANIFEST))
    assert [f["path"] for f in manifest["files"]] == ["a.md", "b.md", "c.md"]
    records = spark.createDataFrame([(f["path"], f["sha256"], f["size"]) for f in manifest["files"]], "path string, sha256 string, size long")
    assert read.content_digest(records).first()["content_digest"] == manifest["content_digest"]


def test_publish(spark, tmp_path):
    rows = spark.createDataFrame([("x/a.md", "one", None), ("../b.md", "two", None), ("c.md", None, None)], "path string, text string, expected string")
    states = lambda r, **k: {x["path"]: x["state"] for x in files.publish(r, str(tmp_path), **k).collect()}
    assert states(rows) == {"x/a.md": "written", "../b.md": "refused", "c.md": "empty"}
    assert states(rows)["x/a.md"] == "unchanged" and (tmp_path / "x/a.md").read_text() == "one"
    changed = spark.createDataFrame([("x/a.md", "new", "0" * 64)], rows.schema)
    assert states(changed) == {"x/a.md": "conflict"} and states(changed.drop("expected"), create_only=True) == {"x/a.md": "exists"}
    assert states(changed.drop("expected")) == {"x/a.md": "written"} and [p.name for p in (tmp_path / "x").iterdir()] == ["a.md"]


def test_reports(spark):
    counts = "scope string, files long, markdown_links long, wiki_links long, external_links long, unique_targets long, total_links long"
    per_file = spark.createDataFrame([("b|.md", 1, 1, 2, 3, 4, 6), ("a.md", 1, 0, 0, 0, 0, 0)], counts)
    total = spark.createDataFrame([("root", 2, 1, 2, 3, 4, 6)], counts)
    text = reports.link_inventory(per_file, total, total).first()["text"]
    assert "- Files: 2\n- Total links: 6\n" in text and text.endswith("| a.md | 0 | 0 | 0 | 0 | 0 |\n| b\\|.md | 1 | 2 | 3 | 4 | 6 |\n")
    assert json.loads(reports.link_inventory_json(per_file).where("scope = 'a.md'").first()["json"])["counts"]["total_links"] == 0
    pages = spark.createDataFrame([(0, "pdf", "T|x", "o", "u", "c", "", "login_required", "AUTH", 401, "e", "d")], "pos int, kind string, title string, original_source string, url string, canonical_url string, final_url string, access_status string, access_class string, http_status int, error string, description string")
    links = spark.createDataFrame([(0, 0, "video", "v", "lu", "s", False), (0, 1, "web_page", "h", "hu", "s", True)], "page_pos int, pos int, kind string, title string, url string, source string, provenance_only boolean")
    text = reports.web_manifest(pages, links).first()["text"]
    rows = manifests.section_rows(spark.createDataFrame([("m", text)], "path string, text string")).orderBy("line_no").collect()
    assert [(r["section"], r["values"].get("Kind")) for r in rows] == [("Pages", "pdf"), ("Access Evidence", None), ("Learning Resources", "pdf"), ("Learning Resources", "video"), ("Provenance Helpers", "web_page")]
    assert rows[0]["values"]["Title"] == "T|x" and rows[0]["values"]["Status"] == "login required" and rows[1]["values"]["Final URL"] == "c"


def test_scaffolds(spark):
    sources = spark.createDataFrame([("C", "L1", "C/L1.pdf"), ("C", "L1", "C/x/L1.pdf"), ("C", 'a/"b"', "C/q.pdf")], "course string, stem string, root_relative string")
    made = reports.skeleton_notes(sources)
    assert made.select("path").distinct().count() == 3 and "C/L1.md" in [r["path"] for r in made.collect()]
    text = reports.learning_map(made.select("path", F.lit("t").alias("title"))).first()["text"]
    assert text.startswith("# Learning map\n\n## C\n\n- [[C/L1") and text.count("[[") == 3


@pytest.mark.parametrize(("line", "math", "want"), [("x \\\\alpha  , y​", False, "x \\alpha, y"), ("a ≤ b", True, "a \\le b"), ("plain α", True, "plain α"), ("\\ frac ", False, "\\frac"), ("ｗｉｄｅ", False, "wide")])
def test_slide_lines(spark, line, math, want):
    assert spark.createDataFrame([(line,)], "t string").select(T.slide_line(F.col("t"), math).alias("t")).first()["t"] == want


def test_compact_slides(spark):
    assert spark.createDataFrame([("a\n\n\n\n\nb\n \n",)], "t string").select(T.compact_slide(F.col("t")).alias("t")).first()["t"] == "a\n\n\nb\n"
