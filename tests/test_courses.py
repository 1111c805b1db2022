"""Course, evidence, guidance and web rules on awkward notes, and the rules that were once wrong."""

import time

import pytest
from pyspark.sql import functions as F

from foliospark.functions import markdown, urls
from foliospark.operators import claims, courses, coverage, evidence, frames, guidance, links, policies, rules
from foliospark.sources import web

AWKWARD = [("c/a.md", None), ("c/b.md", ""), ("c/c.md", " \n\t \n"), ("c/d.md", "x" * 50_000), ("c/d.md", "x" * 50_000), ("top.md", "plain")]


def notes(spark, rows):
    return spark.createDataFrame([*rows], "path string, text string")


def hits(found, *columns):
    return sorted(tuple(r[c] for c in columns) for r in found.collect())


RULES = {
    "courses": courses.course_issues,
    "audit": courses.audit_residue,
    "formulas": courses.formula_defects,
    "web": courses.web_collection_issues,
    "routes": courses.route_issues,
    "directions": courses.direction_values,
    "references": evidence.visible_references,
    "blocks": evidence.evidence_blocks,
    "examples": evidence.example_evidence,
    "guidance": guidance.guidance_issues,
    "boundaries": guidance.boundary_issues,
    "workspace": guidance.workspace_issues,
    "metadata": guidance.metadata_issues,
    "empty": rules.empty_notes,
    "claims": lambda d: claims.audit(claims.prose_lines(d)),
    "headings": lambda d: frames.headings(d, underlined=True),
    "links": links.markdown_links,
}


@pytest.mark.parametrize("name", sorted(RULES))
def test_nulls_blanks_repeats_and_empty_tables_pass(spark, name):
    table = notes(spark, AWKWARD)
    for rows in (table, table.limit(0), table.withColumns({"line": F.lit(1), "rule": F.lit("x"), "n": F.lit(2)})):
        RULES[name](rows).collect()


def test_white_space_of_any_kind_is_empty(spark):
    assert hits(rules.empty_notes(notes(spark, AWKWARD)), "path") == [("c/b.md",), ("c/c.md",)]


def test_overviews_and_review_pages(spark):
    rows = [
        ("m/00_课程总览.md", "[[知识点详细版_含公式|x]] `[[知识点精简复习版_含公式]]`"), ("m/知识点详细版_含公式.md", "a\nb"), ("m/知识点精简复习版_含公式.md", "a"), ("m/sub/00_学习地图.md", "x"),
        ("n/01_章.md", "x"), ("n/考试复习.md", "x"), ("o/00_我的总览.md", "[r](%E8%80%83%E8%AF%95%E5%A4%8D%E4%B9%A0.md)"), ("o/考试复习.md", "x"),
    ]
    found = hits(courses.course_issues(notes(spark, rows), strict_depth=False), "rule", "path", "message")
    assert ("missing_review_link", "m/00_课程总览.md", courses.CONCISE) in found and ("missing_review_link", "m/00_课程总览.md", courses.DETAILED) not in found
    assert ("missing_overview", "n", "00_课程总览.md") in found
    exam = hits(courses.course_issues(notes(spark, rows), strict_depth=False, allow_exam=True), "rule", "path", "message")
    assert not [x for x in exam if x[1].startswith("o")] and ("missing_review_page", "n", courses.DETAILED) not in exam


def test_audit_residue_spares_exempt_notes_and_code(spark):
    rows = [("agent/x.md", "UNVERIFIED"), ("a/source_manifest.md", "UNVERIFIED"), ("a/b.md", "---\nx: 1\n---\nok\nUNVERIFIED"), ("a/c.md", "```\nUNVERIFIED\n```"), ("a/99_内容覆盖审查.md", "x"), ("agent/99_内容覆盖审查.md", "x")]
    assert hits(courses.audit_residue(notes(spark, rows)), "rule", "path", "line_no") == [("audit_residue", "a/b.md", 2), ("legacy_audit", "a/99_内容覆盖审查.md", 1)]


def test_routes_are_rejected_before_or_after(spark):
    rows = [("a", "路线：RAG算法岗"), ("b", "方向：不设置 RAG算法岗"), ("c", "RAG算法岗 路线已删除"), ("d", "RAG算法岗 路线已删除，入口 RAG算法岗"), ("e", "RAG算法岗"), ("f", "```\n路线 RAG算法岗\n```")]
    assert hits(courses.route_issues(notes(spark, rows)), "path") == [("a",), ("d",)]


def test_page_evidence_needs_one_block(spark):
    entries = spark.createDataFrame([("s/a b.pdf",), ("s/c.pdf",)], "root_relative string")
    rows = [("one", "`s/c.pdf` page 3"), ("two", "`s/c.pdf`\n\npage 3"), ("three", "| s/a b.pdf | p. 3 |"), ("four", "xs/c.pdf page 3"), ("five", "- s/c.pdf\n- page 3"), ("six", "s/c.pdf\nslide 4")]
    assert hits(evidence.page_evidence(notes(spark, rows), entries), "path", "source") == [("one", "s/c.pdf"), ("six", "s/c.pdf"), ("three", "s/a b.pdf")]


def test_paper_sources(spark):
    entries = spark.createDataFrame([("s/a.pdf",), ("s/b.pdf",), ("t/b.pdf",), ("u/q.pdf",)], "root_relative string")
    front = "---\nnote_type: paper_note\nsource_files:\n  - s/a.pdf\n---\n"
    rows = [("p", front + "`s/a.pdf` `s/b.pdf` `../x.pdf` `u/q.pdf` `https://x.example/y.pdf`"), ("q", "---\nnote_type: paper_note\n---\n")]
    assert hits(evidence.paper_sources(notes(spark, rows), entries), "rule", "message") == [
        ("paper_source_ambiguous_basename", "b.pdf"), ("paper_source_missing", "no source_files"), ("paper_source_not_declared", "u/q.pdf"), ("paper_source_outside_root", "../x.pdf")
    ]


def test_sign_in_pages_need_a_second_sign(spark):
    pages = [(1, "http://x/a", "<title>Docs</title>you can log in later"), (2, "http://x/a", "<title>Log in</title>log in"), (3, "http://x/a", "login Password"), (4, "http://x/login", "please login"), (5, "http://x/a", None), (6, "http://x/login", "<title>Docs</title>" + "y" * 30_000 + "login")]
    found = web.access_class(spark.createDataFrame(pages, "page_id int, url string, html string")).where("login_page")
    assert hits(found, "page_id") == [(2,), (3,), (4,)]


def test_status_classes(spark):
    rows = [(200, "http://A.b/x", "http://a.b/x#f", None, "OK"), (200, "http://a.b/x", "http://a.b/y", None, "REDIRECT"), (304, None, None, None, "MANUAL_REVIEW"), (403, None, None, "nginx", "MANUAL_REVIEW"), (403, None, None, "Robots", "ROBOTS_BLOCKED"), (410, None, None, None, "DOMAIN_GONE"), (401, None, None, None, "AUTH_REQUIRED"), (None, None, None, None, "MANUAL_REVIEW")]
    table = spark.createDataFrame(rows, "code int, url string, final string, robots string, wanted string")
    assert table.where(urls.status_class(F.col("code"), F.col("url"), F.col("final"), F.col("robots")) != F.col("wanted")).count() == 0


def test_claims_count_contexts_in_place_and_spare_exempt_notes(spark):
    rows = [("a.md", "系统应`xxxxxxxx`保证所有请求成功", None), ("99_x.md", "系统保证所有请求成功", None), ("b.md", "系统保证所有请求成功", "template"), ("c.md", "见 ![[完全解决.png]] 与 [[x/完全解决#节|别名]]", None)]
    found = claims.audit(claims.prose_lines(spark.createDataFrame(rows, "path string, text string, note_type string")))
    assert hits(found, "path", "term") == [("a.md", "保证")]


def test_visible_lines_keep_places():
    assert markdown.visible_line("a `b` ![[c]] d") == "a     " + " " * 7 + "d"
    assert markdown.visible_line("[[x/y#z]] [[p|q]] `` ` [[n]]") == " y#z   q  `` `  n "


def test_code_spans_are_found_in_one_pass():
    text = " ".join("`" * k + "x" for k in range(1, 2500))
    began = time.perf_counter()
    assert markdown.mask_inline(text) == text
    assert time.perf_counter() - began < 5
    assert markdown.mask_inline("a `b ``c`` d` e ``f") == "a             e ``f"


def test_patterns_in_batches(spark, monkeypatch):
    monkeypatch.setattr(rules, "PATTERN_BATCH", 2)
    patterns = spark.createDataFrame([(k, f"w{k}$") for k in range(5)] + [(9, "w")], "id int, regex string")
    found = rules.custom_residue(notes(spark, [("a", "w4\nnone\nw0 w3"), ("b", "w7"), ("c", None)]), patterns)
    assert hits(found, "path", "line_no", "message") == [("a", 1, "4"), ("a", 3, "3"), ("b", 1, "9")]
    assert rules.custom_residue(notes(spark, [("a", "x")]), patterns.limit(0)).count() == 0


def test_closure_of_cycles_and_chains(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (7, 8), (8, 8), (None, 1)], "src int, dst int")
    assert hits(policies.closure(edges), "src", "dst") == sorted([(a, b) for a in (1, 2, 3) for b in (1, 2, 3, 4)] + [(7, 8), (8, 8)])
    assert hits(policies.cycles(edges), "node") == [(1,), (2,), (3,), (8,)]
    assert policies.closure(edges.limit(0)).count() == 0


def test_reach_keeps_the_least_steps_and_a_small_plan(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(8)] + [(0, 3), (5, 0)], "src int, dst int")
    found = links.reach(edges, spark.createDataFrame([(0,)], "src int"), 6)
    assert hits(found, "dst", "steps") == [(0, 0), (1, 1), (2, 2), (3, 1), (4, 2), (5, 3), (6, 4), (7, 5), (8, 6)]
    assert len(found._jdf.queryExecution().optimizedPlan().toString().splitlines()) < 60


def test_passages_of_every_length(spark):
    docs = spark.createDataFrame([(1, "the quick brown fox jumps over it"), (2, "a quick brown"), (3, None), (4, "")], "doc_id int, text string")
    passages = spark.createDataFrame([(1, "uick brown fox jumps ov"), (2, "quick brown"), (3, "k b"), (4, "fox"), (5, None), (6, ""), (7, "he quick bro"), (8, "the quick brown fox jumps over it")], "item_id int, text string")
    assert hits(coverage.contained(passages, docs), "item_id", "doc_id") == [(1, 1), (2, 1), (2, 2), (3, 1), (3, 2), (4, 1), (7, 1), (8, 1)]
    assert coverage.contained(passages.limit(0), docs).count() == 0


def test_anchors_of_underlined_and_named_headings(spark):
    text = "---\n# no: 1\n---\nTitle ﬁ\n=====\n## A b {#Own-Id}\ntext\n## A b ##\n```\n# code\n```\n"
    keys = {k for _, k in hits(links.anchors(frames.headings(notes(spark, [("n", text)]), underlined=True)), "path", "anchor_key")}
    assert keys == {"title ﬁ", "title-fi", "a b", "a-b", "a-b-1", "own-id"}


def test_yaml_mappings():
    assert guidance.yaml_pairs("a:\n  b: 'x y'\n  c: true\n# n\nd: 3") == [("a.b", "x y"), ("a.c", "true"), ("d", "3")]
    for bad in ("- a", "a: 1\na: 2", "\ta: 1", "a: 'x"):
        with pytest.raises(ValueError):
            guidance.yaml_pairs(bad)


def test_installs_leave_or_remove_stale_files(spark):
    new, old = (spark.createDataFrame(x, "path string, sha256 string") for x in ([("a", "1"), ("b", "2")], [("b", "3"), ("c", "4")]))
    assert hits(guidance.install_plan(new, old), "path", "action") == [("a", "copy"), ("b", "replace"), ("c", "leave")]
    assert hits(guidance.install_plan(new, old, prune=True), "path", "action")[2] == ("c", "remove")
