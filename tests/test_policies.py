"""Vault policies on small notes."""

from pyspark.sql import functions as F

from foliospark.functions import urls
from foliospark.operators import matching, policies


def notes(spark, **texts):
    return spark.createDataFrame([(k.replace("__", "/") + ".md", v) for k, v in texts.items()], "path string, text string")


def found(frame):
    return sorted((r["rule"], r["path"], r["line_no"]) for r in frame.collect())


def test_report_notes(spark):
    typed = "---\nnote_type: {}\n---\n"
    docs = notes(spark, a__99_内容覆盖审查=typed.format("coverage_audit"), a__source_manifest=typed.format("'source_manifest'"), b__99_内容覆盖审查=typed.format('"coverage_audit"'), c__plain="x", d__my_audit=None, e__typed=typed.format("vault_audit"), f__two="---\nnote_type: vault_audit\nnote_type: x\n---\n")
    assert [p for _, p, _ in found(policies.report_notes(docs))] == ["a/99_内容覆盖审查.md", "b/99_内容覆盖审查.md", "d/my_audit.md", "e/typed.md"]
    assert [p for _, p, _ in found(policies.report_notes(docs, allow_formal=True))] == ["b/99_内容覆盖审查.md", "d/my_audit.md", "e/typed.md"]


def test_bridges(spark):
    docs = notes(spark, a="# 旧入口\n\n本页保留旧路径，正文请读 [[x]]。\n", b="# 旧入口\n" + "长" * 300 + "本页保留旧路径，正文请读 [[x]]。", c="本页保留旧路径，正文请读 [[x]]。", d=None)
    assert {r["path"]: r["b"] for r in docs.select("path", policies.is_bridge(F.col("text")).alias("b")).collect()} == {"a.md": True, "b.md": False, "c.md": False, "d.md": False}


def test_study_links(spark):
    docs = notes(spark, a="## 知识链接\n\n关联阅读：[[a]]\ntext\n关联阅读：[[a]][[b]][[c]][[d]][[e]]\n关联阅读：none", b="plain")
    assert found(policies.study_links(docs)) == [("dense_related_links", "a.md", 5), ("link_dump_section", "a.md", 1), ("poor_link_context", "a.md", 3)]


def test_paper_gaps(spark):
    varied = "".join(chr(0x4E00 + k) for k in range(120))
    full = "\n".join(f"## {t}\n{varied}" for t, *_ in policies.PAPER_TOPICS)
    docs = notes(spark, full=full, short="## 核心方法\n" + "x" * 99, pile="## 实验结论\n" + "实验 " * 300, empty=None, legacy="问题 方法 实验 局限 复现" + "".join(chr(0x4E00 + k % 900) for k in range(2600)))
    got = {}
    for r in policies.paper_gaps(docs).collect():
        got.setdefault(r["path"], []).append(r["topic"])
    assert "full.md" not in got and "legacy.md" not in got
    assert all(len(got[p]) == 5 for p in ("short.md", "pile.md", "empty.md"))


def test_code_blocks(spark):
    text = "x\n<!-- runnable: python -->\n```python\na = 1\n```\ny\n```python\nb =\n```\n```cpp\nint x;\n```\n"
    docs = notes(spark, a=text, b=None)
    rows = policies.code_blocks(docs, "python").orderBy("line_no").collect()
    assert [(r["line_no"], r["code"], r["marked"]) for r in rows] == [(4, "a = 1\n", True), (8, "b =\n", False)]
    assert policies.code_blocks(docs, "cpp").first()["code"] == "int x;\n"
    assert found(policies.python_issues(docs)) == [("python_syntax", "a.md", 8)]


def test_scopes_and_closure(spark):
    changed = spark.createDataFrame([("C/a.md",), ("C/a.md",), ("scripts/x.py",)], "path string")
    scopes = spark.createDataFrame([("notes", r"\.md$"), ("all", ""), ("none", "^zz")], "check string, regex string")
    assert {r["check"]: r["paths"] for r in policies.suggested_checks(changed, scopes).collect()} == {"notes": 1, "all": 2}
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("x", "y"), ("y", "x"), ("n", None)], "src string, dst string")
    assert policies.closure(edges).where("src = 'a'").count() == 3
    assert sorted(r["node"] for r in policies.cycles(edges).collect()) == ["x", "y"]


def test_long_chains_are_one_component(spark):
    edges = spark.range(24).selectExpr("id as left", "id as right").union(spark.range(23).selectExpr("id + 1 as left", "id as right"))
    assert matching.components(edges).select("comp").distinct().count() == 1


def test_request_form(spark):
    rows = spark.createDataFrame([("http://bücher.de:80/ä b?q=é#f",), (None,)], "u string")
    assert [r["r"] for r in rows.select(urls.request_form("u").alias("r")).collect()] == ["http://xn--bcher-kva.de:80/%C3%A4%20b?q=%C3%A9", None]
