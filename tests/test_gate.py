"""The core gate on notes of each kind, on nulls, repeats and long texts, and on nothing."""

import pytest
from pyspark.sql import functions as F

from foliospark.operators import gate, links

TICKS = "`" * 3
CASES = {
    "fine.md": ("# A\n\nwords", None, []),
    "null.md": (None, None, [("empty_file", 0)]),
    "blank.md": (" \n\t　", None, [("empty_file", 0)]),
    "marks.md": ("x\n<<<<<<< a", None, [("conflict_marker", 0)]),
    "ends.md": ("=======\n>>>>>>> b", None, [("conflict_marker", 0)]),
    "title.md": ("=======\nwords", None, []),
    "fence.md": (f"a\n{TICKS}\nTODO", None, [("unbalanced_fence", 0)]),
    "math.md": ("$$ a $$ `$$` $$", None, [("unbalanced_math", 0)]),
    "bell.md": ("a\x07\r\nb\tc", None, [("control_character", 0)]),
    "residue.md": (f"TODO and TBD\r\n`FIXME`\n    TODO\n{TICKS}\nTODO\n{TICKS}\nand so on...", None, [("residue", 1), ("residue", 1), ("residue", 7)]),
    "agent/plan.md": ("TODO", None, []),
    "AGENT.md": ("TODO", None, []),
    "vault/agent/plan.md": ("TODO", None, [("residue", 1)]),
    "table.md": ("| a |\n| --- | 解析：x |\n|-- | 解析：y |\n| -- | 解析：z |\n解析：", None, [("table_separator", 2), ("table_separator", 4)]),
    "python.md": (f"a\n{TICKS}python\nx = 1\ny = = 2\n{TICKS}", None, [("invalid_python", 4)]),
    "sound.md": (f"{TICKS}python x\nx = 1\n{TICKS}", None, []),
    "short.md": ("words", "course_note", [("shallow_note", 0)]),
    "long.md": ("w" * 600, "course_note", []),
    "front.md": ("---\nk: " + "v" * 700 + "\n---\n" + "w " * 599, "course_note", [("shallow_note", 0)]),
    "code.md": (f"{TICKS}\n" + "w" * 900 + f"\n{TICKS}\n", "course_note", [("shallow_note", 0)]),
    "other.md": ("words", "unknown_kind", []),
    "very_long.md": ("word " * 300_000 + "TODO", None, [("residue", 1)]),
}


def gated(spark, rows, columns="path string, text string, note_type string"):
    notes = spark.createDataFrame(rows, columns)
    return notes, links.resolve_wikilinks(links.wikilinks(notes), notes)


def test_each_rule(spark):
    notes, resolved = gated(spark, [(path, text, kind) for path, (text, kind, _) in CASES.items()])
    found = {}
    for row in gate.core_gate(notes, resolved).collect():
        found.setdefault(row["path"], []).append((row["rule"], row["line_no"]))
    assert {path: sorted(found.get(path, [])) for path in CASES} == {path: sorted(wanted) for path, (_, _, wanted) in CASES.items()}


def test_messages_and_links(spark):
    rows = [("a/x.md", "[[x]] [[y]] [[gone|label]] `[[gone]]`", None), ("b/y.md", "", None), ("c/y.md", "one [[x#part]]", None), (None, "TODO", None)]
    notes, resolved = gated(spark, rows)
    issues = gate.core_gate(notes, resolved)
    wanted = {("self_link", "a/x.md", "x"), ("ambiguous_link", "a/x.md", "y"), ("broken_link", "a/x.md", "gone|label"), ("empty_file", "b/y.md", "no content")}
    assert {(r["rule"], r["path"], r["message"]) for r in issues.collect()} == wanted
    one = gate.summary(notes, issues, resolved).collect()
    assert [r.asDict() for r in one] == [{"notes": 3, "checked_links": 4, "broken_links": 1, "ambiguous_links": 1, "self_links": 1, "core_issues": 4, "passed": False}]


@pytest.mark.parametrize("columns", ["path string, text string", "path string, text string, note_type string, kind string, prose string, front string"])
def test_nothing_and_clashing_columns(spark, columns):
    notes, resolved = gated(spark, [], columns)
    issues = gate.core_gate(notes, resolved)
    assert issues.count() == 0 and gate.summary(notes, issues, resolved).select("core_issues", "passed").collect() == [(0, True)]
    width = columns.count(",") + 1
    again, resolved = gated(spark, [("p.md", "TODO", *["x"] * (width - 2))] * 2, columns)
    assert [tuple(r) for r in gate.core_gate(again, resolved).collect()] == [("residue", "p.md", 1, "TODO")] * 2


def test_texts_pass_once_without_a_shuffle(spark):
    notes = spark.createDataFrame([("a.md", "`x` TODO", None)], "path string, text string, note_type string")
    plan = gate.own_issues(notes.withColumn("text", F.concat("text", F.lit(""))))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("ArrowEvalPython") == 1
