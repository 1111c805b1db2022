"""The claim audit and worked examples on small notes."""

import pytest
from pyspark.sql import functions as F

from foliospark.operators import claims, examples

CLAIMS = [
    ("该方法完全解决了问题。", [("完全", "ENGINEERING_PROMISE", True), ("解决", "ENGINEERING_PROMISE", False)]),
    ("不完全解决", [("解决", "ENGINEERING_PROMISE", False)]),
    ("完全二叉树", []),
    ("首次提出该方法。后句", [("首次提出", "EMPIRICAL_OVERCLAIM", True)]),
    ("论文首次提出该方法", []),
    ("系统不能保证所有请求。", []),
    ("如果网络正常，保证所有请求。", []),
    ("通常保证所有请求成功。", [("保证", "ENGINEERING_PROMISE", True)]),
    ("通常保证成功。", [("保证", "MANUAL_REVIEW", True)]),
    ("系统保证所有请求成功。", [("保证", "ENGINEERING_PROMISE", True)]),
    ("缴纳保证金", []),
    ("必须保证成功", []),
    ("是否必然收敛？", []),
    ("`保证` 与 [[保证|标签]] 和 ![[保证]]", []),
    ("法律必然要求", [("必然", "POLICY_OR_LEGAL_CLAIM", True)]),
    ("旨在解决所有难点", []),
    ("它解决所有难点", [("解决", "ENGINEERING_PROMISE", True)]),
    ("- **保证**：说明", []),
]


def test_claim_audit(spark):
    lines = spark.createDataFrame([(str(k), 1, text) for k, (text, _) in enumerate(CLAIMS)], "path string, line_no int, line string")
    got = {}
    for r in claims.audit(lines).collect():
        got.setdefault(int(r["path"]), []).append((r["term"], r["category"], r["high_confidence"]))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, (_, v) in enumerate(CLAIMS) if v}


def test_claim_lines_and_sentences(spark):
    text = "# 保证所有\n```\n系统保证所有\n```\n前句。系统保证所有！后句"
    docs = spark.createDataFrame([("a", text), ("b", None), ("c", "")], "path string, text string")
    rows = claims.audit(claims.prose_lines(docs)).collect()
    assert [(r["path"], r["line_no"], r["sentence"]) for r in rows] == [("a", 5, "系统保证所有！")]
    assert [(r["category"], r["n"], r["high"]) for r in claims.counts(claims.audit(claims.prose_lines(docs))).collect()] == [("ENGINEERING_PROMISE", 1, 1)]


NOTE = """# T
## 例题 1
题目：已知 a = 2，求 a 加 3 的值，先代入再计算，因此得到 5，注意条件不变，所以答案为 5，这个结论说明加法的含义，并且它只在整数的条件下成立，不能随意推广。
### 示例 子节
text
## Other
例题：求和

答案 5


unrelated
示例代码
```python
def f():
    return 1 + 1  # long enough to be graded as a code block, really
```
## PPT/PDF 例题辅助理解
| 知识点 | 来源 | 解析 |
|---|---|---|
| topic | p1 | 解析：太短 |
"""


def test_examples(spark):
    docs = spark.createDataFrame([("a", NOTE), ("b", None), ("c", ""), ("d", "nothing here")], "path string, text string")
    found = examples.examples(docs)
    rows = {r["line_no"]: r for r in examples.graded(found).collect()}
    assert {k: (r["kind"], r["title"]) for k, r in rows.items()} == {2: ("narrative", "例题 1"), 7: ("inline", "例题"), 14: ("code", "示例代码"), 18: ("narrative", "PPT/PDF 例题辅助理解"), 21: ("table", "topic")}
    assert rows[7]["text"] == "例题：求和\n\n答案 5\n"
    assert (rows[2]["grade"], rows[2]["role"], rows[2]["type"]) == ("A", "worked_example", "计算型")
    assert (rows[14]["grade"], rows[14]["role"], rows[14]["type"]) == ("B", "worked_example", "代码型")
    assert (rows[21]["grade"], rows[21]["role"]) == ("D", "missing_answer")
    assert (rows[7]["grade"], rows[7]["role"]) == ("D", "insufficient_conditions")
    assert {(r["facet"], r["value"]): r["n"] for r in examples.report(examples.graded(found)).collect()}[("gate", "failed")] == 3
    assert examples.thin_explanations(found).count() == 1


@pytest.mark.parametrize(("kind", "text", "grade"), [("table", "完整练习：写出题目已知条件", "D"), ("code", "x" * 50, "C"), ("narrative", "x" * 30, "C"), ("narrative", "x" * 25 + " -> y", "B"), ("narrative", "好" * 45 + "先看，得到结论", "C"), ("table", "前" * 90 + "解析：短", "D")])
def test_grades(spark, kind, text, grade):
    row = spark.createDataFrame([(kind, text)], "kind string, text string").select(examples.grade(F.col("kind"), F.col("text")).alias("g")).first()
    assert row["g"] == grade


def test_reused_explanations(spark):
    line = "| a | b | 解析：“{}”" + "同" * 80 + " |"
    rows = spark.createDataFrame([("p", k, "table", "a", line.format(k)) for k in range(3)], "path string, line_no int, kind string, title string, text string")
    assert [(r["n"], r["first"]["line_no"]) for r in examples.reused_explanations(rows).collect()] == [(3, 0)]
