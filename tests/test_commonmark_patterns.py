"""Code masking by the CommonMark rules, many patterns at once, YAML, route and content rules."""

import re

import pytest

from foliospark.functions.markdown import _masked, mask_code
from foliospark.operators import courses, evidence, guidance, links, many, rules
from foliospark.sources import yaml

# A text and the same text with code as dots.
CODE = [
    ("\tfoo\tbaz\t\tbim", "............."), ("  - foo\n\n\tbar", "  - foo\n\n\tbar"), ("- foo\n\n\t\tbar", "- foo\n\n....."), (">\t\tfoo", "......"), ("-\t\tfoo", "......"), ("    foo\n\tbar", ".......\n...."),
    (" - foo\n   - bar\n\t - baz", " - foo\n   - bar\n\t - baz"), ("#\tFoo", "#\tFoo"), ("*\t*\t*\t", "*\t*\t*\t"), ("- `one\n- two`", "- `one\n- two`"), ("***\n`a`", "***\n..."), ("    ***", "......."), ("Foo\n    ***", "Foo\n    ***"),
    ("- Foo\n- * * *\n  `x`", "- Foo\n- * * *\n  ..."), ("# `a`", "# ..."), ("    # foo", "........."), ("foo\n    # bar", "foo\n    # bar"), ("Foo `a\nb`\n===", "Foo ..\n..\n==="), ("Foo\n\n    ---", "Foo\n\n......."), ("`Foo\n----\n`", "`Foo\n----\n`"),
    ("    a simple\n      indented code block", "............\n........................."), ("  - foo\n\n    bar", "  - foo\n\n    bar"), ("1.  foo\n\n    - bar", "1.  foo\n\n    - bar"), ("    chunk1\n\n    chunk2\n  \n \n \n    chunk3", "..........\n\n..........\n..\n.\n.\n.........."),
    ("Foo\n    bar", "Foo\n    bar"), ("    foo\nbar", ".......\nbar"), ("# Heading\n    foo\nHeading\n------\n    foo\n----", "# Heading\n.......\nHeading\n------\n.......\n----"), ("    foo  ", "........."),
    ("```\n<\n >\n```", "...\n.\n..\n..."), ("~~~\n<\n~~~", "...\n.\n..."), ("``\nfoo\n``", "..\n...\n.."), ("```\naaa\n~~~\n```", "...\n...\n...\n..."), ("````\naaa\n```\n``````", "....\n...\n...\n......"), ("```\n\n```\naaa", "...\n\n...\naaa"),
    ("> ```\n> aaa\n\nbbb", ".....\n.....\n\nbbb"), (" ```\n aaa\naaa\n```", "....\n....\n...\n..."), ("    ```\n    aaa\n    ```", ".......\n.......\n......."), ("```\naaa\n  ```", "...\n...\n....."), ("```\naaa\n    ```", "...\n...\n......."), ("``` ```\naaa", ".......\naaa"),
    ("~~~~~~\naaa\n~~~ ~~", "......\n...\n......"), ("foo\n```\nbar\n```\nbaz", "foo\n...\n...\n...\nbaz"), ("foo\n---\n~~~\nbar\n~~~\n# baz", "foo\n---\n...\n...\n...\n# baz"), ("~~~~    ruby startline=3 $%@#$\ndef\n~~~~~~~", "." * 30 + "\n...\n......."), ("``` aa ```\naaa", "..........\naaa"),
    ("~~~ aa ``` ~~~\nfoo\n~~~", "..............\n...\n..."), ("```\n``` aaa\n```", "...\n.......\n..."), ("<div>\n`x`\n\n`y`", "<div>\n`x`\n\n..."), ("<pre>\n\n`x`\n</pre>\n`y`", "<pre>\n\n`x`\n</pre>\n..."), ("<!-- a\n\n    b -->\n`y`", "<!-- a\n\n    b -->\n..."), ("<i>\n`x`", "<i>\n`x`"), ("a <i>\n`x`", "a <i>\n..."),
    ("> # Foo\n> `bar`\n> baz", "> # Foo\n> .....\n> baz"), ("> bar\n`baz`", "> bar\n....."), ("> - foo\n- `bar`", "> - foo\n- ....."), (">     foo\n    bar", ".........\n......."), ("> ```\nfoo\n```", ".....\nfoo\n..."), ("> foo\n    - `bar`", "> foo\n    - ....."), (">     code\n\n>    not", "..........\n\n>    not"),
    ("1.  A paragraph\n    with two lines.\n\n        indented code\n\n    > A block quote.", "1.  A paragraph\n    with two lines.\n\n.....................\n\n    > A block quote."), ("- one\n\n two", "- one\n\n two"), ("- one\n\n  `two`", "- one\n\n  ....."),
    (" -    one\n\n     two", " -    one\n\n........"), ("- foo\n\n      bar", "- foo\n\n........."), ("  10.  foo\n\n           bar", "  10.  foo\n\n.............."), ("1.     indented code\n\n   paragraph\n\n       more code", "....................\n\n   paragraph\n\n................"),
    ("-\n  foo\n-\n  ```\n  bar\n  ```\n-\n      baz", "-\n  foo\n-\n.....\n.....\n.....\n-\n........."), ("-\n\n  foo", "-\n\n  foo"), ("- foo\n\n  ```\n  bar\n  ```\n\n  baz\n\n  > bam", "- foo\n\n.....\n.....\n.....\n\n  baz\n\n  > bam"), ("1234567890. `not ok`", "1234567890. ........"),
    ("> 1. > Blockquote\ncontinued `here`.", "> 1. > Blockquote\ncontinued ......."), ("- foo\n  - bar\n    - baz\n\n\n      bim", "- foo\n  - bar\n    - baz\n\n\n      bim"), ("- a\n - b\n  - c\n   - d\n    - `e`", "- a\n - b\n  - c\n   - d\n    - ..."), ("1. a\n\n  2. b\n\n    3. c", "1. a\n\n  2. b\n\n........"),
    ("- a\n- ```\n  b\n\n\n  ```\n- c", "- a\n.....\n...\n\n\n.....\n- c"), ("`foo`", "....."), ("`` foo ` bar ``", "..............."), ("` `` `", "......"), ("``\nfoo \nbar  \nbaz\n``", "..\n....\n.....\n...\n.."), ("`foo\\`bar`", "......bar`"), ("``foo`bar``", "..........."), ("*foo`*`", "*foo..."),
    ("[not a `link](/foo`)", "[not a ............)"), ('`<a href="`">`', '...........">`'), ('<a href="`">`', '<a href="`">`'), ("`<https://foo.bar.`baz>`", "...................baz>`"), ("<https://foo.bar.`baz>`", "<https://foo.bar.`baz>`"), ("```foo``", "```foo``"), ("`foo", "`foo"), ("`foo``bar``", "`foo......."), ("\\`a` `b`", "\\`a...b`"),
    ("\\\\`a`", "\\\\..."), ("a\r\n\r\n    b\r\n", "a\r\n\r\n.....\r\n"), ("", ""),
]


@pytest.mark.parametrize(("text", "wanted"), CODE)
def test_code_is_masked_in_place(text, wanted):
    masked, _ = mask_code(text)
    shown = "".join("." if a == " " and (b not in " \t" or c == ".") else a if a == b else "!" for a, b, c in zip(masked, text, wanted, strict=True))
    assert shown == wanted


@pytest.mark.parametrize(("text", "open_"), [("```\na", True), ("```\na\n```", False), ("> ```\n> a\nb", True), ("- ```\n  a\n- b", True), ("a", False), ("```\na\n``` b", True)])
def test_open_fences(text, open_):
    assert _masked(text)[2] is open_


def test_masking_of_long_texts_is_quick():
    line = "`a` b " * 50_000
    masked, _ = mask_code(line + "\n> " + "``" * 100_000 + "\n" + "x\n" * 50_000)
    assert masked.startswith("    b     b ")


def notes(spark, rows):
    return spark.createDataFrame(rows, "path string, text string")


def rows_of(found, *columns):
    return sorted(tuple(r[c] for c in columns) for r in found.collect())


def test_needed_literals():
    literal = many.needed_literal
    assert [literal(p) for p in ("abc", "a.bcd", "a|b", "(?i)abc", "x?yz", "(?:abc)+d", "[ab]c", r"\d{3}", "^abc$", r"(ab)\1", "a(?=bcd)ef", "")] == ["abc", "bcd", "", "", "yz", "abc", "c", "", "abc", "ab", "ef", ""]


def test_patterns_stand_alone(spark):
    docs = notes(spark, [("a", "foo\nfoo x"), ("b", "zz aba"), ("c", "aa bb"), ("d", None), ("e", "")])
    patterns = spark.createDataFrame([(1, r"\Afoo\Z"), (2, r"(a)b\1"), (3, "(zz)"), (4, "(?P<n>a)a"), (5, "(?P<n>b)b"), (6, None), (7, "")], "id int, regex string")
    assert rows_of(rules.custom_residue(docs, patterns), "path", "line_no", "message") == [("a", 1, "1"), ("b", 1, "2"), ("c", 1, "4")]


def test_ten_thousand_patterns_in_one_scan(spark):
    words = [f"w{k:05d}" for k in range(10_000)]
    regexes = [(k, w if k % 3 else f"{w[:-1]}[{w[-1]}]$") for k, w in enumerate(words)]
    docs = notes(spark, [(str(d), "\n".join(f"{words[(37 * d + 501 * n) % 10_000]} and w1" for n in range(10))) for d in range(12)])
    patterns = spark.createDataFrame(regexes, "id int, regex string")
    found = many.first_patterns(docs, patterns)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("MapInPandas") == 1
    compiled = [(k, re.compile(p)) for k, p in regexes]
    firsts = ((r["path"], n, next((k for k, p in compiled if p.search(line)), None)) for r in docs.collect() for n, line in enumerate(r["text"].split("\n"), 1))
    wanted = sorted(f for f in firsts if f[2] is not None)
    assert rows_of(found, "path", "line_no", "id") == wanted


def test_patterns_in_parts(spark, monkeypatch):
    monkeypatch.setattr(many, "PART_BYTES", 4)
    docs = notes(spark, [("a", "one two\nthree"), ("b", "two")])
    patterns = spark.createDataFrame([(1, "two"), (2, "one"), (3, "three"), (4, "two")], "id int, regex string")
    assert rows_of(many.first_patterns(docs, patterns), "path", "line_no", "id") == [("a", 1, 1), ("a", 2, 3), ("b", 1, 1)]
    literals = patterns.withColumnRenamed("regex", "text")
    assert rows_of(many.containing(docs, "path", literals), "id", "path") == [(1, "a"), (1, "b"), (2, "a"), (3, "a"), (4, "a"), (4, "b")]


def test_links_in_code_do_not_count(spark):
    docs = notes(spark, [("a", "see [[x]] and `[[y]]`\n```\n[[z]]\n```\n    [[w]]\n\n    [[v]]\n![[e]] [[u|U]]"), ("b", None), ("c", "[[x]]")])
    assert rows_of(links.wikilinks(docs), "path", "target") == [("a", "u"), ("a", "x"), ("c", "x")]


def test_routes_in_code_and_tables(spark):
    text = "---\nx: 方向 RAG算法岗\n---\n方向 `RAG算法岗`\n```\n方向 RAG算法岗\n```\n<!-- 方向 RAG算法岗 -->\n不创建RAG算法岗 方向\n"
    table = "| 方向 | 不能做 |\n|---|---|\n| ok 方向 | RAG算法岗 方向 |\n| RAG算法岗 方向 | x |\ntext\n| 方向 RAG算法岗 | b |"
    found = courses.route_issues(notes(spark, [("a", text), ("t", table), ("n", None)]))
    assert rows_of(found, "path", "line_no", "message") == [("a", 4, "RAG算法岗"), ("t", 4, "RAG算法岗"), ("t", 6, "RAG算法岗")]
    heads = courses.matrix_headers(notes(spark, [("m", "| 知识点 | **RAG** | CV |\n| 其他 | RAG |\n知识点 RAG"), ("n", None)]))
    assert rows_of(heads, "path", "line_no", "message") == [("m", 1, "RAG")]


def test_aliases_and_tags_name_no_legacy_route(spark):
    text = "---\ntags:\n  - course/x\n  - RAG算法岗\naliases: [\"rag算法岗 x\", fine]\ndirection: cv\n---\nx"
    assert rows_of(courses.direction_values(notes(spark, [("a", text)])), "rule", "message") == [("legacy_route_name", "RAG算法岗"), ("legacy_route_name", "rag算法岗 x")]


def test_course_contents(spark):
    rows = [
        ("e", " \n"), ("n", None), ("c", "  <<<<<<< a\nx\n=======\ny\n>>>>>>> b"), ("k", "======="), ("t", "TODO `FIXME`\n待补 空话"), ("f", "```\nx"), ("m", "$$\nx\n$$ y\n> $$\n<!-- \n$$\n-->\n$$"),
        ("b", "| a | b |\n|---|---|\n| 1 | 2 | 3 |\n| `|` | 2 |\n\n| x \\| y |\n|---|"), ("ok", "# t\n\ntext"),
    ]
    wanted = [
        ("broken_table", "b", 3), ("conflict_marker", "c", 1), ("conflict_marker", "c", 3), ("conflict_marker", "c", 5), ("empty_file", "e", 0), ("empty_file", "n", 0), ("template_residue", "t", 1), ("template_residue", "t", 2),
        ("unbalanced_fence", "f", 0), ("unbalanced_math", "m", 0),
    ]
    assert rows_of(courses.content_issues(notes(spark, rows)), "rule", "path", "line_no") == wanted
    strict = rows_of(courses.content_issues(notes(spark, rows), strict=True), "rule", "path", "line_no")
    assert sorted(set(strict) - set(wanted)) == [("generic_template_residue", "t", 2)]


def test_mentions_send_no_text(spark):
    docs = notes(spark, [("a", "see x/y.pdf, and (z.ppt)"), ("b", "xx/y.pdf y.pdf"), ("c", None), ("d", "x\\y.pdf")])
    entries = spark.createDataFrame([("x/y.pdf",), ("./z.ppt",), ("never.pdf",)], "root_relative string")
    found = evidence.mentions(docs, entries)
    assert rows_of(found, "path", "source") == [("a", "x/y.pdf"), ("a", "z.ppt"), ("d", "x/y.pdf")]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    joins = [k for k, line in enumerate(plan.splitlines()) if "Join" in line]
    assert joins and not any("Generate" in line and "text" in line.split("[")[1].split("]")[0] for line in plan.splitlines() if "Generate" in line and "[" in line and "folio_text" in line)


PLAIN = {"str": str, "bool": lambda t: t == "true", "int": int, "float": float, "null": lambda t: None}


def plain(node):
    if isinstance(node, yaml.Scalar):
        return PLAIN[node.type](node.text)
    return {k: plain(v) for k, v in node.items()} if isinstance(node, dict) else [plain(x) for x in node]


@pytest.mark.parametrize(
    ("text", "wanted"),
    [
        ("a: 1\nb:\n  - x\n  - y: 2\n    z: 3\n  -\n    - q\n    - - r\n", {"a": 1, "b": ["x", {"y": 2, "z": 3}, ["q", ["r"]]]}), ("a: [1, two, {k: v, 'q': \"w\"}, [x]]\nb: {c: d,\n  e: [f,\n g]}", {"a": [1, "two", {"k": "v", "q": "w"}, ["x"]], "b": {"c": "d", "e": ["f", "g"]}}),
        ("t: |\n  one\n   two\n\n  three\nu: >-\n  a\n  b\n\n  c\n    d\n  e\nv: |+\n  k\n\n", {"t": "one\n two\n\nthree\n", "u": "a b\nc\n  d\ne", "v": "k\n\n"}), ("k: 'it''s'\nd: \"a\\tb \\u00e9 \\\n  c\"\ne: \"x\n  y\n\n  z\"", {"k": "it's", "d": "a\tb é c", "e": "x y\nz"}),
        ("a: b c # note\nurl: http://x.y/z#f\nplain: a\n  b\n  c\nn: ~\ne:\nf: 1.5e3\nh: 0x1F\n", {"a": "b c", "url": "http://x.y/z#f", "plain": "a b c", "n": None, "e": None, "f": 1500.0, "h": 31}), ("list:\n- a\n- b\nnext: -1", {"list": ["a", "b"], "next": -1}),
        ("---\n# c\na: 1\n...\n", {"a": 1}), ("", None), ("'q k': 1\n\"z\": 2", {"q k": 1, "z": 2}), ("a: {}\nb: []", {"a": {}, "b": []}), ("a: [b: c, d]", {"a": [{"b": "c"}, "d"]}), ("x: >\n  folded\n  text\n\n  next\n", {"x": "folded text\nnext\n"}), ("a: 2024-01-01\nb: yes\nc: 'true'", {"a": "2024-01-01", "b": "yes", "c": "true"}),
    ],
)
def test_yaml(text, wanted):
    assert plain(yaml.read(text)) == wanted


@pytest.mark.parametrize("text", ["a: 'x", "\ta: 1", "a: 1\na: 2", "a:\n  b: 1\n c: 2", "a: &x 1", "a: *x", "a: !t x", "a: x: y", "a: [1, 2", "a: 1\n--- \nb: 2", 'a: "\\q"', "a: - x", "a: {b: 1, b: 2}", "a: [1] 2", "a: |x\n  b", "a: 'x' y", "- a\nb: 1", "a: %x", "a: [1 {2}]"])
def test_yaml_faults(text):
    with pytest.raises(yaml.YamlError):
        yaml.read(text)


def test_package_metadata_rules(spark):
    base = 'interface:\n  display_name: "P"\n  short_description: "a description that is long enough"\n  default_prompt: "use $p now"\n'
    rows = [
        ("p", base), ("q-1", base.replace("$p", "$q-1").replace('"P"', "P")), ("r", base.replace("$p", "$r").replace('"P"', "7")), ("s", base.replace("$p", "$s") + '  icon_small: "../x.png"\n  icon_large: "a/b.png"\n'),
        ("t", base.replace("$p", "$t") + 'policy:\n  allow_implicit_invocation: "yes"\n  other: true\n'), ("u", base.replace("$p", "$u") + 'dependencies:\n  tools:\n    - type: "mcp"\n      value: "v"\n    - type: "x"\n      value: ""\n      extra: "e"\n'),
        ("v", base.replace("$p", "$v") + 'dependencies:\n  tools: "t"\n  more: 1\n'), ("w", "- a"), ("x", None),
    ]
    assets = spark.createDataFrame([("s", "a/c.png")], "path string, asset string")
    found = rows_of(guidance.metadata_issues(notes(spark, rows), assets), "path", "message")
    assert found == [
        ("q-1", "unquoted: display_name"), ("r", "not a string: display_name"), ("s", "icon_large"), ("s", "icon_small"), ("t", "allow_implicit_invocation"), ("t", "unknown: other"), ("u", "tool text"), ("u", "tool type"),
        ("u", "unknown tool keys: extra"), ("v", "tools"), ("v", "unknown: more"), ("w", "line 1: no key"), ("x", "missing: default_prompt,display_name,short_description"),
    ]
