"""Queries of the Markdown parsers and line rules over all documents, each ended with a passage made from its own words.

``MARKED`` is the same statement in Spark and in the oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.functions import markdown
from foliospark.operators import examples, frames, links, policies, repetition, rules, state
from foliospark.plans.registry import query, table

_NL, _BS, _TICK, _TAB = "chr(10)", "chr(92)", "chr(96)", "chr(9)"
_FENCE = f"concat({_TICK}, {_TICK}, {_TICK})"
_WORD = "concat('w', doc_id % 3)"
_TAIL = f"""CASE doc_id % 10
 WHEN 0 THEN concat('# Part ', {_WORD}, {_NL}, 'body', {_NL}, '## Sub ', {_WORD}, ' {{#own-', doc_id % 4, '}}', {_NL}, '### One', {_NL}, 'x', {_NL}, '## Sub ', {_WORD}, {_NL}, 'Under line', {_NL}, '------', {_NL}, 'end')
 WHEN 1 THEN concat({_FENCE}, 'python', {_NL}, 'a = f(', doc_id % 3, CASE WHEN doc_id % 4 = 1 THEN '' ELSE ')' END, {_NL}, {_FENCE}, {_NL}, 'use ', {_TICK}, 'code ', {_WORD}, {_TICK}, ' and ', {_TICK}, ' open')
 WHEN 2 THEN concat('    four blanks', {_NL}, {_TAB}, 'a tab', {_NL}, {_FENCE}, {_NL}, 'never closed ', {_WORD})
 WHEN 3 THEN concat('- an item, of ', {_WORD}, ' that is long enough to count', {_NL}, '* short, one', {_NL}, '1. https://a.example/, a link that does not count here', {_NL}, '- no marks at all in this item of plain words')
 WHEN 4 THEN concat('See [one [two] ', {_WORD}, '](notes/a%20b.md#sec ', chr(34), 'title', chr(34), ') ![img](i.png) [c](<d e.md>) [web](https://x.example/) [p](q(1).md) ', {_BS}, '[no](esc.md) [top](#here)')
 WHEN 5 THEN concat('## 知识链接', {_NL}, '关联阅读：[[a]]', {_NL}, 'text before', {_NL}, '关联阅读：', repeat('[[n]]', CAST(doc_id % 7 AS INT)))
 WHEN 6 THEN concat('## 一', {_NL}, 'x', {_NL}, '## 二', {_NL}, 'y', {_NL}, '## ', {_WORD}, {_NL}, 'z')
 WHEN 7 THEN concat('bell', chr(7), ' here', {_NL}, {_FENCE}, {_NL}, 'open fence')
 WHEN 8 THEN concat('例题：求 ', doc_id, ' 加 3 的值，先代入再计算', {_NL}, {_NL}, '答案：因此得到 ', doc_id + 3, CASE WHEN doc_id % 4 = 0 THEN '，注意条件不变，所以结论说明加法的含义，并且它只在整数的条件下成立，不能随意推广到其他情况，还要逐步检查每个步骤。' ELSE '' END)
 ELSE concat({_NL}, {_NL}, {_NL}, {_NL}, 'after blanks', {_NL}, {_NL}, 'last') END"""
MARKED = f"SELECT doc_id AS path, concat(coalesce(text, ''), {_NL}, {_TAIL}) AS text FROM documents"


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    table(spark, sf_dir, "documents").createOrReplaceTempView("folio_documents")
    return spark.sql(MARKED.replace("FROM documents", "FROM folio_documents"))


_N = f"WITH n AS ({MARKED}), l AS (SELECT path, unnest(range(1, len(a) + 1))::INT AS line_no, unnest(a) AS line FROM (SELECT path, string_split_regex(text, '\\r\\n|\\r|\\n') AS a FROM n)) "
_OPEN = ", f AS (SELECT *, regexp_matches(line, '^\\s{0,3}(```|~~~)') AS fence, sum(regexp_matches(line, '^\\s{0,3}(```|~~~)')::INT) OVER (PARTITION BY path ORDER BY line_no) AS fences FROM l)"


@query(_N + _OPEN + r""", v AS (SELECT path, line_no, CASE WHEN fence OR fences % 2 = 1 OR regexp_matches(line, '^(    |\t)') THEN '' ELSE line END AS line FROM f),
w AS (SELECT path, string_agg(line, chr(10) ORDER BY line_no) AS text FROM v GROUP BY path) SELECT path, length(regexp_replace(regexp_replace(text, '`[^`]*`', '', 'g'), '\s', '', 'g'))::INT AS visible FROM w""")
def masked_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters that the simple masking leaves: no fences, indented lines and code spans."""
    return notes(spark, sf_dir).select("path", F.length(F.regexp_replace(markdown.masked_plain("text"), r"(?U)\s", "")).alias("visible"))


@query(_N + _OPEN + r""", v AS (SELECT path, line_no, fences, CASE WHEN fence OR fences % 2 = 1 THEN '' ELSE line END AS line FROM f),
w AS (SELECT path, max(fences) % 2 = 1 AS unclosed, string_agg(line, chr(10) ORDER BY line_no) AS text FROM v GROUP BY path) SELECT path, unclosed, length(regexp_replace(regexp_replace(text, '`[^`]*`', '', 'g'), '\s', '', 'g'))::INT AS visible FROM w""")
def masked_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters outside code by the block rules (indented lines go on with their paragraph), and fences that stay open."""
    rows = notes(spark, sf_dir).select("path", markdown.masked_code("text").alias("m"))
    return rows.select("path", F.col("m.unclosed").alias("unclosed"), F.length(F.regexp_replace("m.masked", r"(?U)\s", "")).alias("visible"))


@query(_N + r""", m AS (SELECT path, regexp_extract(line, '^ {0,3}(#{1,6})\s', 1) AS marks, line_no, regexp_replace(trim(line), '^#{1,6}\s+', '') AS title FROM l WHERE regexp_matches(line, '^#{1,6}\s+\S') OR line = 'Under line'),
s AS (SELECT path, line_no, trim(regexp_replace(title, '\s*\{#[^}]*\}$', '')) AS bare, regexp_extract(title, '\{#([^}\s]+)\}$', 1) AS own FROM m),
k AS (SELECT *, trim(regexp_replace(regexp_replace(lower(bare), '[^\p{L}\p{N}_\s-]', '', 'g'), '[\s-]+', '-', 'g')) AS slug FROM s), r AS (SELECT *, row_number() OVER (PARTITION BY path, slug ORDER BY line_no) - 1 AS again FROM k),
x AS (SELECT path, unnest([lower(bare), slug, lower(own), CASE WHEN again > 0 AND slug <> '' THEN slug || '-' || again END]) AS anchor_key FROM r) SELECT DISTINCT path, anchor_key FROM x WHERE anchor_key <> ''""")
def heading_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All names that the headings of a text answer to: titles, slugs, repeats, explicit ids, underlined headings."""
    return links.anchors(frames.headings(notes(spark, sf_dir), underlined=True))


@query(_N + r""", f AS (SELECT *, sum(regexp_matches(line, '^\s*(```|~~~)')::INT) OVER (PARTITION BY path ORDER BY line_no) % 2 AS fenced FROM l), i AS (SELECT path, line_no, regexp_replace(trim(regexp_extract(line, '^\s*(?:[-*+] |[0-9]+[.)]\s+)(.+?)\s*$', 1)), '\s+', ' ', 'g') AS item FROM f WHERE fenced = 0 AND NOT regexp_matches(line, '^\s*(```|~~~)'))
SELECT path, line_no, item FROM i WHERE length(item) >= 24 AND NOT regexp_matches(item, '^(https?://|\[\[|`)') AND regexp_matches(item, '[，。！？：:；;,]')""")
def list_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language-like list items."""
    return frames.list_items(notes(spark, sf_dir))


@query(_N + r", i AS (SELECT path, regexp_extract(line, '^- (an item.*)$', 1) AS item FROM l WHERE line LIKE '- an item%') SELECT sha256(item) AS digest, count(*) AS n FROM i GROUP BY item HAVING count(*) >= 4")
def list_item_repeat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """List items that stand four times or more."""
    return repetition.shared(frames.list_items(notes(spark, sf_dir)), "item", repetition.LIST_ITEMS).select("digest", F.col("count").alias("n"))


_HEADS = _N + _OPEN.replace("\\s{0,3}(```|~~~)", " {0,3}(`{3,}|~{3,})") + r", h AS (SELECT path, line_no, length(regexp_extract(line, '^(#{1,6})', 1)) AS level, trim(regexp_extract(line, '^#{1,6}\s+(.+?)\s*$', 1)) AS title FROM f WHERE fences % 2 = 0 AND NOT fence AND regexp_matches(line, '^#{1,6}\s+\S')) "


@query(_HEADS + ", s AS (SELECT path % 4 AS dir, path, string_agg(title, '/' ORDER BY line_no) AS skeleton, count(*) AS n FROM h WHERE level = 2 GROUP BY path) SELECT dir::VARCHAR AS dir, skeleton, count(*) AS n FROM s WHERE s.n >= 3 GROUP BY dir, skeleton HAVING count(*) >= 4")
def heading_skeletons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences of second-level headings that four texts of one folder share."""
    rows = notes(spark, sf_dir).select(F.concat_ws("/", (F.col("path") % 4).cast("string"), F.col("path").cast("string")).alias("path"), "text")
    found = repetition.shared_skeletons(frames.headings(rows), F.col("path").rlike("^0/"))
    return found.select("dir", F.array_join("skeleton", "/").alias("skeleton"), F.col("count").alias("n"))


@query(_N + r""", k AS (SELECT path, text FROM n WHERE path % 10 = 4) SELECT path, unnest(['notes/a%20b.md#sec', 'd e.md', 'q(1).md', '#here']) AS raw, unnest(['notes/a b.md', 'd e.md', 'q(1).md', '']) AS target, unnest(['sec', '', '', 'here']) AS fragment FROM k WHERE regexp_matches(text, '\]\(notes/a%20b\.md#sec')""")
def inline_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inline links by the tokenizer: nested labels, titles, brackets, balanced destinations; no images, escapes or web links."""
    return links.markdown_links(notes(spark, sf_dir)).select("path", "raw", "target", F.coalesce("fragment", F.lit("")).alias("fragment"))


@query(_N + r""", b AS (SELECT *, last_value(CASE WHEN trim(line) <> '' THEN trim(line) END IGNORE NULLS) OVER (PARTITION BY path ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before, len(regexp_extract_all(line, '\[\[[^\]]+\]\]')) AS k FROM l)
SELECT 'link_dump_section' AS rule, path::VARCHAR AS path, line_no FROM b WHERE trim(line) = '## 知识链接' UNION ALL SELECT 'dense_related_links', path::VARCHAR, line_no FROM b WHERE line LIKE '关联阅读：%' AND k > 4
UNION ALL SELECT 'poor_link_context', path::VARCHAR, line_no FROM b WHERE line LIKE '关联阅读：%' AND k > 0 AND regexp_matches(before, '^(#|相关笔记|关联阅读)')""")
def study_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Link dumps, dense lines and links without a paragraph before them."""
    return policies.study_links(notes(spark, sf_dir)).select("rule", "path", "line_no")


@query(_N + r""", c AS (SELECT path, regexp_extract(text, '(?s)```python\n(.*?)\n```', 1) AS code, length(regexp_replace(split_part(text, '```python', 1), '[^\n]+', '', 'g')) + 2 AS line_no FROM n WHERE contains(text, '```python'))
SELECT path, line_no::INT AS line_no, length(replace(code, '(', '')) = length(replace(code, ')', '')) AS sound FROM c""")
def python_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Python blocks and whether they parse; the oracle counts brackets, which is what the blocks get wrong."""
    found = policies.code_blocks(notes(spark, sf_dir), "python")
    return found.select("path", "line_no", policies.python_syntax("code")["message"].isNull().alias("sound"))


@query(_N + _OPEN + r""", c AS (SELECT path, sum(regexp_matches(line, '^ {0,3}(`{3,}|~{3,})')::INT) AS k FROM l GROUP BY path) SELECT 'unbalanced_fence' AS rule, path::VARCHAR AS path, k::VARCHAR AS message FROM c WHERE k % 2 = 1
UNION ALL SELECT 'control_character', path::VARCHAR, 'control character' FROM n WHERE regexp_matches(text, '[\x00-\x08\x0b\x0c\x0e-\x1f]')""")
def open_fences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with an odd number of fences or a control character."""
    rows = notes(spark, sf_dir)
    return rules.all_of(rules.open_fences(rows), rules.control_characters(rows)).select("rule", "path", "message")


@query(_N + r""", b AS (SELECT *, trim(line) = '' AS blank, sum((trim(line) <> '')::INT) OVER (PARTITION BY path ORDER BY line_no) AS island FROM l), c AS (SELECT *, row_number() OVER (PARTITION BY path, island, blank ORDER BY line_no) AS nth FROM b) SELECT path, count(*) AS kept, max(line_no) AS last FROM c WHERE NOT blank OR nth <= 2 GROUP BY path""")
def compact_blanks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines left when runs of blank ones are cut to two."""
    kept = state.compact_blanks(frames.lines(notes(spark, sf_dir)), "path", "line_no", "line")
    return kept.groupBy("path").agg(F.count("*").alias("kept"), F.max("line_no").alias("last"))


@query(_N + _OPEN + " SELECT path, count(*) AS inside FROM f WHERE fences % 2 = 1 AND NOT fence GROUP BY path")
def fence_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines inside fences, by the running toggle."""
    rows = frames.lines(notes(spark, sf_dir))
    return state.fence_state(rows, "path", "line_no", F.col("line").rlike(r"^\s{0,3}(```|~~~)")).where("fenced").groupBy("path").agg(F.count("*").alias("inside"))


@query(_HEADS + ", c AS (SELECT 'heading' AS kind, path FROM h UNION ALL SELECT 'item', path FROM l WHERE regexp_matches(line, '^[-*] ')) SELECT kind, count(*) AS count, count(DISTINCT path) AS files FROM c GROUP BY kind")
def candidate_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of several kinds, rolled up with the number of texts."""
    rows = notes(spark, sf_dir)
    items = frames.lines(rows).where(F.col("line").rlike("^[-*] ")).select(F.lit("item").alias("kind"), "path")
    return repetition.roll_up(frames.headings(rows).select(F.lit("heading").alias("kind"), "path").union(items))


@query(_N + r""", p AS (SELECT path, row_number() OVER () AS id FROM n WHERE false), c(id, pattern) AS (VALUES (1, 'code w[0-9]'), (2, '(?i)UNDER'), (3, 'w1')) SELECT min(c.id)::VARCHAR AS message, l.path::VARCHAR AS path, line_no FROM l, c WHERE regexp_matches(line, pattern) GROUP BY l.path, line_no""")
def custom_residue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that fit a user's patterns, by the first that fits."""
    patterns = spark.createDataFrame([(1, "code w[0-9]"), (2, "(?i)UNDER"), (3, "w1")], "id int, regex string")
    return rules.custom_residue(notes(spark, sf_dir), patterns).select("message", "path", "line_no")


@query(_N + r"""
, e AS (SELECT path, regexp_extract(text, '(?s)(例题：.*)$', 1) AS text FROM n WHERE path % 10 = 8),
s AS (SELECT path, length(regexp_replace(text, '\s', '', 'g')) AS size, regexp_matches(text, '先|再|代入|计算') AS steps, regexp_matches(text, '答案|因此|得到') AS result, regexp_matches(text, '注意|条件|只|不能') AS bounded FROM e)
SELECT path, 'inline' AS kind, '计算型' AS type, CASE WHEN size >= 70 AND steps AND result AND bounded THEN 'A' WHEN size >= 45 AND result THEN 'B' WHEN size >= 30 THEN 'C' ELSE 'D' END AS grade,
 CASE WHEN size >= 45 THEN 'worked_example' ELSE 'insufficient_conditions' END AS role FROM s""")
def worked_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Worked examples at the ends of documents with type, grade and role."""
    found = examples.graded(examples.examples(notes(spark, sf_dir))).where("kind = 'inline' and text like '例题：%'")
    return found.select("path", "kind", "type", "grade", "role")
