"""Queries of deck planning, examples and reports over documents as notes and nations as briefs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.functions import text as T
from foliospark.operators import deck, examples, links
from foliospark.plans import vault
from foliospark.plans.registers import _view
from foliospark.plans.registry import query, table
from foliospark.sinks import reports

_NL = "chr(10)"
_NOTES = f"""SELECT concat('n/', doc_id, '.md') AS path, doc_id, concat('---', {_NL}, 'x: 1', {_NL}, '---', {_NL}, CASE WHEN doc_id % 4 = 0 THEN '' ELSE concat('# Note ', doc_id, {_NL}) END, '<!-- # hidden -->', {_NL}, CASE doc_id % 5 WHEN 0 THEN '## Method' WHEN 1 THEN '## 实验结果' WHEN 2 THEN '## Limitation' WHEN 3 THEN '## 课程例题' ELSE '### Background problem' END, {_NL},
 'see [[a]] and [b](c.md) ![[p.png]] ![[q.bin]] ![i](j.png) https://x.example/', doc_id, {_NL}, '| a | b |', {_NL}, '| --- | --- |', {_NL}, '| 1 | 2 |', {_NL}, 'words 中文', {_NL}, substr(translate(coalesce(text, ''), '$%#|&*', ''), 1, 300)) AS text FROM documents"""
_N = f"WITH n AS ({_NOTES}), "
_PICK = "CASE doc_id % 5 WHEN 0 THEN 'Method' WHEN 1 THEN '实验结果' WHEN 2 THEN 'Limitation' WHEN 3 THEN '课程例题' ELSE 'Background problem' END"


def _summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deck.summaries(_view(spark, sf_dir, "documents", _NOTES))


@query(_N + f"""b AS (SELECT path, doc_id, regexp_replace(regexp_replace(text, '^---\\n(?s:.*?)\\n---\\n', chr(10)), '<!--(?s:.*?)-->', ' ', 'g') AS t FROM n)
SELECT path, CASE WHEN doc_id % 4 = 0 THEN doc_id::VARCHAR ELSE 'Note ' || doc_id END AS title, (CASE WHEN doc_id % 4 = 0 THEN 1 ELSE 2 END)::INT AS headings, 2::INT AS markdown_links, 1::INT AS wiki_links, 2::INT AS images, 1::INT AS attachments, 1::INT AS tables,
 (len(regexp_extract_all(t, '[一-鿿]')) + len(regexp_extract_all(t, '[A-Za-z0-9_]+(?:[-''][A-Za-z0-9_]+)*')))::INT AS words FROM b""")
def note_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles and counts of notes, without frontmatter and comments."""
    found = _summaries(spark, sf_dir)
    return found.select("path", "title", F.size("headings").alias("headings"), F.size("markdown_links").alias("markdown_links"), F.size("wiki_links").alias("wiki_links"), "images", "attachments", "tables", "words")


_WORDS = ", ".join(f"({m}, '{name}', '{word}')" for m, (name, words) in enumerate(deck.MODES.items()) for word in words)


@query(_N + f"""b AS (SELECT doc_id % 6 AS deck, lower(CASE WHEN doc_id % 4 = 0 THEN doc_id::VARCHAR ELSE 'Note ' || doc_id END || ' ' || CASE WHEN doc_id % 4 = 0 THEN '' ELSE 'Note ' || doc_id || ' ' END || {_PICK} || ' ' || substr(regexp_replace(regexp_replace(text, '^---\\n(?s:.*?)\\n---\\n', chr(10)), '<!--(?s:.*?)-->', ' ', 'g'), 1, 1200)) AS corpus FROM n),
w(ord, mode, word) AS (VALUES {_WORDS}), s AS (SELECT deck, ord, mode, count(DISTINCT word) AS score FROM b JOIN w ON contains(corpus, word) GROUP BY ALL) SELECT deck, arg_max(mode, score * 100 - ord) AS mode FROM s GROUP BY deck""")
def deck_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mode of six decks, by the words of their notes."""
    found = _summaries(spark, sf_dir).withColumn("deck", F.expr("cast(regexp_extract(path, '([0-9]+)', 1) as bigint) % 6"))
    return deck.deck_mode(found, "deck")


@query(_N.rstrip(", ") + " SELECT CASE WHEN sum(len(regexp_extract_all(text, '[一-鿿]'))) >= 8 THEN 'zh' ELSE 'en' END AS language FROM n")
def deck_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language that the notes vote for."""
    return deck.language(_summaries(spark, sf_dir))


@query(f"""SELECT concat('n/', doc_id, '.md') AS path, {_PICK} AS title, CASE doc_id % 5 WHEN 0 THEN 'method/mechanism' WHEN 1 THEN 'evidence/results' WHEN 2 THEN 'limitations' WHEN 3 THEN 'supporting concept' ELSE 'problem framing' END AS role,
 CASE doc_id % 5 WHEN 0 THEN 'mechanism diagram' WHEN 1 THEN 'result/comparison table' WHEN 2 THEN 'limitation/failure-case slide' WHEN 3 THEN 'result/comparison table, annotated figure or example panel' ELSE 'problem contrast or motivation evidence' END AS proof FROM documents""")
def slide_backlog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slides that the headings of each note ask for, with role and proof object."""
    return deck.backlog(_summaries(spark, sf_dir)).select("path", "title", "role", "proof")


_BRIEFS = f"""SELECT concat('d', n_nationkey) AS deck, n_nationkey, concat('# Brief', {_NL}, '- Maximum total slide count: ', n_nationkey % 7, {_NL}, {_NL}, '## Suggested Scientific Deck Spine', {_NL}, '1. Opening of ', n_name, {_NL}, '2. Method of it', {_NL}, '3. Result table', {_NL}, CASE WHEN n_nationkey % 2 = 0 THEN concat('4. Risk and failure', {_NL}) ELSE '' END, {_NL},
 '## Draft Slide Backlog', {_NL}, '- [method/mechanism] from ', chr(96), 'a.md', chr(96), ' - Proof object: diagram of ', n_name, '.', {_NL}, '- [claim] from ', chr(96), 'b.md', chr(96), ' - Proof object: a claim.', {_NL}) AS text FROM nation"""
_SPINE = """SELECT 'd' || n_nationkey AS deck, n_nationkey % 7 AS most, unnest([0, 1, 2] || CASE WHEN n_nationkey % 2 = 0 THEN [3] ELSE [] END) AS pos, unnest(['Opening of ' || n_name, 'Method of it', 'Result table'] || CASE WHEN n_nationkey % 2 = 0 THEN ['Risk and failure'] ELSE [] END) AS title,
 unnest(['claim', 'method/mechanism', 'evidence/results'] || CASE WHEN n_nationkey % 2 = 0 THEN ['limitations'] ELSE [] END) AS role, unnest(['a claim', 'diagram of ' || n_name, 'claim with source-grounded proof object'] || CASE WHEN n_nationkey % 2 = 0 THEN ['claim with source-grounded proof object'] ELSE [] END) AS proof FROM nation"""


@query(f"SELECT deck, pos::INT AS pos, title, role, proof FROM ({_SPINE})")
def deck_spines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slides of each brief, the proof of the first backlog item of their role."""
    return deck.spine(_view(spark, sf_dir, "nation", _BRIEFS))


@query("SELECT 'd' || n_nationkey AS deck, (n_nationkey % 7)::INT AS total, n_nationkey % 7 >= 2 AS valid FROM nation")
def deck_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number of slides that a brief states, and whether it can be kept."""
    return deck.total_slides(_view(spark, sf_dir, "nation", _BRIEFS))


@query(f"""WITH s AS ({_SPINE}), p AS (SELECT deck, title, row_number() OVER (PARTITION BY deck ORDER BY pos) AS nth FROM s WHERE role <> 'limitations'), d AS (SELECT DISTINCT 'd' || n_nationkey AS deck, n_nationkey FROM nation)
SELECT deck, title FROM p WHERE nth <= 2 UNION ALL SELECT deck, CASE WHEN n_nationkey % 2 = 0 THEN 'Risk and failure' ELSE 'Limitations and open questions' END FROM d UNION ALL SELECT deck, 'Appendix index' FROM d""")
def deck_budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four slides of each deck: the first two, the limitations and the appendix."""
    return deck.within_budget(deck.spine(_view(spark, sf_dir, "nation", _BRIEFS)), 4).select("deck", "title")


_TITLES = f"SELECT doc_id % 10 AS deck, doc_id AS pos, CASE doc_id % 5 WHEN 0 THEN ' ' WHEN 1 THEN concat('a', {_NL}, 'b') WHEN 2 THEN repeat('x', 181) WHEN 3 THEN repeat('宽', 70) ELSE 'Fine title' END AS title FROM documents"


@query("SELECT doc_id % 10 AS deck, doc_id AS pos, CASE doc_id % 5 WHEN 0 THEN 'empty' WHEN 1 THEN 'several lines' WHEN 2 THEN 'too long' ELSE 'too wide' END AS issue FROM documents WHERE doc_id % 5 < 4")
def title_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles that are empty, of several lines, too long or too wide."""
    return deck.title_issues(_view(spark, sf_dir, "documents", _TITLES).withColumn("units", T.title_units("title")))


_ROWS = f"""SELECT doc_id AS path, concat('## PPT/PDF 例题辅助理解', {_NL}, '| 知识点 | 例题 | 解析 |', {_NL}, '|---|---|---|', {_NL}, '| k', doc_id, ' | q | 解析：先看“k', doc_id, '”再代入', CASE doc_id % 3 WHEN 0 THEN '' ELSE repeat('计算步骤并核对答案的条件，', 8) END, CASE WHEN doc_id % 3 = 2 THEN concat('第', doc_id, '题') ELSE '' END, ' |') AS text FROM documents"""


@query("SELECT doc_id AS path, 4::INT AS line_no FROM documents WHERE doc_id % 3 = 0 AND 10 + length(doc_id::VARCHAR) < 30")
def thin_explanations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of example tables whose explanation is short."""
    found = examples.examples(_view(spark, sf_dir, "documents", _ROWS))
    return examples.thin_explanations(found).select("path", "line_no")


@query("SELECT count(*) AS n, min(doc_id) AS first_path FROM documents WHERE doc_id % 3 = 1 HAVING count(*) >= 3")
def reused_explanations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Explanations that are one template but for their topic."""
    found = examples.reused_explanations(examples.examples(_view(spark, sf_dir, "documents", _ROWS)))
    return found.select("n", F.col("first.path").alias("first_path"))


@query("SELECT 'kind' AS facet, 'table' AS value, count(*) AS n FROM documents UNION ALL SELECT 'type', '计算型', count(*) FROM documents UNION ALL SELECT 'rows', 'graded', count(*) FROM documents")
def example_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Examples by kind and type, and how many of them were graded."""
    rows = examples.graded(examples.examples(_view(spark, sf_dir, "documents", _ROWS)).where("kind = 'table'"))
    counted = examples.report(rows)
    graded = counted.where("facet = 'gate'").groupBy().agg(F.sum("n").alias("n")).select(F.lit("rows").alias("facet"), F.lit("graded").alias("value"), "n")
    return counted.where("facet in ('kind', 'type')").unionByName(graded)


@query(f"""WITH notes AS ({vault.NOTES}), c AS (SELECT path, len(regexp_extract_all(regexp_replace(text, '!\\[\\[[^\\]]+\\]\\]', '', 'g'), '\\[\\[([^\\]]+)\\]\\]')) AS wiki, len(list_distinct(regexp_extract_all(regexp_replace(text, '!\\[\\[[^\\]]+\\]\\]', '', 'g'), '\\[\\[([^\\]]+)\\]\\]'))) AS targets FROM notes)
SELECT path AS scope, '{{"file":"' || path || '","counts":{{"markdown_links":0,"wiki_links":' || wiki || ',"external_links":0,"unique_targets":' || targets || ',"total_links":' || wiki || '}}}}' AS json FROM c WHERE wiki > 0""")
def inventory_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The link inventory of each note as a JSON object."""
    per = links.wikilinks(vault.notes(spark, sf_dir)).groupBy(F.col("path").alias("scope")).agg(F.count("*").alias("wiki_links"), F.count_distinct("raw").alias("unique_targets"))
    zero = F.lit(0).cast("long")
    return reports.link_inventory_json(per.withColumns({"markdown_links": zero, "external_links": zero, "total_links": F.col("wiki_links")}))


@query("""WITH t AS (SELECT r_name AS scope, count(*) AS k FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1), s AS (SELECT sum(k)::BIGINT AS k, count(*) AS f FROM t)
SELECT 'link_inventory.md' AS path, sha256('# Link Inventory' || chr(10) || chr(10) || '- Root: `all`' || chr(10) || '- Files: ' || f || chr(10) || '- Total links: ' || k || chr(10) || '- Markdown links: 0' || chr(10) || '- Wiki links: ' || k || chr(10) || '- External links: 0' || chr(10) || '- Unique targets: ' || k || chr(10) || chr(10)
 || '## Directory Counts' || chr(10) || chr(10) || '| Directory | Files | Markdown | Wiki | External | Unique Targets | Total |' || chr(10) || '| --- | ---: | ---: | ---: | ---: | ---: | ---: |' || chr(10) || '| . | ' || f || ' | 0 | ' || k || ' | 0 | ' || k || ' | ' || k || ' |' || chr(10) || chr(10)
 || '## File Counts' || chr(10) || chr(10) || '| File | Markdown | Wiki | External | Unique Targets | Total |' || chr(10) || '| --- | ---: | ---: | ---: | ---: | ---: |' || chr(10) || (SELECT string_agg('| ' || scope || ' | 0 | ' || k || ' | 0 | ' || k || ' | ' || k || ' |', chr(10) ORDER BY scope) FROM t) || chr(10)) AS digest FROM s""")
def inventory_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The link inventory as one Markdown file, regions as files; by digest."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    zero = F.lit(0).cast("long")
    counted = nation.join(region, nation["n_regionkey"] == region["r_regionkey"]).groupBy(F.col("r_name").alias("scope")).agg(F.count("*").alias("k"))
    wide = lambda rows: rows.withColumns({"markdown_links": zero, "wiki_links": F.col("k"), "external_links": zero, "unique_targets": F.col("k"), "total_links": F.col("k")})
    total = counted.groupBy().agg(F.sum("k").alias("k"), F.count("*").alias("files"))
    out = reports.link_inventory(wide(counted), wide(total.withColumn("scope", F.lit("."))), wide(total.withColumn("scope", F.lit("all"))))
    return out.select("path", F.sha2("text", 256).alias("digest"))
