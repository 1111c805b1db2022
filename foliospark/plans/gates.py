"""Queries of the core gate over all documents: each becomes a note with frontmatter, a place in a folder and a last passage that rules look for.

``NOTES`` is the same statement in Spark and in the oracle, which applies the
rules to its texts anew.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.operators import gate, links, policies
from foliospark.plans.registry import query, table

_NL, _TICK = "chr(10)", "chr(96)"
_FENCE = f"concat({_TICK}, {_TICK}, {_TICK})"
_PAIR = "CAST(floor(doc_id / 34) AS BIGINT)"
_PATH = f"CASE WHEN doc_id % 34 IN (3, 20) THEN concat('u', doc_id, '/s', {_PAIR}, '.md') WHEN doc_id % 50 = 7 THEN concat('agent/', doc_id, '.md') ELSE concat('v', doc_id % 5, '/', doc_id, '.md') END"
_TAIL = f"""CASE doc_id % 8
 WHEN 1 THEN concat({_FENCE}, {_NL}, 'TODO in code', {_NL}, {_FENCE}, {_NL}, 'TBD here and TODO there', CASE WHEN doc_id % 3 = 0 THEN concat({_NL}, '    TODO set in') ELSE '...' END)
 WHEN 2 THEN concat('| --- | 解析：', doc_id, ' |', {_NL}, '|---| none |', {_NL}, '| a | 解析：x |')
 WHEN 3 THEN CASE WHEN doc_id % 3 = 0 THEN concat('<<<<<<< a', doc_id) WHEN doc_id % 3 = 1 THEN concat('=======', {_NL}, '>>>>>>> b') ELSE '======= alone' END
 WHEN 4 THEN CASE WHEN doc_id % 3 = 0 THEN '$$ x = 1' ELSE concat('$$ x $$ and ', {_TICK}, '$$', {_TICK}) END
 WHEN 5 THEN concat({_FENCE}, 'python', {_NL}, 'a = 1', {_NL}, 'print((', doc_id, CASE WHEN doc_id % 3 = 0 THEN '))' ELSE ')' END, {_NL}, {_FENCE})
 WHEN 6 THEN concat('bell', chr(7), {_NL}, CASE WHEN doc_id % 3 = 0 THEN {_FENCE} ELSE '' END)
 WHEN 7 THEN concat('[[', doc_id, ']] [[', doc_id + 1, '|next]] and [[s', {_PAIR}, ']]', CASE WHEN doc_id % 3 = 0 THEN ' [[nowhere]]' ELSE '' END)
 ELSE '' END"""
_HEAD = f"CASE doc_id % 6 WHEN 1 THEN concat('---', {_NL}, 'note_type: course_note', {_NL}, '---', {_NL}) WHEN 2 THEN concat('---', {_NL}, 'note_type: paper_note', {_NL}, '---', {_NL}) WHEN 3 THEN concat('---', {_NL}, 'note_type: review_detailed', {_NL}, '---', {_NL}) ELSE '' END"
NOTES = f"SELECT doc_id, {_PATH} AS path, CASE WHEN doc_id % 97 = 0 THEN concat({_NL}, ' ') ELSE concat({_HEAD}, coalesce(text, ''), {_NL}, {_TAIL}) END AS text FROM documents"

_SQL = rf"""WITH n AS ({NOTES}),
l AS (SELECT doc_id, path, unnest(range(1, len(a) + 1))::INT AS line_no, unnest(a) AS line FROM (SELECT doc_id, path, string_split_regex(text, '\r\n|\r|\n') AS a FROM n)),
f AS (SELECT *, regexp_matches(line, '^ {{0,3}}(```|~~~)') AS fence, sum(regexp_matches(line, '^ {{0,3}}(```|~~~)')::INT) OVER (PARTITION BY path ORDER BY line_no) AS fences FROM l),
v AS (SELECT doc_id, path, line_no, line AS raw, CASE WHEN fence OR fences % 2 = 1 OR regexp_matches(line, '^(    |\t)') THEN '' ELSE regexp_replace(line, '`[^`]*`', '', 'g') END AS line FROM f),
w AS (SELECT doc_id, path, string_agg(line, chr(10) ORDER BY line_no) AS prose FROM v GROUP BY doc_id, path),
b AS (SELECT n.doc_id, n.path, text, prose, length(regexp_replace(regexp_replace(prose, '^---\nnote_type: [a-z_]+\n---\n', ''), '\s', '', 'g')) AS size,
  CASE regexp_extract(text, '^---\nnote_type: ([a-z_]+)\n', 1) WHEN 'course_note' THEN 600 WHEN 'paper_note' THEN 2500 WHEN 'review_detailed' THEN 5000 END AS least,
  (length(text) - length(replace(text, '```', ''))) // 3 AS marks, (length(prose) - length(replace(prose, '$$', ''))) // 2 AS maths FROM n JOIN w USING (doc_id, path)),
k AS (SELECT path, trim(string_split(raw, '|')[1]) AS target, trim(raw) AS raw FROM (SELECT path, unnest(regexp_extract_all(prose, '\[\[([^\]]+)\]\]', 1)) AS raw FROM w)),
h AS (SELECT regexp_extract(path, '([^/]*)\.md$', 1) AS target, count(DISTINCT path) AS hits, min(path) AS hit FROM n GROUP BY ALL),
s AS (SELECT DISTINCT path AS beside FROM n),
r AS (SELECT k.path, raw, CASE WHEN beside = k.path THEN 'self' WHEN beside IS NOT NULL THEN 'ok' WHEN hits IS NULL THEN 'broken' WHEN hits > 1 THEN 'ambiguous' WHEN hit = k.path THEN 'self' ELSE 'ok' END AS status
  FROM k LEFT JOIN h USING (target) LEFT JOIN s ON beside = regexp_extract(k.path, '^(.*/)', 1) || target || '.md'),
g AS (SELECT 'empty_file' AS rule, path, 0 AS line_no, 'no content' AS message FROM b WHERE NOT regexp_matches(text, '\S')
UNION ALL SELECT 'conflict_marker', path, 0, 'possible conflict marker' FROM b WHERE contains(text, '<<<<<<<') OR (contains(text, '=======') AND contains(text, '>>>>>>>'))
UNION ALL SELECT 'unbalanced_fence', path, 0, marks::VARCHAR FROM b WHERE marks % 2 = 1
UNION ALL SELECT 'unbalanced_math', path, 0, maths::VARCHAR FROM b WHERE maths % 2 = 1
UNION ALL SELECT 'control_character', path, 0, 'control character' FROM b WHERE regexp_matches(text, '[\x00-\x08\x0b\x0c\x0e-\x1f]')
UNION ALL SELECT 'shallow_note', path, 0, size || ' of ' || least FROM b WHERE size < least
UNION ALL SELECT 'residue', path, line_no, unnest(regexp_extract_all(line, '{gate.RESIDUE}')) FROM v WHERE path NOT LIKE 'agent/%'
UNION ALL SELECT 'table_separator', path, line_no, '解析：' FROM v WHERE regexp_matches(raw, '^(\|---|\| ---|\| --)') AND contains(raw, '解析：')
UNION ALL SELECT 'invalid_python', path, line_no, 'syntax' FROM v WHERE starts_with(raw, 'print((') AND NOT ends_with(raw, '))')
UNION ALL SELECT status || '_link', path, 0, raw FROM r WHERE status <> 'ok')"""  # fmt: skip


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    table(spark, sf_dir, "documents").createOrReplaceTempView("folio_documents")
    made = spark.sql(NOTES.replace("FROM documents", "FROM folio_documents"))
    return made.select("path", "text", policies.declared_type(F.col("text")).alias("note_type"))


def _gate(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    rows = notes(spark, sf_dir)
    resolved = links.resolve_wikilinks(links.wikilinks(rows), rows.select("path"))
    return rows, gate.core_gate(rows, resolved), resolved


@query(_SQL + " SELECT rule, path, line_no, message FROM g")
def vault_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every issue of the core gate; of a Python block's error the place, as its wording is the interpreter's."""
    _, issues, _ = _gate(spark, sf_dir)
    return issues.withColumn("message", F.when(F.col("rule") == "invalid_python", "syntax").otherwise(F.col("message")))


@query(_SQL + " SELECT (SELECT count(*) FROM n) AS notes, (SELECT count(*) FROM r) AS checked_links, (SELECT count(*) FROM r WHERE status = 'broken') AS broken_links, (SELECT count(*) FROM r WHERE status = 'ambiguous') AS ambiguous_links, (SELECT count(*) FROM r WHERE status = 'self') AS self_links, (SELECT count(*) FROM g) AS core_issues, (SELECT count(*) FROM g) = 0 AS passed")
def gate_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gate's verdict with its counts."""
    return gate.summary(*_gate(spark, sf_dir))
