"""Queries over files that are made from the documents and read again, and over many patterns and course contents."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.operators import courses, many, rules
from foliospark.plans.registry import query, table
from foliospark.session import dealt
from foliospark.sinks import packages as pack
from foliospark.sinks import pdf as pdf_sink
from foliospark.sources import office, packages

_BLANKS = r"[ \t\n\x0B\f\r\x1c-\x1f\x85\xa0\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{1680}]+"


@query(rf"SELECT concat(doc_id, '.pdf') AS source, greatest(1, CAST(ceil(len(string_split(coalesce(text, ''), chr(10))) / {pdf_sink.PAGE_LINES}.0) AS INT)) AS pages, sha256(trim(regexp_replace(coalesce(text, ''), '{_BLANKS}', ' ', 'g'))) AS digest FROM documents")
def pdf_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written as PDF files, packed in four ways, and read again page by page; white space counts as one blank."""
    docs = dealt(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    way = F.element_at(F.array(*map(F.lit, pdf_sink.WAYS)), (F.pmod(F.xxhash64("doc_id"), F.lit(len(pdf_sink.WAYS))) + 1).cast("int"))
    files = pdf_sink.pdf_files(docs.select(F.concat("doc_id", F.lit(".pdf")).alias("path"), "text", way.alias("way")))
    pages = office.pdf_pages(files).groupBy("source").agg(F.count("*").cast("int").alias("pages"), F.array_sort(F.collect_list(F.struct("unit_no", "text"))).alias("p"))
    whole = F.array_join(F.transform("p", lambda x: x["text"]), "\n")
    return pages.select("source", "pages", F.sha2(F.trim(F.regexp_replace(whole, _BLANKS, " ")), 256).alias("digest"))


def _deck(key: int, words: list[str]) -> bytes:
    """A deck of two slides: shapes in nested groups, a table and a picture; then notes alone."""
    word = lambda k: words[k] if k < len(words) else ""
    inner = {"kind": "group", "x": 10, "y": 20, "ext": (40, 40), "child_off": (0, 0), "child_ext": (80, 20), "items": [{"kind": "text", "x": 8, "y": key % 9, "text": word(2)}]}
    group = {"kind": "group", "x": 1000 * (key % 3), "y": 100 * (key % 7), "ext": (400, 300), "child_off": (0, 10), "child_ext": (100, 100), "flip": key % 2 == 1, "items": [{"kind": "text", "x": 50, "y": 30, "text": word(1)}, inner]}
    grid = {"kind": "table", "x": 500, "y": 250, "rows": [[word(3), word(4)], ["", word(5)]]}
    first = [{"kind": "text", "x": 7, "y": 300, "text": word(0)}, group, grid, {"kind": "picture", "x": 1, "y": 2}]
    return pack.laid_deck([{"items": first, "notes": None}, {"items": [{"kind": "picture", "x": 0, "y": 0}], "notes": word(6) or None}])


@query(r"""WITH w AS (SELECT doc_id, [coalesce(x[i], '') FOR i IN range(1, 8)] AS w FROM (SELECT doc_id, coalesce(regexp_extract_all(text, '[A-Za-z]+'), []) AS x FROM documents)),
s AS (SELECT doc_id, unnest([{top: 300.0, lft: 7.0, pos: 0, t: w[1]}, {top: 100 * (doc_id % 7) + 3.0 * (30 - 10), lft: CASE WHEN doc_id % 2 = 1 THEN 1000 * (doc_id % 3) + 400 - 4.0 * 50 ELSE 1000 * (doc_id % 3) + 4.0 * 50 END, pos: 1, t: w[2]},
  {top: 100 * (doc_id % 7) + 3.0 * (20 + 2 * (doc_id % 9) - 10), lft: CASE WHEN doc_id % 2 = 1 THEN 1000 * (doc_id % 3) + 400 - 4.0 * (10 + 0.5 * 8) ELSE 1000 * (doc_id % 3) + 4.0 * (10 + 0.5 * 8) END, pos: 2, t: w[3]},
  {top: 250.0, lft: 500.0, pos: 3, t: array_to_string([x FOR x IN [array_to_string([x FOR x IN [w[4], w[5]] IF x <> ''], ' | '), w[6]] IF x <> ''], chr(10))}]) AS x FROM w),
f AS (SELECT doc_id, x.top AS top, x.lft AS lft, x.pos AS pos, x.t AS t FROM s WHERE x.t <> ''),
o AS (SELECT doc_id, t, min(row_number) AS nth FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY top, lft, pos) AS row_number FROM f) GROUP BY ALL),
j AS (SELECT doc_id, string_agg(t, chr(10) ORDER BY nth) AS text FROM o GROUP BY doc_id)
SELECT concat(doc_id, '.pptx') AS source, sha256(coalesce(text, '')) AS digest, (1 + (text IS NULL)::INT)::BIGINT AS blank_slides, 2::BIGINT AS media, (w[7] <> '')::BIGINT AS notes FROM w LEFT JOIN j USING (doc_id)""")  # fmt: skip
def deck_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decks made from all documents' words, with nested groups, tables, pictures and notes, read in the order of their places on the slide."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"path": batch["path"], "content": [_deck(int(k), list(w)) for k, w in zip(batch["key"], batch["words"], strict=True)]})

    start = F.regexp_extract("text", r"\A(?:[^A-Za-z]*+[A-Za-z]++){0,7}", 0)  # seven words are wanted, of texts of any length
    words = F.coalesce(F.regexp_extract_all(start, F.lit("[A-Za-z]+"), F.lit(0)), F.array().cast("array<string>"))
    docs = table(spark, sf_dir, "documents").select(F.concat("doc_id", F.lit(".pptx")).alias("path"), F.col("doc_id").alias("key"), words.alias("words"))
    shapes = packages.slide_shapes(dealt(docs, "key").mapInPandas(run, "path string, content binary"))
    found = packages.slide_counts(shapes, 1)
    return found.select("source", F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"), "blank_slides", "media", "notes")


_QUOTED = r"regexp_replace(array_to_string(string_split(text, ' ')[1:3], ' '), '([^\pL\pN ])', '\\\1', 'g')"


@query(rf"""WITH p AS (SELECT item_id AS id, {_QUOTED} AS regex FROM benchmark WHERE text IS NOT NULL), d AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1)::INT AS line_no FROM documents WHERE text IS NOT NULL)
SELECT doc_id::VARCHAR AS path, line_no, min(id)::VARCHAR AS message FROM d JOIN p ON regexp_matches(line, regex) GROUP BY ALL""")  # fmt: skip
def listed_openings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of all documents that hold the opening words of a passage: one pattern for each, all looked for in one scan."""
    opening = F.regexp_replace(F.array_join(F.slice(F.split("text", " "), 1, 3), " "), r"([^\p{L}\p{N} ])", r"\\$1")
    patterns = table(spark, sf_dir, "benchmark").where("text is not null").select(F.col("item_id").alias("id"), opening.alias("regex"))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), F.regexp_replace("text", "\r", " ").alias("text"))
    return rules.custom_residue(docs, patterns).select("path", "line_no", "message")


_TICK = "chr(96)"
_COURSE = f"""SELECT concat('c', doc_id % 50, '/', doc_id, '.md') AS path, doc_id, CASE WHEN doc_id % 11 = 0 THEN ' ' ELSE concat(regexp_replace(coalesce(text, ''), '[^A-Za-z .]+', ' '{{g}}), chr(10), chr(10),
 CASE doc_id % 7 WHEN 0 THEN concat('TODO ', {_TICK}, 'FIXME', {_TICK}) WHEN 1 THEN concat({_TICK}, 'TODO', {_TICK}, ' fine') WHEN 2 THEN concat('<<<<<<< a', chr(10), '=======', chr(10), '>>>>>>> b') WHEN 3 THEN concat('| a | b |', chr(10), '|---|---|', chr(10), '| 1 | 2 | 3 |', chr(10), '| x |')
 WHEN 4 THEN concat('$$', chr(10), 'x', chr(10), '$$', chr(10), '> $$') WHEN 5 THEN concat('~~~', chr(10), 'TODO', chr(10), '| a | b |') ELSE '- plain' END) END AS text FROM documents"""


@query(f"""WITH n AS ({_COURSE.format(g=", 'g'")}), k AS (SELECT *, 2 AS base FROM n WHERE doc_id % 11 <> 0)
SELECT 'empty_file' AS rule, path, 0 AS line_no FROM n WHERE doc_id % 11 = 0 UNION ALL SELECT 'template_residue', path, base + 1 FROM k WHERE regexp_matches(split_part(text, chr(10), 3), '^TODO')
UNION ALL SELECT 'conflict_marker', path, base + unnest([1, 2, 3]) FROM k WHERE contains(text, '<<<<<<<') UNION ALL SELECT 'broken_table', path, base + unnest([3, 4]) FROM k WHERE contains(text, '| 1 | 2 | 3 |')
UNION ALL SELECT 'unbalanced_math', path, 0 FROM k WHERE (len(string_split(text, '$$')) - 1) % 2 = 1 UNION ALL SELECT 'unbalanced_fence', path, 0 FROM k WHERE contains(text, chr(10) || '~~~')
UNION ALL SELECT 'generic_template_residue', path, 1 FROM k WHERE regexp_matches(split_part(text, chr(10), 1), '\\.\\.\\.') AND NOT regexp_matches(split_part(text, chr(10), 1), '^    ')""")  # fmt: skip
def course_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Left-overs, markers, fences, math, tables and emptiness of course notes that are made from all documents."""
    notes = spark.sql(_COURSE.format(g="").replace("FROM documents", "FROM {docs}"), docs=table(spark, sf_dir, "documents")).select("path", "text")
    return courses.content_issues(notes, strict=True).select("rule", "path", "line_no")


_ROUTE = """SELECT concat(s_suppkey, '.md') AS path, s_suppkey, concat('---', chr(10), 'aliases: [', CASE WHEN s_suppkey % 3 = 0 THEN 'RAG算法岗' ELSE 'x' END, ', y]', chr(10), 'tags:', chr(10), '  - ', CASE WHEN s_suppkey % 4 = 0 THEN 'a/Agent算法岗' ELSE 'b' END, chr(10), '---', chr(10),
 '| 方向 | ', CASE WHEN s_suppkey % 5 = 0 THEN '不能做' ELSE '能做' END, ' | 知识点 |', CASE WHEN s_suppkey % 2 = 0 THEN ' RAG |' ELSE '' END, chr(10), '|---|---|---|', chr(10), '| ', s_name, ' 方向 | AIGC算法岗 路线 | k |', chr(10), 'text of ', s_name) AS text FROM supplier"""


@query(f"""WITH n AS ({_ROUTE}), t AS (SELECT path, text, string_split(text, chr(10)) AS l FROM n)
SELECT 'legacy_route_name' AS rule, path, 0 AS line_no, 'RAG算法岗' AS message FROM t WHERE contains(l[2], 'RAG算法岗') UNION ALL SELECT 'legacy_route_name', path, 0, 'a/Agent算法岗' FROM t WHERE contains(l[4], 'Agent算法岗')
UNION ALL SELECT 'extra_matrix_category', path, 6, 'RAG' FROM t WHERE list_contains([trim(x) FOR x IN string_split(l[6], '|')], 'RAG') UNION ALL SELECT 'extra_route', path, 8, 'AIGC算法岗' FROM t WHERE contains(l[8], 'AIGC算法岗') AND NOT contains(string_split(l[6], '|')[3], '不能做')""")  # fmt: skip
def route_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Categories in matrix heads, routes in table columns that do not forbid them, and routes as aliases or tags."""
    notes = spark.sql(_ROUTE.replace("FROM supplier", "FROM {rows}"), rows=table(spark, sf_dir, "supplier")).select("path", "text")
    found = rules.all_of(courses.direction_values(notes), courses.matrix_headers(notes), courses.route_issues(notes))
    return found.select("rule", "path", "line_no", "message")


@query("WITH v AS (SELECT DISTINCT name[:4] AS id FROM vendors WHERE name <> '') SELECT id, doc_id FROM documents JOIN v ON contains(text, id)")
def vendor_openings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold the first letters of a vendor's name, all names looked for at once."""
    openings = table(spark, sf_dir, "vendors").where("name <> ''").select(F.substring("name", 1, 4).alias("text")).distinct()
    return many.containing(table(spark, sf_dir, "documents"), "doc_id", openings.select(F.col("text").alias("id"), "text"))
