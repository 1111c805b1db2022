"""Queries over course folders made from all documents: twelve documents are a course, each ended with a passage that rules look for.

``COURSES`` is the same statement in Spark and in the oracle; the oracles apply
the rules to its texts anew.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.operators import claims, courses, evidence, policies, rules
from foliospark.plans.registry import query, table

_NL, _BS, _TICK = "chr(10)", "chr(92)", "chr(96)"
_NAME = """CASE doc_id % 12
 WHEN 0 THEN CASE WHEN c % 4 = 3 THEN '07_补充.md' WHEN c % 3 = 1 THEN '00_学习地图.md' ELSE '00_课程总览.md' END
 WHEN 1 THEN CASE WHEN c % 5 = 2 THEN '08_其他.md' WHEN c % 2 = 0 THEN '知识点详细版_含公式.md' ELSE concat('课', c, '知识点详细版_含公式.md') END
 WHEN 2 THEN CASE WHEN c % 7 = 3 THEN '09_另.md' ELSE '知识点精简复习版_含公式.md' END
 WHEN 3 THEN CASE WHEN c % 11 = 5 THEN '03_章.md' ELSE 'source_manifest.md' END
 WHEN 4 THEN CASE WHEN c % 6 = 1 THEN '99_内容覆盖审查.md' ELSE '10_考试复习.md' END
 ELSE concat(lpad(CAST(doc_id % 12 AS VARCHAR(9)), 2, '0'), '_第', doc_id % 12, '章.md') END"""
_SOURCE = f"concat({_TICK}, 'src', doc_id % 9, '/d', doc_id - doc_id % 2, '.pdf', {_TICK})"
_TAIL = f"""CASE doc_id % 12
 WHEN 0 THEN CASE WHEN c % 2 = 0 THEN concat('## 复习', {_NL}, '[[知识点详细版_含公式]] and [x](知识点精简复习版_含公式.md#a) 完全解决所有问题。') ELSE concat({_TICK}, '[[知识点详细版_含公式]]', {_TICK}, ' and [[知识点精简复习版_含公式|短]]') END
 WHEN 1 THEN concat('TODO later', {_NL}, '系统应', {_TICK}, 'xxxxxxxx', {_TICK}, '保证所有请求成功。', {_NL}, '该方法显著提升了效果。该方法首次提出新结构。')
 WHEN 2 THEN concat('实验结果显著提升 3%。', {_NL}, '如果数据独立，则必然收敛。', {_NL}, '他们必然成功。')
 WHEN 3 THEN CASE WHEN c % 3 = 0 THEN '本课没有独立例题。' ELSE 'To complete' END
 WHEN 4 THEN concat('UNVERIFIED and UNVERIFIED', {_NL}, '代表页级公式：见')
 WHEN 5 THEN concat('## 第5讲页级补充', {_NL}, '- 页级证据：x', {_NL}, '正式页级来源：y', {_NL}, '2024 年 Lecture 3 的页级主线是 z')
 WHEN 6 THEN concat('$$ a ', {_BS}, {_BS}, 'theta = 1 $$ then $$ x', {_BS}, '$$ ', CASE WHEN c % 2 = 0 THEN '$$ open' ELSE '' END)
 WHEN 7 THEN concat({_NL}, '来源：', {_SOURCE}, {_NL}, CASE WHEN c % 2 = 0 THEN '第 3 页 page 3' ELSE concat({_NL}, 'page 3') END)
 WHEN 8 THEN concat({_NL}, {_TICK}, {_TICK}, {_TICK}, {_NL}, {_SOURCE}, {_NL}, {_TICK}, {_TICK}, {_TICK}, {_NL}, CASE WHEN c % 2 = 0 THEN '' ELSE concat('- see ', {_SOURCE}, ' slide 4', {_NL}) END, '<!-- ', {_TICK}, 'hidden.pdf', {_TICK}, ' -->')
 WHEN 9 THEN concat('## PPT/PDF 页级补充索引', {_NL}, '- 来源：', {_TICK}, 'a.pdf', {_TICK}, ' 页/slide：3 主题：x 源资料例题（/a）', {_NL}, '- bad bullet', {_NL}, '## End', {_NL}, '源资料例题 without', {_NL}, '补充题（/ x', {_NL}, '需复核')
 WHEN 10 THEN concat('解决的核心问题是什么？它和本课程前后章节的哪个概念最容易混淆？', {_NL}, '岗位方向：推荐、RAG算法岗', {_NL}, '不设置 Agent算法岗 方向', {_NL}, '量化算法岗 路线已删除；入口：量化算法岗')
 ELSE '' END"""
_HEAD = f"""CASE WHEN doc_id % 12 = 11 THEN concat('---', {_NL}, 'note_type: paper_note', {_NL}, 'direction: ', CASE c % 4 WHEN 0 THEN 'RL' WHEN 1 THEN '"embodied-ai"' WHEN 2 THEN 'cooking' ELSE 'p0' END, {_NL},
 CASE WHEN c % 3 = 0 THEN '' ELSE concat('source_files:', {_NL}, '  - "src', doc_id % 9, '/d', doc_id - doc_id % 2 - CASE WHEN c % 2 = 0 THEN 4 ELSE 2 END, '.pdf"', {_NL}) END, '---', {_NL}) ELSE '' END"""
COURSES = f"SELECT concat('c', c, '/', {_NAME}) AS path, concat({_HEAD}, text, {_NL}, {_TAIL}) AS text FROM (SELECT doc_id, coalesce(text, '') AS text, CAST(floor(doc_id / 12) AS BIGINT) AS c FROM documents) AS folio_d"
ENTRIES = "SELECT concat('src', (doc_id + 1) % 9, '/d', doc_id, '.pdf') AS root_relative FROM documents WHERE doc_id % 12 IN (6, 8) UNION ALL SELECT concat('src', doc_id % 9, '/d', doc_id, '.pdf') FROM documents WHERE doc_id % 24 = 8"


def _run(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    table(spark, sf_dir, "documents").createOrReplaceTempView("folio_documents")
    return spark.sql(sql.replace("FROM documents", "FROM folio_documents"))


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir, COURSES)


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir, ENTRIES)


_NOTES = f"WITH n AS ({COURSES}), e AS ({ENTRIES}), p AS (SELECT path, split_part(path, '/', 1) AS course, regexp_extract(path, '[^/]*$') AS name, regexp_replace(regexp_extract(path, '[^/]*$'), '\\.md$', '') AS stem, text FROM n), "
_LINES = "l AS (SELECT path, unnest(range(1, len(a) + 1))::INT AS line_no, unnest(a) AS line FROM (SELECT path, string_split_regex(text, '\\r\\n|\\r|\\n') AS a FROM n)) "
_DETAILED, _CONCISE = courses.DETAILED, courses.CONCISE


@query(_NOTES + rf"""
g AS (SELECT course, coalesce(min(path) FILTER (name = '00_课程总览.md'), min(path) FILTER (name = '00_学习地图.md'), min(path) FILTER (name LIKE '00\_%总览.md' ESCAPE '\')) AS overview,
  coalesce(min(path) FILTER (name = '{_DETAILED}'), min(path) FILTER (name LIKE '%{_DETAILED}')) AS detailed, coalesce(min(path) FILTER (name = '{_CONCISE}'), min(path) FILTER (name LIKE '%{_CONCISE}')) AS concise FROM p GROUP BY course),
z AS (SELECT p.*, overview, detailed, concise, len([x FOR x IN string_split(text, chr(10)) IF regexp_matches(x, '\S')]) AS k FROM p JOIN g USING (course)),
w AS (SELECT overview, unnest(CASE WHEN detailed IS NOT NULL AND concise IS NOT NULL THEN [regexp_extract(detailed, '[^/]*$'), regexp_extract(concise, '[^/]*$')] ELSE ['{_DETAILED}', '{_CONCISE}'] END) AS name FROM g WHERE overview IS NOT NULL),
v AS (SELECT path, regexp_replace(text, '`[^`]*`', '', 'g') AS text FROM z WHERE path = overview),
t AS (SELECT path, regexp_replace(unnest(regexp_extract_all(text, '\[\[([^\]|#]+)[^\]]*\]\]', 1) || regexp_extract_all(text, '\]\(([^)#]+)[^)]*\)', 1)), '\.md$', '') AS stem FROM v)
SELECT 'missing_overview' AS rule, course AS path, '00_课程总览.md' AS message FROM g WHERE overview IS NULL
UNION ALL SELECT 'missing_review_page', course, '{_DETAILED}' FROM g WHERE detailed IS NULL UNION ALL SELECT 'missing_review_page', course, '{_CONCISE}' FROM g WHERE concise IS NULL
UNION ALL SELECT 'missing_coverage_audit', course, 'audit' FROM p GROUP BY course HAVING NOT bool_or(contains(name, '覆盖审查')) UNION ALL SELECT 'missing_source_manifest', course, 'manifest' FROM p GROUP BY course HAVING NOT bool_or(contains(name, 'source_manifest'))
UNION ALL SELECT 'thin_detailed_review', path, k::VARCHAR FROM z WHERE path = detailed AND k < 9
UNION ALL SELECT 'thin_exam_review', path, k::VARCHAR FROM z WHERE contains(name, '考试复习') AND k < 12
UNION ALL SELECT 'thin_chapter_note', path, k::VARCHAR FROM z WHERE regexp_matches(name, '^[0-9][0-9]_.+\.md$') AND name NOT LIKE '00%' AND name NOT LIKE '99%' AND NOT contains(name, '考试复习') AND k < 6
UNION ALL SELECT 'missing_review_link', w.overview, w.name FROM w WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.path = w.overview AND t.stem || '.md' = w.name)
""")  # fmt: skip
def course_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overviews, review pages, audits, thin notes and review links of each course."""
    return courses.course_issues(notes(spark, sf_dir), strict_depth=True, require_audit=True, least=(6, 9, 12)).select("rule", "path", "message")


@query(_NOTES + _LINES.replace("FROM n)", "FROM (SELECT path, regexp_replace(text, '^---\\n(?s:.*?)\\n---\\n', '') AS text FROM n))") + r""",
c(message, pattern) AS (VALUES ('UNVERIFIED marker', '\bUNVERIFIED\b'), ('page-level supplement heading', '^#{1,6}\s+.*页级补充\s*$'), ('page-level evidence label', '^(?:\s*[-*]\s*)?(?:\*\*)?(?:页级证据|页级公式/边界证据)(?:\*\*)?\s*[:：]'),
  ('formal page-level source claim', '(?:^\s*(?:[-*]\s*)?正式页级来源\s*[:：]|20\d{2}\s*(?:年)?\s*正式页级来源(?:是|另见))'), ('page-level mainline claim', '(?:^\s*(?:[-*]\s*)?页级主线\s*[:：]|20\d{2}\s*(?:年)?\s*Lecture\s+\d+\s+的页级主线是)'),
  ('representative page-level claim', '代表页级(?:例子|公式)(?:/示例)?(?:是|见|\s*[:：])'))
SELECT 'audit_residue' AS rule, path, line_no, message FROM (SELECT path, line_no, message, unnest(regexp_extract_all(line, pattern)) FROM l, c WHERE path NOT LIKE '%/source_manifest.md')
UNION ALL SELECT 'pseudo_question', path, line_no, 'fixed pseudo-question' FROM l WHERE contains(line, '解决的核心问题是什么？它和本课程前后章节的哪个概念最容易混淆？')
UNION ALL SELECT 'legacy_audit', path, 1, 'forbidden legacy audit artifact' FROM p WHERE name = '99_内容覆盖审查.md'
""")  # fmt: skip
def audit_residue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit wording, pseudo-questions and legacy audits in ordinary notes."""
    return courses.audit_residue(notes(spark, sf_dir))


@query(_NOTES + r"""s AS (SELECT path, string_split(text, '$$') AS a FROM n WHERE contains(text, '$$')),
f AS (SELECT path, unnest(range(2, len(a) + 1, 2)) // 2 AS nth, unnest([a[i] FOR i IN range(2, len(a) + 1, 2)]) AS formula FROM s)
SELECT path, nth::INT AS line_no, 'double-escaped LaTeX command' AS message FROM f WHERE regexp_matches(formula, '\\\\(theta|frac|top|rightarrow|nabla|sum|prod|alpha|beta|lambda)')
UNION ALL SELECT path, nth::INT, 'dangling backslash' FROM f WHERE regexp_matches(formula, '\\\n?$') UNION ALL SELECT path, nth::INT, 'replacement character' FROM f WHERE contains(formula, chr(65533))
UNION ALL SELECT path, 0, 'unbalanced $$ delimiters' FROM s WHERE len(a) % 2 = 0""")  # fmt: skip
def formula_defects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Defects of block formulas, and odd delimiters."""
    return courses.formula_defects(notes(spark, sf_dir)).select("path", "line_no", "message")


@query(_NOTES + _LINES + r""", g AS (SELECT course, bool_or(name = 'source_manifest.md') AS listed, bool_or(name LIKE '00\_%' ESCAPE '\') AS mapped FROM p GROUP BY course)
SELECT 'missing_manifest' AS rule, course AS path, 0 AS line_no FROM g WHERE NOT listed UNION ALL SELECT 'missing_entry_map', course, 0 FROM g WHERE listed AND NOT mapped
UNION ALL SELECT 'scaffold_residue', path, line_no FROM l JOIN p USING (path) JOIN g USING (course) WHERE listed AND name <> 'source_manifest.md' AND regexp_matches(line, '(?i)status:\s*scaffold|待补充|TODO|To complete')
""")  # fmt: skip
def web_collections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifests, entry maps, detail notes and scaffold text of each folder."""
    return courses.web_collection_issues(notes(spark, sf_dir)).select("rule", "path", "line_no")


_PHRASES = ", ".join(f"('{p}')" for p in courses.LEGACY_ROUTES + courses.COMBINED_ROUTES)
_BEFORE, _AFTER = courses.REJECTED_BEFORE.replace("'", "''"), courses.REJECTED_AFTER


@query(_NOTES + _LINES + rf""", c(phrase) AS (VALUES {_PHRASES}),
o AS (SELECT path, line_no, phrase, string_split(line, phrase) AS a FROM l, c WHERE contains(line, phrase) AND regexp_matches(line, '(?i)岗位|方向|路线|入口|地图|矩阵|分类|主线|track|direction|route')),
x AS (SELECT path, line_no, phrase, unnest(range(1, len(a))) AS i, a FROM o)
SELECT DISTINCT path, line_no, phrase AS message FROM x WHERE NOT (regexp_matches(right(a[i], 32), '{_BEFORE}') OR regexp_matches(a[i + 1][:40], '{_AFTER}'))
""")  # fmt: skip
def extra_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Route lines with a category beside the nine directions."""
    return courses.route_issues(notes(spark, sf_dir)).select("path", "line_no", "message")


@query(_NOTES + r"""d AS (SELECT path, regexp_replace(regexp_extract(text, '^---\n(?s:.*?)\ndirection: ([^\n]*)\n', 1), '"', '', 'g') AS value FROM n WHERE text LIKE '---%'), m AS (SELECT *, regexp_replace(lower(value), '[\s/.-]+', '_', 'g') AS plain FROM d WHERE value <> '')
SELECT CASE WHEN plain IN ('rl', 'rag', 'gnn') THEN 'legacy_direction' ELSE 'unknown_direction' END AS rule, path, value AS message FROM m WHERE plain NOT IN ('embodied_ai', 'p0', 'cv', 'search')""")
def direction_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frontmatter directions that are legacy or unknown."""
    return courses.direction_values(notes(spark, sf_dir)).select("rule", "path", "message")


_REFS = r"r AS (SELECT path, line_no, unnest(regexp_extract_all(line, '`([^`]+\.(?:pdf|pptx?|PDF|PPTX?))`', 1)) AS ref FROM l) "


@query(_NOTES + _LINES + ", " + _REFS + r""", v AS (SELECT path, regexp_replace(regexp_replace(text, '(?s)\n```\n.*?\n```\n', chr(10), 'g'), '(?s)<!--.*?(?:-->|$)|%%.*?(?:%%|$)', ' ', 'g') AS shown FROM n),
k AS (SELECT path, line_no, regexp_matches(line, '^```') AS edge, sum(regexp_matches(line, '^```')::INT) OVER (PARTITION BY path ORDER BY line_no) AS fences FROM l)
SELECT r.path, r.line_no, r.ref FROM r JOIN v USING (path) JOIN k ON k.path = r.path AND k.line_no = r.line_no WHERE fences % 2 = 0 AND contains(shown, ref)""")  # fmt: skip
def visible_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Backticked sources outside code blocks and comments."""
    return evidence.visible_references(notes(spark, sf_dir)).select("path", "line_no", "ref")


_BLOCKS = _NOTES + _LINES + r""",
m AS (SELECT *, sum(regexp_matches(line, '^```')::INT) OVER (PARTITION BY path ORDER BY line_no) AS fences, regexp_matches(line, '^```') AS edge FROM l),
b AS (SELECT path, line_no, line, edge OR fences % 2 = 1 OR NOT regexp_matches(line, '\S') AS blank, regexp_matches(trim(line), '^\|.*|^[^|]*\|$|\|$|^#{1,6}(\s|$)') AND (contains(line, '|') OR regexp_matches(line, '^#')) AS alone, regexp_matches(trim(line), '^(?:[-+*]|[0-9]{1,9}[.)])(?:\s|$)') AS item FROM m),
s AS (SELECT *, (alone OR item OR coalesce(lag(blank) OVER w, true) OR coalesce(lag(alone) OVER w, true))::INT AS starts FROM b WINDOW w AS (PARTITION BY path ORDER BY line_no)),
u AS (SELECT *, sum(starts) OVER (PARTITION BY path ORDER BY line_no) AS nth FROM s WHERE NOT blank),
bl AS (SELECT path, nth, min(line_no) AS line_no, string_agg(line, chr(10) ORDER BY line_no) AS block FROM u GROUP BY path, nth)
"""


@query(_BLOCKS + "SELECT path, line_no, sha256(block) AS digest FROM bl")
def evidence_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence units of every note, by digest."""
    return evidence.evidence_blocks(notes(spark, sf_dir)).select("path", "line_no", F.sha2("block", 256).alias("digest"))


@query(_BLOCKS + r""", q AS (SELECT DISTINCT path, unnest(regexp_extract_all(block, '[\p{L}\p{N}_/.\-]+')) AS source FROM bl WHERE regexp_matches(block, '(?i)(?:页\s*/?\s*slide|slide|page|p\.)\s*[:：]?\s*\d+|页\s*[:：]?\s*\d+')) SELECT path, source FROM q WHERE source IN (SELECT root_relative FROM e)""")
def page_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources whose path stands beside a page in one block."""
    return evidence.page_evidence(notes(spark, sf_dir), entries(spark, sf_dir))


@query(_NOTES + r"q AS (SELECT DISTINCT path, unnest(regexp_extract_all(text, '[\p{L}\p{N}_/.\-]+')) AS source FROM n) SELECT path, source FROM q WHERE source IN (SELECT root_relative FROM e)")
def source_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources whose path stands in a note, delimited."""
    return evidence.mentions(notes(spark, sf_dir), entries(spark, sf_dir))


@query(_NOTES + _LINES + ", " + _REFS + ", o AS (SELECT DISTINCT path, line_no FROM l WHERE regexp_matches(line, '来源：|来源:|对应源资料|对应源课件|源资料：|源课件：')) SELECT path, line_no, ref AS message FROM r JOIN o USING (path, line_no) WHERE ref IN (SELECT root_relative FROM e) AND NOT contains(path, 'c1')")
def owner_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Owner lines that name a source which is not the note's own; courses whose name starts with c1 own all."""
    rows = notes(spark, sf_dir).select("path", "text")
    allowed = rows.where("contains(path, 'c1')").select("path", F.explode(F.regexp_extract_all("text", F.lit(evidence.SOURCE_REF), F.lit(1))).alias("source"))
    return evidence.owner_conflicts(rows, entries(spark, sf_dir), allowed).select("path", "line_no", "message")


@query(_NOTES + r"""f AS (SELECT path, regexp_extract_all(text, '(?m)^  - "(src[^"]*)"$', 1) AS a FROM n WHERE regexp_matches(text, '^---\nnote_type: paper_note\n')), g AS (SELECT path, unnest(a) AS source FROM f)
SELECT 'paper_source_missing' AS rule, path, 'no source_files' AS message FROM f WHERE len(a) = 0 UNION ALL SELECT 'paper_source_not_found', path, source FROM g WHERE source NOT IN (SELECT root_relative FROM e)""")
def paper_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paper notes without sources or with sources that do not exist."""
    return evidence.paper_sources(notes(spark, sf_dir), entries(spark, sf_dir)).select("rule", "path", "message")


@query(_NOTES + _LINES + r""", h AS (SELECT *, last_value(CASE WHEN line LIKE '## %' THEN trim(line) END IGNORE NULLS) OVER (PARTITION BY path ORDER BY line_no) AS section FROM l WHERE path NOT LIKE '%/source_manifest.md' AND path NOT LIKE '%/99\_%' ESCAPE '\'),
x AS (SELECT *, coalesce(section = '## PPT/PDF 页级补充索引', false) AND line LIKE '- %' AS bullet, contains(line, '源资料例题') OR contains(line, '源课件例题') AS labelled, contains(line, '生成：PPT/PDF 未提供独立可抽取例题') AS generated, regexp_matches(line, '^\s*#') AS head FROM h WHERE line NOT LIKE '## %'),
s AS (SELECT regexp_replace(path, '/[^/]*$', '') AS dir, bool_or(labelled OR generated OR contains(line, '生成辅助题') OR contains(line, '补充题（/') OR regexp_matches(line, '(?i)例题|例子|练习|worked example')) AS speaks FROM x GROUP BY 1),
k AS (SELECT regexp_replace(path, '/[^/]*$', '') AS dir FROM l WHERE path LIKE '%/source_manifest.md' OR path LIKE '%/99\_%' ESCAPE '\' GROUP BY 1 HAVING bool_or(contains(line, '没有独立')) AND bool_or(contains(line, '例题')))
SELECT 'bad_supplement_fields' AS rule, path, line_no FROM x WHERE bullet AND NOT (contains(line, '来源：`') AND contains(line, '页/slide：') AND contains(line, '主题：'))
UNION ALL SELECT 'bad_supplement_example', path, line_no FROM x WHERE bullet AND NOT ((labelled AND (contains(line, '（/') OR contains(line, '来源：`') OR contains(line, '源资料：`') OR head)) OR (generated AND (contains(line, '补充题（/') OR contains(line, '来源说明') OR head)))
UNION ALL SELECT 'bad_source_example', path, line_no FROM x WHERE labelled AND NOT head AND NOT contains(line, '（/') AND NOT contains(line, '源资料：`')
UNION ALL SELECT 'bad_generated_example', path, line_no FROM x WHERE (contains(line, '生成辅助题') OR contains(line, '补充题（/')) AND NOT generated AND NOT labelled
UNION ALL SELECT 'residual_manual_review_marker', path, line_no FROM x WHERE regexp_matches(line, '需复核|人工确认|人工打开|手动打开')
UNION ALL SELECT 'no_example_evidence', dir, 0 FROM s WHERE NOT speaks AND dir NOT IN (SELECT dir FROM k)""")  # fmt: skip
def example_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Example and supplement lines without their evidence, and folders without any."""
    return evidence.example_evidence(notes(spark, sf_dir)).select("rule", "path", "line_no")


@query("WITH s AS (SELECT DISTINCT source FROM documents), n AS (SELECT DISTINCT concat('src', c_custkey % 13) AS source FROM customer) SELECT 'src1' AS source_dir, 'notes1' AS notes_dir UNION ALL SELECT s.source, s.source FROM s JOIN n USING (source) WHERE s.source NOT IN ('src1', 'src2')")
def sibling_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources of documents that customers' folders share a name with; one pair is given, one folder ignored."""
    sources = table(spark, sf_dir, "documents").select(F.concat("source", F.lit("/d.pdf")).alias("path"))
    there = table(spark, sf_dir, "customer").select(F.concat(F.lit("src"), F.col("c_custkey") % 13, F.lit("/n.md")).alias("path"))
    return courses.sibling_mapping(sources, there, spark.createDataFrame([("src1", "notes1")], "source_dir string, notes_dir string"), ["src2"])


_PATHS = "SELECT concat(p_brand, '/', CASE WHEN p_partkey % 3 = 0 THEN upper(p_name) ELSE p_name END, CASE WHEN p_partkey % 5 = 0 THEN 'e\u0301' ELSE '\u00e9' END) AS path FROM part"


@query(f"WITH f AS (SELECT DISTINCT path, lower(nfc_normalize(path)) AS key FROM ({_PATHS})) SELECT key, count(*) AS paths, min(path) AS first_path, max(path) AS last_path FROM f GROUP BY key HAVING count(*) > 1")
def path_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths of parts that differ in case or composition only."""
    table(spark, sf_dir, "part").createOrReplaceTempView("folio_part")
    return courses.path_collisions(spark.sql(_PATHS.replace("FROM part", "FROM folio_part")))


@query("WITH u AS (SELECT concat('n', o_orderkey % 97) AS path, 0 AS k FROM orders UNION ALL SELECT concat('n', c_custkey % 101), 1 FROM customer UNION ALL SELECT concat('n', s_suppkey), 2 FROM supplier) SELECT path, count(DISTINCT k) AS listings FROM u GROUP BY path")
def merged_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct paths of three listings with the number that hold each."""
    orders, customer, supplier = (table(spark, sf_dir, t) for t in ("orders", "customer", "supplier"))
    name = lambda c: F.concat(F.lit("n"), c).alias("path")
    return courses.merged_listings(orders.select(name(F.col("o_orderkey") % 97)), customer.select(name(F.col("c_custkey") % 101)), supplier.select(name(F.col("s_suppkey"))))


@query("SELECT CASE WHEN p_partkey % 2 = 0 THEN 'unsafe_symlink' ELSE 'outside_root' END AS rule, p_name || p_partkey AS path FROM part WHERE p_partkey % 5 = 0")
def symlink_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links in a listing made from parts."""
    part = table(spark, sf_dir, "part").select(F.concat("p_name", F.col("p_partkey").cast("string")).alias("path"), (F.col("p_partkey") % 5 == 0).alias("is_link"), (F.col("p_partkey") % 2 == 0).alias("target_inside"))
    return courses.symlink_issues(part).select("rule", "path")


_CLAIM_TERMS = "首次提出|必然|完全|解决|保证|显著提升"


def _sql(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


_CLAIMS = (_NOTES + _LINES + rf""",
v AS (SELECT path, line_no, regexp_replace(line, '`([^`]*)`', repeat(' ', length(regexp_extract(line, '`[^`]*`'))), 'g') AS prose FROM l WHERE NOT regexp_matches(path, '(?i)(^|/)99_|source_manifest') AND NOT regexp_matches(line, '^\s*(#|```)')),
w AS (SELECT path, line_no, regexp_replace(regexp_replace(prose, '\[\[[^\]|]*\|([^\]]*)\]\]', ' \1 ', 'g'), '\[\[([^\]|]*)\]\]', ' \1 ', 'g') AS prose FROM v),
o AS (SELECT path, line_no, prose, unnest(regexp_extract_all(prose, '{_CLAIM_TERMS}')) AS term, unnest(regexp_split_to_array(prose, '{_CLAIM_TERMS}')[:len(regexp_extract_all(prose, '{_CLAIM_TERMS}'))]) AS piece, unnest(range(1, 1 + len(regexp_extract_all(prose, '{_CLAIM_TERMS}')))) AS i FROM w WHERE regexp_matches(prose, '{_CLAIM_TERMS}')),
a AS (SELECT *, sum(length(piece) + length(term)) OVER (PARTITION BY path, line_no ORDER BY i)::BIGINT - length(term) AS spot FROM o),
t AS (SELECT *, substr(prose, 1, spot) AS before, substr(prose, spot + length(term) + 1) AS after, substr(prose, greatest(spot - 2, 0) + 1, spot - greatest(spot - 2, 0) + length(term) + 12) AS near, substr(prose, greatest(spot - 20, 0) + 1, spot - greatest(spot - 20, 0) + length(term) + 16) AS around FROM a),
s AS (SELECT *, trim(regexp_extract(before, '[^。！？]*$') || term || regexp_extract(after, '^[^。！？]*[。！？]?')) AS sentence FROM t),
k AS (SELECT *, CASE WHEN regexp_matches(sentence, {_sql(claims.LABEL_CELL)}) THEN 'LABEL_OR_SCHEMA' WHEN regexp_matches(sentence, {_sql(claims.ASKED)}) THEN 'QUESTION_OR_QUOTE' WHEN regexp_matches(sentence, {_sql(claims.NEGATED)}) THEN 'NEGATED_GUARANTEE'
  WHEN regexp_matches(sentence, {_sql(claims.CONDITIONAL)}) THEN 'CONDITIONAL_GUARANTEE' WHEN regexp_matches(sentence, {_sql(claims.FORMAL + '|' + claims.FORMAL_NOUN + '|' + claims.CERTAIN_BY_DEFINITION)}) THEN 'FORMAL_GUARANTEE' WHEN regexp_matches(sentence, {_sql(claims.DEPENDS)}) THEN 'CONDITIONAL_GUARANTEE'
  WHEN regexp_matches(sentence, {_sql(claims.LEGAL)}) THEN 'POLICY_OR_LEGAL_CLAIM' WHEN regexp_matches(sentence, {_sql(claims.HEDGED)}) THEN CASE WHEN regexp_matches(sentence, {_sql(claims.UNIVERSAL)}) THEN 'ENGINEERING_PROMISE' ELSE 'MANUAL_REVIEW' END
  WHEN term IN ('首次提出', '显著提升') THEN 'EMPIRICAL_OVERCLAIM' ELSE 'ENGINEERING_PROMISE' END AS category FROM s)
SELECT DISTINCT path, line_no, term, sentence, category FROM k WHERE category IN ('POLICY_OR_LEGAL_CLAIM', 'ENGINEERING_PROMISE', 'EMPIRICAL_OVERCLAIM', 'MANUAL_REVIEW')
 AND NOT (term = '完全' AND (regexp_matches(before, '[不非没]$') OR regexp_matches(after, '^[不无]') OR NOT regexp_matches(near, {_sql(claims.COMPLETE_PERFORMANCE)}) OR regexp_matches(around, {_sql(claims.COMPLETE_TECHNICAL)})))
 AND NOT (term = '保证' AND (regexp_matches(right(before, 4), {_sql(claims.PRESCRIBED)}) OR regexp_matches(sentence, {_sql(claims.FORMAL_NOUN)}) OR after LIKE '金%'))
 AND NOT (term = '必然' AND regexp_matches(sentence, {_sql(claims.CERTAIN_BY_DEFINITION)}))
 AND NOT (term = '解决' AND (regexp_matches(sentence, {_sql(claims.TARGET_OF_WORK)}) OR NOT regexp_matches(sentence, {_sql(claims.BROAD_SOLUTION)})))
 AND NOT (term IN ('首次提出', '显著提升') AND regexp_matches(sentence, {_sql(claims.EVIDENCE)}))
""")  # fmt: skip


@query(_CLAIMS)
def course_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Absolute claims of all course notes with their category."""
    found = claims.audit(claims.prose_lines(notes(spark, sf_dir)))
    return found.select("path", "line_no", "term", "sentence", "category")


@query("SELECT path, line_no, term, sentence FROM (" + _CLAIMS + rf""") WHERE NOT regexp_matches(sentence, {_sql(f"[?？]|{claims.NEGATED}|{claims.CONDITIONAL}")}) AND CASE WHEN term IN ('首次提出', '显著提升') THEN NOT regexp_matches(sentence, {_sql(claims.EVIDENCE)})
 WHEN term = '必然' THEN NOT regexp_matches(sentence, {_sql(claims.CERTAIN_WITH_GROUNDS)}) WHEN term = '完全' THEN NOT regexp_matches(sentence, {_sql(claims.COMPLETE_DENIED)}) AND regexp_matches(sentence, {_sql(claims.COMPLETE_BOLD)})
 WHEN term = '解决' THEN regexp_matches(sentence, {_sql(claims.SOLVES_BOLD)}) ELSE NOT regexp_matches(sentence, {_sql(claims.ASSURED_WITH_GROUNDS)}) AND regexp_matches(sentence, {_sql(claims.ASSURED_BOLD)}) END""")  # fmt: skip
def confident_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims of the course notes that a strict gate refuses."""
    return claims.audit(claims.prose_lines(notes(spark, sf_dir))).where("high_confidence").select("path", "line_no", "term", "sentence")


@query("SELECT category, count(*) AS n FROM (" + _CLAIMS + ") GROUP BY category")
def claim_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims of the course notes by category."""
    return claims.counts(claims.audit(claims.prose_lines(notes(spark, sf_dir)))).select("category", "n")


@query(_NOTES + _LINES + " SELECT path, line_no, regexp_extract(line, '(?i)在此填写|TODO|FIXME|待补充|<待填写>') AS message FROM l WHERE regexp_matches(line, '(?i)在此填写|TODO|FIXME|待补充|<待填写>')")
def placeholders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with a placeholder, the first of the line."""
    return rules.residue(notes(spark, sf_dir), rules.PLACEHOLDER, "placeholder").select("path", "line_no", "message")


@query(_NOTES.rstrip(", ") + r" SELECT path, regexp_extract(text, '^---\nnote_type: ([a-z_]+)\n', 1) AS note_type FROM n WHERE text LIKE '---%'")
def declared_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes with exactly one declared type."""
    rows = notes(spark, sf_dir).select("path", policies.declared_type(F.col("text")).alias("note_type"))
    return rows.where("note_type is not null")
