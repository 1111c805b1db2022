"""Queries of the text and URL scalars over columns of the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.functions import text as T
from foliospark.functions import urls
from foliospark.operators import classify, coverage, frontmatter, links
from foliospark.plans import vault
from foliospark.plans.registry import query, table


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


_D = "(SELECT doc_id, coalesce(text, '') AS text FROM documents)"


@query(f"WITH notes AS ({vault.NOTES}) SELECT path, coalesce(nullif(trim(regexp_extract(text, '(?m)^# (.*)$', 1)), ''), regexp_replace(regexp_extract(path, '[^/]*$'), '\\.md$', '')) AS title FROM notes")
def note_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The title of each note."""
    stem = F.regexp_replace(F.substring_index("path", "/", -1), r"\.md$", "")
    return vault.notes(spark, sf_dir).select("path", T.note_title(F.col("text"), stem).alias("title"))


@query(f"""WITH c AS (SELECT doc_id, regexp_replace(trim(regexp_replace(regexp_replace(CASE doc_id % 4 WHEN 0 THEN 'con' WHEN 1 THEN ' : ' ELSE text END, '[<>:"/\\\\|?*\\x00-\\x1f]', ' ', 'g'), '[\\s\\x{{A0}}\\x{{3000}}]+', ' ', 'g')), '[. ]+$', '') AS v FROM {_D}),
k AS (SELECT doc_id, regexp_replace(substr(v, 1, 80), '[. ]+$', '') AS v FROM c) SELECT doc_id, CASE WHEN v = '' THEN 'untitled' WHEN lower(v) = 'con' THEN '_' || v ELSE v END AS name FROM k""")
def safe_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Portable file names of documents."""
    raw = F.when(F.col("doc_id") % 4 == 0, "con").when(F.col("doc_id") % 4 == 1, " : ").otherwise(F.col("text"))
    return _docs(spark, sf_dir).select("doc_id", T.safe_name(raw).alias("name"))


@query(f"""WITH r AS (SELECT doc_id, string_split(text, chr(10))[1] || ' | ' || chr(92) || '_' || chr(92) || '* a' || chr(92) || 'b' AS v FROM {_D}), c AS (SELECT doc_id, v, trim(regexp_replace(v, '[\\s\\x{{A0}}\\x{{3000}}]+', ' ', 'g')) AS w FROM r)
SELECT doc_id, replace(replace(w, chr(92), chr(92) || chr(92)), '|', chr(92) || '|') AS cell, regexp_replace(v, '\\\\([!-/:-@\\[-`{{-~])', '\\1', 'g') AS plain FROM c""")
def table_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First lines as table cells, and with their backslash escapes resolved."""
    raw = F.concat(F.split("text", "\n")[0], F.lit(r" | \_\* a\b"))
    return _docs(spark, sf_dir).select("doc_id", T.table_cell(raw).alias("cell"), T.unescaped(raw).alias("plain"))


@query(f"WITH m AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN text || chr(7) || chr(65533) || chr(127) ELSE text END AS v FROM {_D}) SELECT doc_id, CASE WHEN length(v) = 0 THEN 0 ELSE round(length(regexp_replace(v, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f\\x{{fffd}}]', '', 'g')) / length(v), 9) END AS ratio, regexp_matches(v, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]') AS control FROM m")
def printable_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Printable share of documents, a third of which get control and replacement characters, and whether one holds a control character."""
    v = F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit("\x07�\x7f"))).otherwise(F.col("text"))
    return _docs(spark, sf_dir).select("doc_id", F.round(T.printable_ratio(v), 9).alias("ratio"), T.has_control(v).alias("control"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 101 = 100 THEN -1 ELSE (p_partkey % 101)::INT END AS number FROM part")
def chinese_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numerals of 0 to 99, written from keys, read again; 百 is none."""
    n = F.col("p_partkey") % 101
    digit = lambda k: F.element_at(F.array(*map(F.lit, "零一二三四五六七八九")), (k + 1).cast("int"))
    tens, ones = F.floor(n / 10), n % 10
    shown = F.when(n == 100, "百").when(n < 10, digit(n)).otherwise(F.concat(F.when(tens > 1, digit(tens)).otherwise(""), F.lit("十"), F.when(ones > 0, digit(ones)).otherwise("")))
    return table(spark, sf_dir, "part").select("p_partkey", F.coalesce(T.chinese_number(shown), F.lit(-1)).alias("number"))


@query("SELECT p_partkey, (CASE WHEN p_partkey % 3 = 0 THEN (p_partkey % 7 // 4 + 1) * 4 ELSE p_partkey % 7 END + p_partkey % 5)::INT AS indent FROM part")
def indents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns of leading blanks and tabs."""
    key = F.col("p_partkey")
    blanks = lambda n: F.repeat(F.lit(" "), n.cast("int"))
    line = F.concat(blanks(key % 7), F.when(key % 3 == 0, "\t").otherwise(""), blanks(key % 5), F.lit("x y"))
    return table(spark, sf_dir, "part").select("p_partkey", T.indent_columns(line).alias("indent"))


@query("SELECT p_partkey, concat_ws('.', p_size, p_partkey % 10, p_partkey % 3) AS version, (p_size, p_partkey % 10, p_partkey % 3) >= (20, 5, 1) AS recent FROM part")
def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Version numbers read from tags, against a least one."""
    key = F.col("p_partkey")
    parts = T.version_parts(F.concat(F.lit("v"), F.concat_ws(".", "p_size", key % 10, key % 3), F.lit("-rc1")))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(parts.cast("array<string>"), ".").alias("version"), (parts >= F.array(F.lit(20), F.lit(5), F.lit(1))).alias("recent"))


@query("WITH d AS (SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN CAST(o_orderdate AS DATE)::VARCHAR WHEN 1 THEN '2023-' || lpad((o_orderkey % 14)::VARCHAR, 2, '0') || '-' || lpad((o_orderkey % 33)::VARCHAR, 2, '0') WHEN 2 THEN '1997-1-5' WHEN 3 THEN '2999-01-01' ELSE 'soon' END AS v FROM orders) SELECT o_orderkey, coalesce(regexp_matches(v, '^[0-9]{4}-[0-9]{2}-[0-9]{2}$') AND TRY_CAST(v AS DATE) <= DATE '2025-01-01', false) AS valid FROM d")
def valid_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates that exist and do not lie ahead of a given day."""
    key = F.col("o_orderkey")
    pad = lambda n: F.lpad(n.cast("string"), 2, "0")
    made = F.when(key % 5 == 0, F.col("o_orderdate").cast("date").cast("string")).when(key % 5 == 1, F.concat(F.lit("2023-"), pad(key % 14), F.lit("-"), pad(key % 33))).when(key % 5 == 2, "1997-1-5").when(key % 5 == 3, "2999-01-01").otherwise("soon")
    return table(spark, sf_dir, "orders").select("o_orderkey", T.valid_date(made, F.lit("2025-01-01").cast("date")).alias("valid"))


@query(f"WITH r AS (SELECT doc_id, substr(text, 1, 40) || ' \"q\" ' || chr(92) || 'x' AS v FROM {_D}), q AS (SELECT doc_id, v, '\"' || regexp_replace(v, '([\"\\\\])', '\\\\\\1', 'g') || '\"' AS quoted FROM r) SELECT doc_id, quoted, v AS unquoted, replace(regexp_replace(trim(regexp_replace(v, '^\\s+|\\s+$', '', 'g')), '\\s+', '_', 'g'), '#', '') AS tag FROM q")
def yaml_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Openings of documents as quoted scalars, read again, and as tags."""
    v = F.concat(F.substring("text", 1, 40), F.lit(' "q" \\x'))
    quoted = frontmatter.quoted(v)
    return _docs(spark, sf_dir).select("doc_id", quoted.alias("quoted"), frontmatter.unquoted(quoted).alias("unquoted"), frontmatter.tag_value(v).alias("tag"))


@query(f"""WITH c AS (SELECT doc_id, unnest(string_split(substr(text, 1, 60) || '课程M@1', '')) AS c FROM {_D}) SELECT doc_id, round(sum(CASE WHEN regexp_matches(c, '^\\s$') THEN 0.35 WHEN regexp_matches(c, '^\\p{{Han}}$') THEN 1.0 WHEN contains('MW@%&', c) THEN 0.9 WHEN contains('ilI.,:;!|''`', c) THEN 0.3
 WHEN regexp_matches(c, '^\\p{{Lu}}$') THEN 0.7 WHEN regexp_matches(c, '^[0-9]$') THEN 0.58 ELSE 0.55 END), 6) AS units FROM c WHERE c <> '' GROUP BY doc_id""")
def title_widths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Estimated widths of openings as slide titles."""
    return _docs(spark, sf_dir).select("doc_id", F.round(T.title_units(F.concat(F.substring("text", 1, 60), F.lit("课程M@1"))), 6).alias("units"))


@query(f"WITH l AS (SELECT doc_id, '  ' || replace(string_split(text, chr(10))[1], ',', ' ,') || ' ' || chr(8203) || '＼alpha ≤ ' || chr(92) || chr(92) || 'beta π  ' AS v FROM {_D}) SELECT doc_id, regexp_replace(replace(replace(regexp_replace(replace(replace(replace(v, chr(8203), ''), '＼', chr(92)), chr(92) || chr(92) || 'beta', chr(92) || 'beta'), '\\s+([,.;:])', '\\1', 'g'), '≤', chr(92) || 'le'), 'π', chr(92) || 'pi'), '\\s+$', '') AS v FROM l")
def slide_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First lines as cleaned slide text, signs as commands."""
    raw = F.concat(F.lit("  "), F.replace(F.split("text", "\n")[0], F.lit(","), F.lit(" ,")), F.lit(" ​＼alpha ≤ \\\\beta π  "))
    return _docs(spark, sf_dir).select("doc_id", T.slide_line(raw, math=True).alias("v"))


@query(f"SELECT doc_id, sha256(lower(trim(regexp_replace('ﬁ １ ' || text, '[\\s\\x{{A0}}\\x{{3000}}]+', ' ', 'g')))) = sha256('') AS blank, sha256(replace(replace(lower(trim(regexp_replace('ﬁ １ ' || text, '[\\s\\x{{A0}}\\x{{3000}}]+', ' ', 'g'))), 'ﬁ', 'fi'), '１', '1')) AS digest FROM {_D}")
def comparable_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts in their form for comparison: composed, lower case, single blanks; by digest."""
    v = F.lower(T.collapsed(T.nfkc(F.concat(F.lit("ﬁ １ "), "text"))))
    return _docs(spark, sf_dir).select("doc_id", (v == "").alias("blank"), F.sha2(v, 256).alias("digest"))


_URLS = "SELECT page_id, upper(substr(url, 1, 12)) || substr(url, 13) || '&q=%7eA%2f%3d' AS raw FROM pages"


@query(f"WITH u AS ({_URLS}), h AS (SELECT page_id, raw, regexp_extract(raw, '^([^/]*//[^/?#]*)', 1) AS head FROM u) SELECT page_id, lower(head) || replace(replace(replace(substr(raw, length(head) + 1), '%7e', '~'), '%2f', '%2F'), '%3d', '%3D') AS identity FROM h")
def url_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """URLs by identity: lower scheme and host, unreserved escapes decoded, the others in upper case."""
    raw = F.concat(F.upper(F.substring("url", 1, 12)), F.expr("substring(url, 13)"), F.lit("&q=%7eA%2f%3d"))
    return table(spark, sf_dir, "pages").select("page_id", urls.url_identity(raw).alias("identity"))


@query("SELECT page_id, regexp_replace(url, '[?#].*$', '') || '/%C3%A9%20x?' || 'q=1%202' AS request FROM pages")
def request_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """URLs as requests send them: escaped path and query, no user and no fragment."""
    raw = F.concat(F.regexp_replace(F.regexp_replace("url", r"[?#].*$", ""), "://", "://me@"), F.lit("/é x?q=1 2#top"))
    return table(spark, sf_dir, "pages").select("page_id", urls.request_form(raw).alias("request"))


_PROSE = "SELECT page_id, 'see ' || url || '。next (' || upper(substr(url, 1, 5)) || substr(url, 6) || '#frag), and ' || url || ' again' AS text FROM pages"


def _prose(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("see "), "url", F.lit("。next ("), F.upper(F.substring("url", 1, 5)), F.expr("substring(url, 6)"), F.lit("#frag), and "), "url", F.lit(" again"))
    return table(spark, sf_dir, "pages").select(F.col("page_id").alias("path"), text.alias("text"))


_FOUND = f"""WITH t AS ({_PROSE}), r AS (SELECT page_id, unnest(regexp_extract_all(text, '(?i)https?://[^\\s。)]+')) AS raw FROM t), b AS (SELECT page_id, regexp_replace(raw, '#.*$', '') AS v FROM r),
f AS (SELECT DISTINCT page_id, lower(regexp_extract(v, '^([a-zA-Z]+://[^/?#]*)', 1)) || substr(v, length(regexp_extract(v, '^([a-zA-Z]+://[^/?#]*)', 1)) + 1) AS url FROM b) """


@query(_FOUND + "SELECT page_id AS path, url FROM f")
def prose_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct URLs of running text in audit form."""
    return _prose(spark, sf_dir).select("path", F.explode(urls.prose_urls(F.col("text"))).alias("url"))


@query(_FOUND + "SELECT url, count(DISTINCT page_id) AS files, min(page_id) AS first_path FROM f GROUP BY url")
def url_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many texts cite each URL."""
    return links.url_citations(_prose(spark, sf_dir), urls.prose_urls(F.col("text")))


_HELPERS = "SELECT page_id, regexp_replace(url, '[?#].*$', '') || CASE page_id % 5 WHEN 0 THEN '/app.bundle.js' WHEN 1 THEN '/api/v1' WHEN 2 THEN '/x.pdf' WHEN 3 THEN '' ELSE '/main.css' END AS u, CASE page_id % 4 WHEN 0 THEN 'static asset' WHEN 1 THEN 'API endpoint' WHEN 2 THEN 'Open menu' ELSE '' END AS label FROM pages"


@query(f"WITH h AS ({_HELPERS}), k AS (SELECT *, regexp_matches(lower(u), '\\.(js|css)$') AS file, regexp_extract(lower(u), '([^/]*)$', 1) AS name, lower(u) LIKE '%.pdf' AS direct FROM h) "
       "SELECT page_id, NOT direct AND ((file AND (label = 'static asset' OR (label = '' AND regexp_matches(name, '^(?:app|main|bundle|runtime|vendor|webpack)(?:[._-][a-z0-9]+)*\\.(?:js|css)$')))) OR (contains(u, '/api/v1') AND label = 'API endpoint') OR (label = 'Open menu' AND kind = 'web_page')) AS helper FROM (SELECT *, CASE WHEN direct THEN 'pdf' WHEN regexp_matches(lower(u || ' ' || label), 'transcript|caption|slide|ppt|video|lecture|book|chapter|reading|course|syllabus|/watch|/lesson|/play|/class|/module|youtube|vimeo|coursera|edx|ocw|mit\\.edu|bilibili|youtu\\.be|khanacademy') THEN 'other' ELSE 'web_page' END AS kind FROM k)")  # fmt: skip
def provenance_helpers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links that document a collection: bundles, endpoints, navigation."""
    pages = table(spark, sf_dir, "pages")
    end = F.element_at(F.array(*map(F.lit, ("/app.bundle.js", "/api/v1", "/x.pdf", "", "/main.css"))), (F.col("page_id") % 5 + 1).cast("int"))
    label = F.element_at(F.array(*map(F.lit, ("static asset", "API endpoint", "Open menu", ""))), (F.col("page_id") % 4 + 1).cast("int"))
    made = pages.select("page_id", F.concat(F.regexp_replace("url", "[?#].*$", ""), end).alias("u"), label.alias("label"))
    return made.select("page_id", urls.provenance_helper(F.col("u"), F.col("label"), urls.resource_kind(F.col("u"), F.col("label"))).alias("helper"))


@query("SELECT page_id, CASE WHEN page_id % 2 = 0 THEN url ELSE 'file:///notes/' || page_id || '%20a%23b.md' END AS url FROM pages")
def source_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources, half of them local paths, as URLs."""
    key = F.col("page_id")
    rows = table(spark, sf_dir, "pages").select("page_id", F.when(key % 2 == 0, F.col("url")).otherwise(F.concat(F.lit("/notes/"), key, F.lit(" a#b.md"))).alias("ref"))
    return coverage.source_references(rows).select("page_id", "url")


_TYPED = "SELECT p_partkey, concat(CASE p_partkey % 4 WHEN 0 THEN '.obsidian/templates/' WHEN 1 THEN 'papers/' ELSE 'c/' END, p_partkey, CASE p_partkey % 7 WHEN 0 THEN '_exam.md' WHEN 1 THEN '_compact.md' WHEN 2 THEN '_detailed.md' WHEN 3 THEN '_overview.md' ELSE '.md' END) AS path, CASE p_partkey % 3 WHEN 0 THEN 'navigation' WHEN 1 THEN 'unknown' END AS declared FROM part"


@query(f"WITH t AS ({_TYPED}) SELECT path, CASE WHEN path LIKE '.obsidian/templates/%' THEN 'template' WHEN declared = 'navigation' THEN declared WHEN path LIKE '%compact%' THEN 'review_compact' WHEN path LIKE '%detailed%' THEN 'review_detailed' WHEN path LIKE '%exam%' THEN 'exam_review' WHEN path LIKE 'papers/%' THEN 'paper_note' WHEN path LIKE '%overview%' THEN 'navigation' ELSE 'course_note' END AS note_type FROM t")
def note_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types of notes by template path, declaration and name."""
    table(spark, sf_dir, "part").createOrReplaceTempView("folio_part")
    rows = spark.sql(_TYPED.replace("FROM part", "FROM folio_part"))
    return rows.select("path", classify.note_type(F.col("path"), F.col("declared"), ["navigation"]).alias("note_type"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 7 THEN 'missing' WHEN l_linestatus = l_returnflag THEN 'exact' WHEN l_quantity > 25 THEN 'contract' ELSE 'mismatch' END AS status, CASE WHEN l_linenumber % 2 = 0 THEN CAST(l_quantity > 25 AS VARCHAR) ELSE 'skipped' END AS passed FROM lineitem")
def provenance_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests found against expected ones, and results that are null where a check was skipped."""
    rows = table(spark, sf_dir, "lineitem")
    found = F.when(F.col("l_linenumber") != 7, F.col("l_returnflag"))
    return rows.select("l_orderkey", "l_linenumber", classify.provenance_status(F.col("l_linestatus"), found, F.col("l_quantity") > 25).alias("status"), F.coalesce(classify.checked_state(F.col("l_linenumber") % 2 == 0, F.col("l_quantity") > 25).cast("string"), F.lit("skipped")).alias("passed"))
