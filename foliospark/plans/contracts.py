"""Queries over notes with defects put in by arithmetic on keys: the oracle counts the defects, the query has to find them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.operators import frontmatter, manifests
from foliospark.plans import vault
from foliospark.plans.registry import query, table

# Cells of a manifest row for each supplier, in the nine columns' order.
CELLS = [
    "CASE WHEN s_suppkey % 10 = 3 THEN concat('`', s_suppkey, '.pdf`') ELSE concat('`', n_name, '/', s_suppkey, '.pdf`') END",
    "CASE WHEN s_suppkey % 7 = 0 THEN '`.ppt`' ELSE '`.pdf`' END",
    "cast(s_suppkey % 11 AS string)",
    "CASE WHEN s_suppkey % 13 = 0 THEN '' ELSE 'pdftotext' END",
    "CASE WHEN s_suppkey % 5 = 1 THEN 'none' ELSE '[[x]]' END",
    "CASE WHEN s_suppkey % 6 = 2 THEN '完整覆盖' ELSE '已映射：正文' END",
    "CASE WHEN s_suppkey % 8 = 4 THEN '-' ELSE '例题见笔记' END",
    "CASE WHEN s_suppkey % 9 = 5 THEN '' WHEN s_suppkey % 9 = 6 THEN '无' ELSE 'OCR 未做' END",
    "CASE WHEN s_suppkey % 12 = 0 THEN '2024-13-01' ELSE '2024-01-01' END",
]
_DEFECTS = {
    "SOURCE_IDENTITY_INVALID": "k % 10 = 3",
    "SOURCE_TYPE_INVALID": "k % 7 = 0 AND k % 10 <> 3",
    "SOURCE_COUNT_INVALID": "k % 11 = 0",
    "EXTRACTION_METHOD_MISSING": "k % 13 = 0",
    "MAPPING_LINK_MISSING": "k % 5 = 1",
    "COVERAGE_STATE_INVALID": "k % 6 = 2",
    "EXAMPLE_STATE_INVALID": "k % 8 = 4",
    "LIMITATIONS_MISSING": "k % 9 = 5",
    "LIMITATIONS_INCOMPLETE": "k % 9 = 6 AND k % 13 <> 0",
    "CHECKED_DATE_INVALID": "k % 12 = 0",
}
_ROWS = "WITH r AS (SELECT n_name || '/source_manifest.md' AS path, s_suppkey AS k, (row_number() OVER (PARTITION BY n_name ORDER BY s_suppkey) + 2)::INT AS line_no FROM supplier JOIN nation ON s_nationkey = n_nationkey) "


def _manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *map(F.expr, CELLS)), F.lit(" |"))
    listed = F.array_sort(F.collect_list(F.struct("s_suppkey", line.alias("line"))))
    text = F.concat_ws("\n", F.lit(manifests.HEADER), F.lit(manifests.RULE), F.transform(listed, lambda x: x["line"]))
    return rows.groupBy("n_name").agg(text.alias("text")).select(F.concat("n_name", F.lit("/source_manifest.md")).alias("path"), "text")


@query(_ROWS + " UNION ALL ".join(f"SELECT '{rule}' AS rule, path, line_no FROM r WHERE {cond}" for rule, cond in _DEFECTS.items()))
def manifest_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of source manifests that break the contract."""
    found = manifests.records(_manifests(spark, sf_dir))
    return manifests.record_issues(found, F.lit("2025-01-01").cast("date")).select("rule", "path", "line_no")


_HOMES = (
    "WITH d AS (SELECT concat(r_name, '/', n_name, '/', s_suppkey, '.md') AS path, concat('src', s_suppkey % 3) AS source, n_nationkey AS n, r_regionkey AS r, s_suppkey = min(s_suppkey) OVER (PARTITION BY n_nationkey) AS first "
    "FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey) "
)


@query(
    _HOMES
    + "SELECT 'APPLICABLE_MANIFEST_MISSING' AS rule, path, '' AS message FROM d WHERE n % 2 = 1 AND r = 2 "
    + "UNION ALL SELECT 'SOURCE_NOT_IN_APPLICABLE_MANIFEST', path, source FROM d WHERE (n % 2 = 0 OR r <> 2) AND NOT ((source = 'src0' AND n % 2 = 0) OR (source = 'src1' AND r <> 2)) "
    + "UNION ALL SELECT 'SOURCE_NOTE_MAPPING_MISSING', path, source FROM d WHERE (source = 'src0' AND n % 2 = 0 AND NOT first) OR (source = 'src1' AND r <> 2)"
)
def manifest_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declared sources against the nearest manifest that has them, and whether it links back."""
    supplier, nation, region = (table(spark, sf_dir, n) for n in ("supplier", "nation", "region"))
    rows = supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    declared = rows.select(F.concat_ws("/", "r_name", "n_name", F.concat("s_suppkey", F.lit(".md"))).alias("path"), F.concat(F.lit("src"), F.col("s_suppkey") % 3).alias("source"))
    own = rows.where("n_nationkey % 2 = 0").groupBy("r_name", "n_name").agg(F.min("s_suppkey").alias("k"))
    link = lambda *parts: F.concat(F.lit("[["), F.concat_ws("/", *parts), F.lit("]]"))
    found = own.select(F.concat_ws("/", "r_name", "n_name", F.lit("source_manifest.md")).alias("path"), F.lit(1).alias("line_no"), F.lit("src0").alias("source"), link("r_name", "n_name", "k").alias("note_cell"))
    found = found.union(region.where("r_regionkey <> 2").select(F.concat_ws("/", "r_name", F.lit("source_manifest.md")), F.lit(1), F.lit("src1"), link("r_name", F.lit("x"))))
    return manifests.closure_issues(declared, found, found.select("path")).select("rule", "path", "message")


@query("SELECT p_partkey, unnest(range(p_size, p_size + 3))::BIGINT AS unit FROM part UNION ALL SELECT p_partkey, 1000 + p_size FROM part")
def unit_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that a limitation names: a range and a single one, but no version and no date."""
    size = F.col("p_size")
    text = F.concat(F.lit("工具 5.5.3（2024-01-02）：第 "), size, F.lit("-"), size + 2, F.lit(" 页空白, see page "), size + 1000)
    return table(spark, sf_dir, "part").select("p_partkey", F.explode(manifests.mentioned_units(text)).alias("unit"))


@query(
    f"WITH notes AS ({vault.NOTES}), "
    + r"""p AS (SELECT *, string_split(path, '/')[1] AS dir, regexp_replace(regexp_extract(path, '[^/]*$'), '\.md$', '') AS stem FROM notes)
SELECT path, sha256('---' || chr(10) || 'course: "' || dir || '"' || chr(10) || 'note_type: "course_note"' || chr(10) || 'aliases:' || chr(10)
 || CASE WHEN stem = 'overview' THEN '  - "Overview"' || chr(10) ELSE '' END || '  - "' || stem || '"' || chr(10) || 'source_files: []' || chr(10) || 'coverage: "checked"' || chr(10)
 || 'last_checked: "2025-01-01"' || chr(10) || 'tags:' || chr(10) || '  - "course/' || replace(dir, ' ', '_') || '"' || chr(10) || '  - "type/course_note"' || chr(10) || '---' || chr(10) || chr(10) || text) AS digest FROM p"""
)
def frontmatter_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes of the projected vault with their managed frontmatter, by digest."""
    notes = vault.notes(spark, sf_dir).withColumn("note_type", F.lit("course_note"))
    none = spark.createDataFrame([], "path string, sources array<string>")
    return frontmatter.rewritten(notes, none, "2025-01-01").select("path", F.sha2("text", 256).alias("digest"))
