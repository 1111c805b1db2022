"""Markdown and JSON reports as rows of (path, text): link inventories, web manifests, note scaffolds.

A report is one file by nature, so its lines are gathered; what goes in are
counts per note or page and not their texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.functions.text import safe_name
from foliospark.functions.urls import DIRECT_KINDS
from foliospark.operators.frontmatter import quoted

COUNTS = ["markdown_links", "wiki_links", "external_links", "unique_targets", "total_links"]
# Headings of the reports.
PAGE_COLUMNS = ["Kind", "Title", "Original Source", "URL", "Access", "Status", "Error", "Description"]
ACCESS_COLUMNS = ["Original Source", "Final URL", "HTTP Status", "Access Class"]
RESOURCE_COLUMNS = ["Kind", "Title", "URL", "Access", "Status", "Error", "Source Page"]
HELPER_COLUMNS = ["Kind", "Title", "URL", "Source Page"]


def cell(value: Column) -> Column:
    """A value inside a row of a table."""
    return F.replace(F.replace(F.coalesce(value.cast("string"), F.lit("")), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))


def row(*values: Column) -> Column:
    return F.concat(F.lit("| "), F.concat_ws(" | ", *values), F.lit(" |"))


def header(names: list[str], numbers: int = 0) -> list[str]:
    """The header and its rule; the last ``numbers`` columns are right-aligned."""
    return ["| " + " | ".join(names) + " |", "| " + " | ".join(["---"] * (len(names) - numbers) + ["---:"] * numbers) + " |"]


def _gathered(rows: DataFrame, line: Column, *order: str) -> DataFrame:
    """All lines of a table in order, as one array (empty without rows)."""
    return rows.groupBy().agg(F.transform(F.array_sort(F.collect_list(F.struct(*order, line.alias("line")))), lambda x: x["line"]).alias("lines"))


def link_inventory(per_file: DataFrame, directories: DataFrame, total: DataFrame, path: str = "link_inventory.md") -> DataFrame:
    """The inventory as Markdown; all three have ``scope`` and the counts, directories and total also ``files``."""
    counts = [cell(F.col(c)) for c in COUNTS]
    files = _gathered(per_file, row(cell(F.col("scope")), *counts), "scope")
    dirs = _gathered(directories, row(cell(F.col("scope")), cell(F.col("files")), *counts), "scope")
    names = ["Markdown", "Wiki", "External", "Unique Targets", "Total"]
    head = F.array(
        F.lit("# Link Inventory"), F.lit(""), F.concat(F.lit("- Root: `"), "scope", F.lit("`")),
        *[F.concat(F.lit(f"- {title}: "), F.col(c).cast("string")) for title, c in [("Files", "files"), ("Total links", "total_links"), ("Markdown links", "markdown_links"), ("Wiki links", "wiki_links"), ("External links", "external_links"), ("Unique targets", "unique_targets")]],
    )
    fixed = lambda *lines: F.array(*map(F.lit, lines))
    body = F.concat("head", fixed("", "## Directory Counts", "", *header(["Directory", "Files", *names], 6)), "d.lines", fixed("", "## File Counts", "", *header(["File", *names], 5)), "f.lines", fixed(""))
    joined = total.select(head.alias("head")).alias("t").crossJoin(F.broadcast(dirs.alias("d"))).crossJoin(F.broadcast(files.alias("f")))  # three single rows
    return joined.select(F.lit(path).alias("path"), F.array_join(body, "\n").alias("text"))


def link_inventory_json(per_file: DataFrame) -> DataFrame:
    """``scope``, ``json``: counts per file as canonical JSON objects."""
    return per_file.select("scope", F.to_json(F.struct(F.col("scope").alias("file"), F.struct(*COUNTS).alias("counts"))).alias("json"))


def web_manifest(pages: DataFrame, links: DataFrame, path: str = "source_manifest.md") -> DataFrame:
    """The manifest of collected pages and their links.

    ``pages``: pos, kind, title, original_source, url, canonical_url, final_url,
    access_status, access_class, http_status, error, description; ``links``: page_pos,
    pos, kind, title, url, source, provenance_only.
    """
    status = F.replace("access_status", F.lit("_"), F.lit(" "))
    c = lambda name: cell(F.col(name))
    page = _gathered(pages, row(c("kind"), c("title"), c("original_source"), c("canonical_url"), c("access_status"), status, c("error"), c("description")), "pos")
    access = _gathered(pages, row(c("original_source"), cell(F.coalesce(F.nullif("final_url", F.lit("")), "canonical_url")), c("http_status"), c("access_class")), "pos")
    direct = pages.where(F.col("kind").isin(DIRECT_KINDS)).select(F.col("pos").alias("page_pos"), F.lit(-1).alias("pos"), row(c("kind"), c("title"), c("url"), c("access_status"), status, c("error"), c("url")).alias("line"))
    listed = links.where("not provenance_only").select("page_pos", "pos", row(c("kind"), c("title"), c("url"), F.lit("listed"), F.lit("listed"), F.lit(""), c("source")).alias("line"))
    found = direct.unionByName(listed)
    resources = _gathered(found.withColumnRenamed("line", "shown"), F.col("shown"), "page_pos", "pos")
    helpers = _gathered(links.where("provenance_only"), row(c("kind"), c("title"), c("url"), c("source")), "page_pos", "pos")
    fixed = lambda *lines: F.array(*map(F.lit, lines))
    parts = [("Pages", header(PAGE_COLUMNS), page), ("Access Evidence", header(ACCESS_COLUMNS), access), ("Learning Resources", header(RESOURCE_COLUMNS), resources), ("Provenance Helpers", header(HELPER_COLUMNS), helpers)]
    out, pieces = None, [fixed("# Source Manifest")]
    for k, (title, head, lines) in enumerate(parts):
        named = lines.withColumnRenamed("lines", f"lines_{k}")
        out = named if out is None else out.crossJoin(F.broadcast(named))  # single rows
        pieces += [fixed("", f"## {title}", "", *head), F.col(f"lines_{k}")]
    return out.select(F.lit(path).alias("path"), F.array_join(F.concat(*pieces, fixed("")), "\n").alias("text"))


def skeleton_notes(sources: DataFrame, note_type: str = "course_note", date: str = "1970-01-01") -> DataFrame:
    """``path``, ``text`` of an empty note for each source: frontmatter, title and sections to fill.

    ``sources``: course, stem, root_relative.  Equal names of a course get the digest of their path.
    """
    from foliospark.operators.state import stable_names

    named = stable_names(sources.withColumn("key", F.concat_ws("/", "course", safe_name(F.col("stem")))), "key", "root_relative")
    front = F.concat_ws("\n", F.lit("---"), F.concat(F.lit("course: "), quoted(F.col("course"))), F.lit(f'note_type: "{note_type}"'), F.lit("source_files:"), F.concat(F.lit("  - "), quoted(F.col("root_relative"))), F.lit('coverage: "source_mapped"'), F.lit(f'last_checked: "{date}"'), F.lit("---"))
    text = F.concat(front, F.lit("\n\n# "), F.col("stem"), F.lit("\n\n## Summary\n\n## Key points\n\n## Examples\n"))
    return named.select(F.concat("out_name", F.lit(".md")).alias("path"), text.alias("text"))


def learning_map(notes: DataFrame, path: str = "learning_map.md", title: str = "Learning map") -> DataFrame:
    """One note that links all others by folder; ``notes``: path, title."""
    folder = F.when(F.contains("path", F.lit("/")), F.regexp_replace("path", "/[^/]*$", "")).otherwise("")
    link = F.concat(F.lit("- [["), F.regexp_replace("path", r"\.md$", ""), F.lit("|"), F.col("title"), F.lit("]]"))
    listed = notes.groupBy(folder.alias("dir")).agg(F.array_sort(F.collect_list(link)).alias("links"))
    part = F.concat(F.lit("## "), F.when(F.col("dir") == "", "/").otherwise(F.col("dir")), F.lit("\n\n"), F.array_join("links", "\n"))
    gathered = listed.groupBy().agg(F.array_join(F.array_sort(F.collect_list(part)), "\n\n").alias("body"))
    return gathered.select(F.lit(path).alias("path"), F.concat(F.lit(f"# {title}\n\n"), "body", F.lit("\n")).alias("text"))
