"""Note trees as DataFrames: ``notes(path, dir, name, stem, text)``.

A scan lists files with Spark's binary reader, so contents are read by the
executors and only where a column needs them.
"""

from __future__ import annotations

import re
from urllib.parse import urlsplit

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Directories and files that the scans leave out.
ORGANIZER_DIRS = [".git", ".obsidian", ".pytest_cache", ".ruff_cache", "__pycache__", "scripts", "skills", "build", "output"]
MAINTAINER_DIRS = [".git", ".obsidian", ".pytest_cache", ".ruff_cache", "__pycache__", "agent", "scripts", "tests"]
GUIDANCE_FILES = ["AGENT.md"]
SOURCE_SUFFIXES = ["pdf", "ppt", "pptx"]


def files(spark: SparkSession, root: str, glob: str = "*", max_bytes: int | None = None) -> DataFrame:
    """``path`` (relative), ``size``, ``modified`` and ``content`` of the files under ``root``."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
    base = "/" + urlsplit(root).path.strip("/") + "/"
    relative = F.regexp_replace("path", f"^.*?{re.escape(base)}", "")
    out = found.select(relative.alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), "content")
    return out if max_bytes is None else out.where(F.col("size") <= max_bytes)


def named(rows: DataFrame) -> DataFrame:
    """Adds ``dir``, ``name`` and ``stem`` to rows with a ``path``."""
    name = F.substring_index("path", "/", -1)
    return rows.withColumns({"name": name, "dir": F.when(F.contains("path", F.lit("/")), F.regexp_replace("path", "/[^/]*$", "")).otherwise(""), "stem": F.regexp_replace(name, r"\.[^.]*$", "")})


def tolerant_text(content: Column) -> Column:
    """UTF-8 with replacement characters for what is not."""
    return F.make_valid_utf8(content.cast("string"))


def strict_text(content: Column) -> Column:
    """UTF-8; a row that is not fails the query."""
    return F.decode(content, "UTF-8")


def in_population(path: Column, skip_dirs: list[str], skip_files: list[str] = (), skip_trees: list[str] = ()) -> Column:
    """No directory of that name above it, not one of the files, in none of the subtrees."""
    parts = F.split(path, "/")
    above = F.slice(parts, F.lit(1), F.size(parts) - 1)
    keep = ~F.arrays_overlap(above, F.array(*map(F.lit, skip_dirs))) if skip_dirs else F.lit(True)
    if skip_files:
        keep &= ~F.element_at(parts, -1).isin(*skip_files)
    for tree in skip_trees:
        keep &= ~path.startswith(tree.rstrip("/") + "/")
    return keep


def organizer_notes(spark: SparkSession, root: str, skip_trees: list[str] = ()) -> DataFrame:
    """Notes of a vault, tolerant decoding, default and given exclusions."""
    rows = files(spark, root, "*.md").where(in_population(F.col("path"), ORGANIZER_DIRS, GUIDANCE_FILES, list(skip_trees)))
    return named(rows.select("path", tolerant_text(F.col("content")).alias("text")))


def maintainer_notes(spark: SparkSession, root: str) -> DataFrame:
    """Notes of a maintained vault, strict decoding; ``agent`` in any case is guidance."""
    agent = F.exists(F.split(F.lower("path"), "/"), lambda p: p == "agent")
    rows = files(spark, root, "*.md").where(in_population(F.col("path"), MAINTAINER_DIRS, GUIDANCE_FILES) & ~agent)
    return named(rows.select("path", strict_text(F.col("content")).alias("text")))


def sources(spark: SparkSession, root: str, suffixes: list[str] = SOURCE_SUFFIXES) -> DataFrame:
    """Course files: ``course``, ``root_relative``, ``course_relative``, ``name``, ``stem``, ``suffix``, ``size``."""
    rows = named(files(spark, root).select("path", "size")).withColumn("suffix", F.lower(F.regexp_extract("name", r"\.([^.]*)$", 1)))
    course = F.substring_index("path", "/", 1)
    return rows.where(F.col("suffix").isin(*suffixes) & ~F.exists(F.split("path", "/"), lambda p: p.startswith("."))).select(course.alias("course"), F.col("path").alias("root_relative"), F.regexp_replace("path", "^[^/]*/", "").alias("course_relative"), "name", "stem", "suffix", "size")


def versions(rows: DataFrame) -> DataFrame:
    """A token that changes with a file: ``path`` and (size, modified, sha256)."""
    return rows.select("path", F.struct("size", "modified", F.sha2("content", 256).alias("sha256")).alias("version"))


def manifest_rows(notes: DataFrame) -> DataFrame:
    """Piped rows with a code cell of every ``source_manifest.md`` outside hidden trees."""
    chosen = notes.where((F.col("name") == "source_manifest.md") & ~F.col("path").startswith("."))
    rows = chosen.select(F.col("path").alias("manifest_path"), F.posexplode(F.split("text", "\r\n|\r|\n")).alias("i", "line")).where(F.col("line").rlike(r"^\| `"))
    cells = F.transform(F.split(F.regexp_replace("line", r"^\||\|\s*$", ""), r"\|"), lambda c: F.trim(c))
    return rows.select("manifest_path", (F.col("i") + 1).alias("line_no"), cells.alias("cells"))


def patterns(spark: SparkSession, lines: list[str]) -> DataFrame:
    """A pattern list: ``regex:`` and ``re:`` lines are expressions, ``text:`` and plain lines literals, ``#`` comments."""
    rows = spark.createDataFrame([(k, x.strip()) for k, x in enumerate(lines)], "id int, raw string").where("raw <> '' and not startswith(raw, '#')")
    literal = F.concat(F.lit("\\Q"), F.trim(F.regexp_replace("raw", "^text:", "")), F.lit("\\E"))
    return rows.select("id", F.when(F.col("raw").rlike("^(regex|re):"), F.trim(F.regexp_replace("raw", "^(regex|re):", ""))).otherwise(literal).alias("regex"))


def locks(texts: DataFrame, schema: str, column: str = "text") -> DataFrame:
    """JSON files with an explicit schema; an unreadable one is a row of nulls."""
    return texts.withColumn("payload", F.from_json(column, schema, {"mode": "PERMISSIVE"}))
