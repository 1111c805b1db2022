"""Rules: predicates over lines and documents that give issue rows.

Every rule returns ``rule``, ``path``, ``line_no`` (0: the whole document) and ``message``.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.functions.text import compact_length, has_control, heading_anchor, holds, keyword_pile
from foliospark.operators.frames import by_line, lines, without_frontmatter
from foliospark.operators.many import first_patterns

# Words and patterns that the rules look for.
RESIDUE = "相关知识链接|TODO|FIXME|TBD|待补|待完善"
STRICT_RESIDUE = "待补充|占位|空话|套话|泛泛|交作业式|神谕|需要注意的是"
PLACEHOLDER = "(?i)在此填写|TODO|FIXME|待补充|<待填写>"
SECRETS = {
    "github_pat": r"github_pat_[A-Za-z0-9_]{20,}",
    "github_token": r"ghp_[A-Za-z0-9]{20,}",
    "openai_key": r"sk-[A-Za-z0-9]{20,}",
    "aws_access_key": r"AKIA[0-9A-Z]{16}",
    "private_key": r"BEGIN (?:RSA |OPENSSH |EC |DSA )?PRIVATE KEY",
}
ABSOLUTE_PATHS = r"/Users/[^`\s)>\]]+|/home/[^`\s)>\]]+|/mnt/data[^`\s)>\]]*|C:\\Users\\[^`\s)>\]]+"
EXAMPLE_PASSWORD = r"(?i)\b(?:password|passwd|pwd)\s*=\s*['\"]?(?:123456|password|admin|test)['\"]?"
URL = r"https?://[^\s<>)\]]+"
ATTACHMENTS = ["7z", "ckpt", "doc", "docx", "onnx", "pdf", "ppt", "pptx", "pth", "pt", "rar", "safetensors", "tar", "zip"]
NOTE_TYPES = [
    "agent_rule", "audit_record", "concept_index", "course_note", "coverage_audit", "exam_review", "game_design_note",
    "global_coverage_audit", "navigation", "paper_note", "paper_topic_note", "research_method_note", "review_compact",
    "review_detailed", "source_index", "source_manifest", "source_manifest_history", "template", "vault_audit",
]
COVERAGE = ["checked", "generated", "source_mapped", "special_rule"]
REQUIRED_KEYS = ["course", "note_type", "source_files", "coverage", "last_checked"]


def issue(rows: DataFrame, rule: str | Column, message: Column, line_no: Column | None = None) -> DataFrame:
    return rows.select(F.lit(rule).alias("rule"), F.col("path").cast("string").alias("path"), (F.lit(0) if line_no is None else line_no).cast("int").alias("line_no"), message.alias("message"))


def all_of(*issues: DataFrame) -> DataFrame:
    """Issue streams one after the other."""
    return reduce(DataFrame.unionByName, issues)


def empty_notes(docs: DataFrame) -> DataFrame:
    """Nothing but white space of any kind."""
    return issue(docs.where(~F.col("text").rlike(r"(?U)\S")), "empty_file", F.lit("no content"))


def conflict_markers(docs: DataFrame) -> DataFrame:
    """Edge markers, and the middle one only where the document holds both edges."""
    edges = F.contains("text", F.lit("<<<<<<<")) & F.contains("text", F.lit(">>>>>>>"))
    rows = lines(docs.where(F.col("text").rlike("<<<<<<<|>>>>>>>|======="))).join(docs.select("path", edges.alias("edges")), "path")
    hit = F.col("line").rlike("^(<<<<<<<|>>>>>>>)") | (F.col("line").rlike("^=======") & F.col("edges"))
    return issue(rows.where(hit), "conflict_marker", F.col("line"), F.col("line_no"))


def residue(docs: DataFrame, pattern: str = RESIDUE, rule: str = "template_residue") -> DataFrame:
    """Lines with a left-over; documents without one are not split."""
    parts = pattern.split("|")
    literal = all(parts) and not re.search(r"[\\.^$*+?()\[\]{}]", pattern)
    fits = lambda text: holds(F.col(text), parts) if literal else F.col(text).rlike(pattern)
    rows = lines(docs.where(fits("text"))).where(fits("line"))
    return issue(rows, rule, F.regexp_extract("line", f"({pattern})", 1), F.col("line_no"))


#: Kept for callers that set it; lists are cut by ``many.PART_BYTES``.
PATTERN_BATCH = 64


def custom_residue(docs: DataFrame, patterns: DataFrame) -> DataFrame:
    """Lines with the first fitting pattern (``id``, ``regex``) of a user's list, each tried on its own; one scan for the whole list."""
    found = first_patterns(docs, patterns)
    return issue(found, "custom_residue", F.col("id").cast("string"), F.col("line_no"))


def odd_math(docs: DataFrame) -> DataFrame:
    """An odd number of block math delimiters."""
    n = F.size(F.split("text", r"\$\$")) - 1
    return issue(docs.withColumn("n", n).where("n % 2 = 1"), "unbalanced_math", F.col("n").cast("string"))


def open_fences(docs: DataFrame) -> DataFrame:
    """An odd number of fence lines."""
    n = F.regexp_count("text", F.lit("(?m)^ {0,3}(`{3,}|~{3,})"))
    return issue(docs.withColumn("n", n).where("n % 2 = 1"), "unbalanced_fence", F.col("n").cast("string"))


def control_characters(docs: DataFrame) -> DataFrame:
    return issue(docs.where(has_control(F.col("text"))), "control_character", F.lit("control character"))


def shallow_notes(docs: DataFrame, least: Column) -> DataFrame:
    """Fewer characters that are not blank, without frontmatter, than ``least``."""
    sized = without_frontmatter(docs).withColumn("n", compact_length(F.col("body")))
    return issue(sized.where(F.col("n") < least), "shallow_note", F.col("n").cast("string"))


def keyword_piles(docs: DataFrame) -> DataFrame:
    return issue(docs.where(keyword_pile(F.col("text"))), "keyword_pile", F.lit("few distinct tokens"))


def private_data(docs: DataFrame) -> DataFrame:
    """Secrets, absolute paths (URLs do not count) and example passwords, one row per match."""
    checks = [(name, pattern, F.col("line")) for name, pattern in SECRETS.items()]
    checks += [("absolute_path", ABSOLUTE_PATHS, F.regexp_replace("line", URL, "")), ("example_password", EXAMPLE_PASSWORD, F.col("line"))]
    wanted = "|".join([*SECRETS.values(), ABSOLUTE_PATHS, EXAMPLE_PASSWORD.replace("(?i)", "(?i:") + ")"])
    rows = lines(docs.where(F.col("text").rlike(wanted)))
    named = lambda name: lambda m: F.struct(F.lit(name).alias("rule"), m.alias("message"))
    found = F.flatten(F.array(*(F.transform(F.regexp_extract_all(line, F.lit(p), F.lit(0)), named(name)) for name, p, line in checks)))
    return rows.select("path", "line_no", F.inline(found)).select("rule", F.col("path").cast("string").alias("path"), F.col("line_no").cast("int").alias("line_no"), "message")


def invalid_frontmatter(front: DataFrame, today: Column) -> DataFrame:
    """Missing required keys, values outside the closed sets, dates that do not exist or lie ahead."""
    keys = F.col("keys")
    missing = F.filter(F.array(*map(F.lit, REQUIRED_KEYS)), lambda k: ~F.map_contains_key(keys, k) & ~F.exists("lists", lambda x: x["key"] == k))
    date = F.try_to_date(keys["last_checked"], "yyyy-MM-dd")
    checks = [
        F.when(F.size(missing) > 0, F.concat(F.lit("missing: "), F.array_join(missing, ","))),
        F.when(keys["note_type"].isNotNull() & ~keys["note_type"].isin(NOTE_TYPES), F.lit("note_type")),
        F.when(keys["coverage"].isNotNull() & ~keys["coverage"].isin(COVERAGE), F.lit("coverage")),
        F.when(keys["last_checked"].isNotNull() & F.coalesce(~(keys["last_checked"].rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$") & (date <= today)), F.lit(True)), F.lit("last_checked")),
    ]
    return issue(front.select("path", F.explode(F.filter(F.array(*checks), lambda x: x.isNotNull())).alias("m")), "frontmatter", F.col("m"))


def heading_issues(headings: DataFrame, all_lines: DataFrame) -> DataFrame:
    """Level jumps, first and second-level anchors twice, sections without a line."""
    jumped = headings.withColumn("before", F.lag("level").over(by_line())).where("level - before > 1")
    named = headings.withColumn("anchor", heading_anchor(F.col("title")))
    twice = named.withColumn("n", F.count("*").over(Window.partitionBy("path", "anchor"))).where("n > 1 and level <= 2")
    # Non-blank lines are numbered once; a section is empty if its count does not move until the next heading.
    # What a window sorts are flags; lines with their texts would be the whole input once more.
    filled = all_lines.select("path", "line_no", F.col("line").rlike(r"(?U)\S").cast("int").alias("filled"))
    upto = filled.withColumn("upto", F.sum("filled").over(by_line().rowsBetween(Window.unboundedPreceding, 0)))
    total = upto.groupBy("path").agg(F.max("upto").alias("all_lines"))
    placed = headings.join(upto.select("path", "line_no", "upto"), ["path", "line_no"]).join(total, "path")
    nexts = placed.withColumns({"next_level": F.lead("level").over(by_line()), "next_upto": F.lead("upto").over(by_line())})
    hollow = nexts.where("(next_level is null or next_level <= level) and coalesce(next_upto - 1, all_lines) = upto")
    return all_of(
        issue(jumped, "heading_jump", F.col("title"), F.col("line_no")),
        issue(twice, "duplicate_anchor", F.col("title"), F.col("line_no")),
        issue(hollow, "empty_section", F.col("title"), F.col("line_no")),
    )


def table_issues(docs: DataFrame) -> DataFrame:
    """Rows whose number of cells differs from their table's header."""
    cells = F.size(F.split(F.regexp_replace(F.regexp_replace("line", r"\\\\|\\\|", ""), r"^\||\|$", ""), r"\|"))
    rows = lines(docs.where(F.col("text").rlike(r"(?m)^\|"))).withColumn("is_row", F.col("line").startswith("|") & F.col("line").endswith("|"))
    rule = F.col("line").rlike(r"^\|(\s*:?-+:?\s*\|)+$")
    rows = rows.withColumns({"cells": F.when(F.col("is_row"), cells), "rule": F.col("is_row") & rule})
    island = F.sum((~F.col("is_row")).cast("int")).over(by_line().rowsBetween(Window.unboundedPreceding, 0))
    marked = rows.withColumns({"island": island, "head": F.col("is_row") & F.coalesce(F.lead("rule").over(by_line()), F.lit(False))})
    inside = Window.partitionBy("path", "island").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    expected = F.last(F.when(F.col("head"), F.col("cells")), ignorenulls=True).over(inside)
    wrong = marked.withColumn("expected", expected).where("is_row and not head and cells <> expected")
    return issue(wrong, "table_columns", F.concat(F.col("cells").cast("string"), F.lit(" for "), F.col("expected").cast("string")), F.col("line_no"))


def large_files(files: DataFrame, warn: int, most: int) -> DataFrame:
    """``path``, ``size``, ``severity``, largest first."""
    return files.where(F.col("size") > warn).select("path", "size", F.when(F.col("size") > most, "fail").otherwise("warn").alias("severity")).orderBy(F.desc("size"), "path")


def forbidden_files(files: DataFrame) -> DataFrame:
    suffix = F.lower(F.regexp_extract("path", r"\.([^./]*)$", 1))
    return issue(files.where(suffix.isin(ATTACHMENTS)), "forbidden_attachment", suffix)


def low_coverage(units: DataFrame, least_share: float = 0.5, least_chars: int = 20) -> DataFrame:
    """Sources with under half of their pages, or under twenty characters a page, in text."""
    filled = F.count_if(F.col("text").rlike(r"(?U)\S"))
    per = units.groupBy("source").agg(F.count("*").alias("pages"), filled.alias("filled"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars"))
    return per.where((F.col("filled") < least_share * F.col("pages")) | (F.col("chars") < least_chars * F.col("pages")))


def capped(issues: DataFrame, most: int) -> DataFrame:
    """The first ``most`` issues by path, line and rule, with the exact number of all in ``total``."""
    total = issues.groupBy().agg(F.count("*").alias("total"))
    return issues.orderBy("path", "line_no", "rule").limit(most).crossJoin(F.broadcast(total))
