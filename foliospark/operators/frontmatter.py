"""Derived properties of notes and the rewriting of their managed frontmatter keys.

Keys that are not managed stay as they are and in place; the managed block follows them.

Cases: a note without frontmatter gets one; without a date of its own or a
given one it keeps its text and ``problem`` says so; null texts stay null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.functions.text import note_title
from foliospark.operators.frames import without_frontmatter
from foliospark.operators.manifests import note_targets

# Managed keys, names of courses without a folder, and note types by the coverage they imply.
SCALARS, LISTS = ["course", "note_type", "coverage", "last_checked"], ["aliases", "source_files", "tags"]
RULES_COURSE, WHOLE_COURSE, RULES_NOTE = "仓库规则", "全仓", "AGENT.md"
CHECKED_TYPES = ["source_manifest", "source_manifest_history", "coverage_audit", "vault_audit", "global_coverage_audit"]
SPECIAL_TYPES = ["agent_rule", "concept_index", "game_design_note", "research_method_note", "paper_topic_note", "template"]
ALIASED_TYPE = "course_note"


def course(path: Column) -> Column:
    """The first folder; notes at the root belong to the whole vault or are rules."""
    return F.when(path.contains("/"), F.substring_index(path, "/", 1)).when(path == RULES_NOTE, RULES_COURSE).otherwise(WHOLE_COURSE)


def coverage(note_type: Column, sources: Column) -> Column:
    """checked, source_mapped or special_rule."""
    return F.when(note_type.isin(CHECKED_TYPES), "checked").when(F.size(sources) > 0, "source_mapped").when(note_type.isin(SPECIAL_TYPES), "special_rule").otherwise("checked")


def quoted(value: Column) -> Column:
    """A double-quoted scalar."""
    return F.concat(F.lit('"'), F.regexp_replace(value, r'(["\\])', r"\\$1"), F.lit('"'))


def unquoted(value: Column) -> Column:
    """A scalar without its quotes and escapes."""
    text = F.trim(value)
    inner = F.regexp_extract(text, "(?s)^([\"'])(.*)\\1$", 2)
    return F.when(text.rlike("(?s)^([\"']).*\\1$") & (F.length(text) >= 2), F.regexp_replace(F.regexp_replace(inner, r'\\"', '"'), r"\\\\", r"\\")).otherwise(text)


def tag_value(value: Column) -> Column:
    """A value as a part of a tag."""
    out = F.regexp_replace(F.regexp_replace(F.trim(value), r"(?U)\s+", "_"), "#", "")
    return F.when(out == "", "unknown").otherwise(out)


def list_value(front: Column, key: str) -> Column:
    """The items of a list key: bracketed, or dashed below; of equal keys the first counts."""
    line = F.trim(F.regexp_extract(front, rf"(?m)^{key}:(.*)$", 1))
    inner = F.split(F.regexp_extract(line, r"^\[(.*)\]$", 1), ",")
    block = F.regexp_extract(front, rf"(?m)^{key}:.*((?:\n  - .*)*)", 1)
    dashed = F.regexp_extract_all(block, F.lit(r"(?m)^  - (.*)$"), F.lit(1))
    clean = lambda items: F.transform(F.filter(items, lambda x: F.trim(x) != ""), lambda x: unquoted(x))
    return F.coalesce(F.when(line.rlike(r"^\[.*\]$"), clean(inner)).otherwise(clean(dashed)), F.array().cast("array<string>"))


def once(values: Column) -> Column:
    """Trimmed values, empty ones out, each at its first place."""
    return F.array_distinct(F.filter(F.transform(values, lambda x: F.trim(x)), lambda x: x != ""))


def source_map(found: DataFrame) -> DataFrame:
    """``path``, ``sources``: the sources whose manifest rows name a note; ``found`` are manifest records."""
    each = found.select("source", F.explode(note_targets(F.col("note_cell"))).alias("target")).where("target <> ''")
    path = F.when(F.col("target").endswith(".md"), F.col("target")).otherwise(F.concat("target", F.lit(".md")))
    return each.groupBy(path.alias("path")).agg(F.array_sort(F.collect_set("source")).alias("sources"))


def rewritten(notes: DataFrame, sources: DataFrame, date: str | None = None) -> DataFrame:
    """``path``, ``text``, ``changed``, ``problem`` with the managed block brought up to date.

    ``notes``: path, text, note_type; ``sources``: path, sources.  ``date`` sets
    last_checked, else each note keeps its own.
    """
    rows = without_frontmatter(notes.join(sources, "path", "left")).withColumn("front", F.coalesce("front", F.lit("")))
    none = F.array().cast("array<string>")
    had = F.coalesce("sources", none)
    own = unquoted(F.regexp_extract("front", r"(?m)^last_checked:(.*)$", 1))
    checked = F.lit(date) if date else F.nullif(own, F.lit(""))
    # The managed keys go, with the items below those that are lists.
    scalars, lists = "|".join(SCALARS), "|".join(LISTS)
    free = F.regexp_replace(F.concat("front", F.lit("\n")), rf"(?m)^(?:(?:{scalars})[ \t]*:.*\n|(?:{lists})[ \t]*:.*\n(?:  - .*\n)*)", "")
    free = F.regexp_replace(free, r"\s+\z", "")
    stem = F.regexp_replace(F.substring_index("path", "/", -1), r"\.[^.]*$", "")
    old_aliases, old_tags = list_value(F.col("front"), "aliases"), list_value(F.col("front"), "tags")
    aliases = once(F.when(F.col("note_type") == ALIASED_TYPE, F.concat(old_aliases, F.array(note_title(F.col("body"), stem), stem))).otherwise(old_aliases))
    place = course(F.col("path"))
    tags = once(F.concat(F.filter(old_tags, lambda t: ~t.rlike("^(course|type)/")), F.array(F.concat(F.lit("course/"), tag_value(place)), F.concat(F.lit("type/"), tag_value(F.col("note_type"))))))
    dashes = lambda key, values: F.concat(F.array(F.lit(f"{key}:")), F.transform(values, lambda v: F.concat(F.lit("  - "), quoted(v))))
    listed = lambda key, values, empty: F.when(F.size(values) > 0, dashes(key, values)).otherwise(empty)
    scalar = lambda key, value: F.array(F.concat(F.lit(f"{key}: "), quoted(value)))
    block = F.concat(
        scalar("course", place),
        scalar("note_type", F.col("note_type")),
        listed("aliases", aliases, none),
        listed("source_files", had, F.array(F.lit("source_files: []"))),
        scalar("coverage", coverage(F.col("note_type"), had)),
        scalar("last_checked", checked),
        listed("tags", tags, none),
    )
    head = F.concat(F.when(free == "", "").otherwise(F.concat(free, F.lit("\n\n"))), F.array_join(block, "\n"))
    done = F.concat(F.lit("---\n"), head, F.lit("\n---\n\n"), F.regexp_replace("body", r"^\n+", ""))
    out = rows.withColumn("done", F.when(checked.isNotNull(), done))
    problem = F.when(F.col("text").isNotNull() & F.col("done").isNull(), "missing last_checked")
    return out.select("path", F.coalesce("done", "text").alias("text"), F.coalesce(F.col("done") != F.col("text"), F.lit(False)).alias("changed"), problem.alias("problem"))
