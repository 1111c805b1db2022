"""References to sources in notes: visible references, evidence blocks, page evidence, owners, and example evidence.

``entries`` (``root_relative``) are the source files.  References meet entries
by equality: a backticked path as it stands, a path in running text by its
first run of path characters, after which the text around it decides.

Cases: null texts have no references; a reference that names no entry is
reported by the rules that ask for one and ignored by the others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.functions.markdown import masked_code, masked_comments
from foliospark.operators.courses import masked_lines
from foliospark.operators.frames import by_line, frontmatter, lines, without_frontmatter
from foliospark.operators.policies import declared_type
from foliospark.operators.rules import all_of, issue

# References, page locators, owner labels and example markers.
SOURCE_REF = "`([^`]+\\.(?:pdf|pptx?|PDF|PPTX?))`"
PAGE_EVIDENCE = r"(?i)(?:页\s*/?\s*slide|slide|page|p\.)\s*[:：]?\s*\d+|页\s*[:：]?\s*\d+"
OWNER_MARKERS = ["来源：", "来源:", "对应源资料", "对应源课件", "源资料：", "源课件："]
LIST_ITEM, HEADING = r"^(?:[-+*]|\d{1,9}[.)])(?:\s+|$)", r"^#{1,6}(?:\s+|$)"
EXAMPLE_LABELS, GENERATED = ["源资料例题", "源课件例题"], "生成：PPT/PDF 未提供独立可抽取例题"
EXAMPLE_CONTENT = "例题|例子|练习|worked example"
NO_EXAMPLE, SUPPLEMENT = "未提供独立|没有独立|无独立|不再据此声称", "## PPT/PDF 页级补充索引"
RESIDUAL = "需复核|人工确认|人工打开|手动打开"
NOT_NOTES = ["source_manifest.md", "99_内容覆盖审查.md"]
WORD = r"\p{L}\p{N}_/.\-"


def normal_ref(value: Column) -> Column:
    """A path as references are compared: forward slashes, no leading ``./``."""
    return F.regexp_replace(F.trim(F.replace(value, F.lit("\\"), F.lit("/"))), r"^(?:\./)+", "")


def visible_references(notes: DataFrame) -> DataFrame:
    """``path``, ``line_no``, ``ref``: backticked source files outside block code and comments.

    Only the backticks of references are taken off before code is masked, so
    that the references stay while fenced and indented code goes.
    """
    held = notes.where(F.col("text").rlike(SOURCE_REF))
    masked = masked_comments(masked_code(F.regexp_replace("text", SOURCE_REF, " $1 "))["masked"])
    both = held.select("path", "text", masked.alias("m"))
    each = both.select("path", F.posexplode(F.split("text", "\r\n|\r|\n")).alias("i", "raw"), F.split("m", "\r\n|\r|\n").alias("lines"))
    refs = each.select("path", (F.col("i") + 1).alias("line_no"), F.explode(F.regexp_extract_all("raw", F.lit(SOURCE_REF), F.lit(1))).alias("ref"), F.get("lines", F.col("i")).alias("line"))
    return refs.where(F.contains("line", F.col("ref"))).select("path", "line_no", "ref")


def evidence_blocks(notes: DataFrame) -> DataFrame:
    """``path``, ``line_no`` (first line), ``block``: paragraphs, list items, and single table rows and headings; code blocks break them."""
    rows = masked_lines(notes)
    logical = F.regexp_replace(F.trim("raw"), r"^(?:>\s*)+", "")
    marked = rows.withColumns(
        {
            "blank": ~F.col("line").rlike(r"(?U)\S"),
            "alone": (logical.contains("|") & (logical.startswith("|") | logical.endswith("|"))) | logical.rlike(HEADING),
            "item": logical.rlike(LIST_ITEM),
        }
    )
    last = lambda c: F.coalesce(F.lag(c).over(by_line()), F.lit(True))
    starts = F.col("alone") | F.col("item") | last("blank") | last("alone")
    numbered = marked.withColumn("starts", starts).where("not blank").withColumn("nth", F.sum(F.col("starts").cast("int")).over(by_line().rowsBetween(Window.unboundedPreceding, 0)))
    parts = F.array_sort(F.collect_list(F.struct("line_no", "raw")))
    grouped = numbered.groupBy("path", "nth").agg(parts.alias("p"))
    return grouped.select("path", F.element_at("p", 1)["line_no"].alias("line_no"), F.array_join(F.transform("p", lambda x: x["raw"]), "\n").alias("block"))


#: Entries up to which their keys are sent to every task; above, both sides are dealt by key.
BROADCAST_ENTRIES = 500_000


def _named(rows: DataFrame, text: str, place: list[str], entries: DataFrame) -> DataFrame:
    """Rows (``place`` names one) joined with the entries whose path stands in ``text`` with no path character around it.

    Only keys travel first: the distinct runs of path characters of a row meet
    the entries, and the few rows that meet one get their text back to be looked
    at closely.
    """
    slashed = F.replace(F.col(text), F.lit("\\"), F.lit("/"))
    keyed = entries.select(normal_ref(F.col("root_relative")).alias("source")).distinct().withColumn("key", F.regexp_extract("source", f"([{WORD}]+)", 1))
    small = keyed.limit(BROADCAST_ENTRIES + 1).count() <= BROADCAST_ENTRIES
    tokens = rows.select(*place, F.explode(F.array_distinct(F.regexp_extract_all(slashed, F.lit(f"[{WORD}]+"), F.lit(0)))).alias("key"))
    met = tokens.join(F.broadcast(keyed) if small else keyed.hint("merge"), "key").select(*place, "source").distinct()
    edge = F.concat(F.lit(f"(?<![{WORD}])\\Q"), "source", F.lit(f"\\E(?![{WORD}])"))
    return rows.select(*place, slashed.alias("folio_text")).hint("merge").join(met, place).where(F.regexp_like("folio_text", edge)).drop("folio_text")


def page_evidence(notes: DataFrame, entries: DataFrame) -> DataFrame:
    """``path``, ``source`` where one block of the note names the source's path and a page or slide."""
    blocks = evidence_blocks(notes).where(F.col("block").rlike(PAGE_EVIDENCE))
    return _named(blocks, "block", ["path", "line_no"], entries).select("path", "source").distinct()


def mentions(corpora: DataFrame, entries: DataFrame) -> DataFrame:
    """``path``, ``source`` where the text names the source's path, delimited."""
    return _named(corpora.select("path", "text"), "text", ["path"], entries).select("path", "source").distinct()


def owner_conflicts(notes: DataFrame, entries: DataFrame, allowed: DataFrame) -> DataFrame:
    """Lines labelled as a source's owner that name an entry outside the note's own sources (``allowed``: path, source)."""
    held = notes.where(F.col("text").rlike("|".join(OWNER_MARKERS)))
    rows = lines(held).where(F.col("line").rlike("|".join(OWNER_MARKERS)))
    refs = rows.select("path", "line_no", F.explode(F.regexp_extract_all("line", F.lit(SOURCE_REF), F.lit(1))).alias("raw")).withColumn("source", normal_ref(F.col("raw")))
    known = refs.join(entries.select(normal_ref(F.col("root_relative")).alias("source")).distinct(), "source", "left_semi")
    wrong = known.join(allowed.select("path", normal_ref(F.col("source")).alias("source")).distinct(), ["path", "source"], "left_anti")
    return issue(wrong, "owner_conflict", F.col("source"), F.col("line_no"))


def paper_sources(notes: DataFrame, entries: DataFrame) -> DataFrame:
    """Paper notes without sources, with sources that do not exist or leave the root, and citations that are undeclared or ambiguous."""
    papers = notes.where(declared_type(F.col("text")) == "paper_note")
    lists = frontmatter(papers).select("path", F.explode("lists").alias("l")).where("l.key = 'source_files'").select("path", F.explode("l.value").alias("raw")).where("raw <> ''")
    outside = F.col("source").startswith("/") | F.col("source").rlike(r"(^|/)\.\.(/|$)|^[A-Za-z]:")
    local = lambda rows: rows.withColumn("source", normal_ref(F.col("raw"))).where(~F.col("source").rlike("^(?:https?://|mailto:)"))
    known = entries.select(normal_ref(F.col("root_relative")).alias("source")).distinct()
    base = F.substring_index("source", "/", -1)
    declared = local(lists).distinct()
    cited = local(without_frontmatter(papers).select("path", F.explode(F.regexp_extract_all("body", F.lit(SOURCE_REF), F.lit(1))).alias("raw")))
    both = declared.withColumn("cited", F.lit(False)).unionByName(cited.withColumn("cited", F.lit(True)))
    there = both.where(~outside).join(known.withColumn("there", F.lit(True)), "source", "left")
    missing = there.where("there is null")
    names = known.groupBy(base.alias("base")).agg(F.count("*").alias("alike"))
    own = declared.select("path", "source").distinct()
    same = own.groupBy("path", base.alias("base")).agg(F.count("*").alias("declared"))
    free = there.where("there and cited").join(own, ["path", "source"], "left_anti").withColumn("base", base).join(names, "base").join(same, ["path", "base"], "left")
    return all_of(
        issue(papers.join(lists, "path", "left_anti"), "paper_source_missing", F.lit("no source_files")),
        issue(both.where(outside), "paper_source_outside_root", F.col("raw")),
        issue(missing, "paper_source_not_found", F.col("raw")),
        issue(free.where("alike > 1"), "paper_source_ambiguous_basename", F.col("base")),
        issue(free.where("alike <= 1 and coalesce(declared, 0) <> 1"), "paper_source_not_declared", F.col("raw")),
    )


def example_evidence(notes: DataFrame) -> DataFrame:
    """Supplement bullets without their fields or an example, example lines without a source, review left-overs, and folders without any example."""
    placed = notes.select("path", F.regexp_replace("path", "/[^/]*$", "").alias("dir"), F.substring_index("path", "/", -1).alias("name"), F.coalesce("text", F.lit("")).alias("text"))
    own = placed.where(~F.col("name").isin(NOT_NOTES))
    labels = "|".join(EXAMPLE_LABELS)
    words = "|".join([labels, GENERATED, "生成辅助题", "补充题（/", SUPPLEMENT, RESIDUAL])
    rows = lines(own.where(F.col("text").rlike(words)))
    head = F.when(F.col("line").startswith("## "), F.trim("line"))
    rows = rows.withColumn("section", F.last(head, ignorenulls=True).over(by_line().rowsBetween(Window.unboundedPreceding, 0))).where(~F.col("line").startswith("## "))
    bullet = F.coalesce(F.col("section") == SUPPLEMENT, F.lit(False)) & F.col("line").startswith("- ")
    says = lambda *parts: F.col("line").rlike("|".join(rf"\Q{p}\E" for p in parts))
    heading = F.col("line").rlike(r"^\s*#")
    labelled, generated = F.col("line").rlike(labels), says(GENERATED)
    fields = says("来源：`") & says("页/slide：") & says("主题：")
    sourced = (labelled & (says("（/", "来源：`", "源资料：`") | heading)) | (generated & (says("补充题（/", "来源说明") | heading))
    checks = F.array(
        F.when(bullet & ~fields, "bad_supplement_fields"),
        F.when(bullet & ~sourced, "bad_supplement_example"),
        F.when(labelled & ~heading & ~says("（/", "源资料：`"), "bad_source_example"),
        F.when(says("生成辅助题", "补充题（/") & ~generated & ~labelled, "bad_generated_example"),
        F.when(F.col("line").rlike(RESIDUAL), "residual_manual_review_marker"),
    )
    found = rows.select("path", "line_no", F.explode(F.filter(checks, lambda x: x.isNotNull())).alias("rule"))
    # A folder has evidence if one of its notes speaks of examples outside second-level headings.
    bare = F.regexp_replace("text", r"(?m)^## .*$", "")
    speaks = bare.rlike(f"(?i){EXAMPLE_CONTENT}") | bare.rlike("|".join([labels, GENERATED, "生成辅助题", "补充题（/"]))
    per = own.groupBy("dir").agg(F.bool_or(speaks).alias("speaks"))
    boundary = placed.where(F.col("name").isin(NOT_NOTES)).groupBy("dir").agg((F.bool_or(F.col("text").rlike(NO_EXAMPLE)) & F.bool_or(F.col("text").contains("例题"))).alias("bounded"))
    silent = per.where("not speaks").join(boundary.where("bounded"), "dir", "left_anti")
    return all_of(
        found.select("rule", F.col("path").cast("string").alias("path"), F.col("line_no").cast("int").alias("line_no"), F.lit("line").alias("message")),
        issue(silent.select(F.col("dir").alias("path")), "no_example_evidence", F.lit("folder")),
    )
