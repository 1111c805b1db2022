"""The core gate: every rule about a note's own text in one pass over the notes, its links by joins.

The text is masked once (a second time, for the body, only where there is
frontmatter); the rules are arrays of issues that one ``inline`` opens, so the
pass has no shuffle and a note without a finding leaves nothing behind.

Cases: a null text is an empty one; a null path is left out; every hit of a
marker counts, repeated rows give their issues again; of no notes there are no
issues, and the summary is one row of zeros.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.functions.markdown import masked_plain
from foliospark.functions.text import compact_length, has_control, holds, lines_of
from foliospark.operators.frames import without_frontmatter
from foliospark.operators.policies import code_blocks, python_syntax
from foliospark.operators.rules import issue

# Markers of unfinished work, and the characters that a note of a kind must hold.
RESIDUE = r"需复核|待复核|人工确认|人工打开|手动打开|打开课件确认|TODO|FIXME|TBD|待补|待完善|占位|例题模板|高频答题模板|空话|套话|\.\.\.|�|严格逐句核对补充"
LEAST_CHARS = {"concept_index": 800, "course_note": 600, "paper_note": 2500, "paper_topic_note": 800, "research_method_note": 1500, "review_compact": 1200, "review_detailed": 5000}
SEPARATOR = r"^(?:\|---|\| --)"
MARKERS = RESIDUE.replace("\\", "").split("|")  # as they stand
MAY_BE_CODE = ["`", "~~~", "    ", "\t"]
LINK_RULES = {"broken": "broken_link", "ambiguous": "ambiguous_link", "self": "self_link"}


def _plain(text: Column) -> Column:
    """The text with code blanked in place; texts without a mark of code do not go to Python."""
    may = holds(text, MAY_BE_CODE)
    return F.when(may, masked_plain(F.when(may, text))).otherwise(text)


def _found(rule: str, line_no: Column, message: Column) -> Column:
    return F.struct(F.lit(rule).alias("rule"), line_no.cast("int").alias("line_no"), message.cast("string").alias("message"))


def _times(text: Column, mark: str) -> Column:
    return F.size(F.split(text, mark)) - 1


def _of_lines(text: Column, wanted: list[str], each) -> Column:
    """Issues that ``each`` makes of the numbered lines; texts without one of ``wanted`` are not split."""
    numbered = F.transform(lines_of(text), lambda line, i: F.struct((i + 1).alias("n"), line.alias("line")))
    held = F.filter(numbered, lambda x: holds(x["line"], wanted))
    return F.when(holds(text, wanted), F.flatten(F.transform(held, each)))


def own_issues(notes: DataFrame) -> DataFrame:
    """``rule``, ``path``, ``line_no`` (0: the whole note), ``message`` of all that a note's text shows by itself.

    ``notes``: path, text and, for the least length of its kind, note_type.
    """
    kind = F.col("note_type") if "note_type" in notes.columns else F.lit(None).cast("string")
    rows = without_frontmatter(notes.where("path is not null").select(F.col("path").cast("string").alias("path"), F.coalesce("text", F.lit("")).alias("text"), kind.alias("kind")))
    rows = rows.select("path", "kind", "text", _plain(F.col("text")).alias("prose"), _plain(F.when(F.col("front").isNotNull(), F.col("body"))).alias("prose_body"))
    text, prose, body = F.col("text"), F.col("prose"), F.coalesce("prose_body", "prose")
    least = F.coalesce(*(F.when(F.col("kind") == name, n) for name, n in LEAST_CHARS.items()))
    compact = F.when(least.isNotNull(), compact_length(body))
    guidance = (F.col("path") == "AGENT.md") | F.col("path").startswith("agent/")
    whole = [
        ("empty_file", ~text.rlike(r"(?U)\S"), F.lit("no content")),
        ("conflict_marker", text.contains("<<<<<<<") | (text.contains("=======") & text.contains(">>>>>>>")), F.lit("possible conflict marker")),
        ("unbalanced_fence", _times(text, "```") % 2 == 1, _times(text, "```")),
        ("unbalanced_math", _times(prose, r"\$\$") % 2 == 1, _times(prose, r"\$\$")),
        ("control_character", has_control(text), F.lit("control character")),
        ("shallow_note", compact < least, F.concat(compact.cast("string"), F.lit(" of "), least.cast("string"))),
    ]
    none = F.array().cast("array<struct<rule:string,line_no:int,message:string>>")
    of_note = F.filter(F.array(*(F.when(hit, _found(rule, F.lit(0), message)) for rule, hit, message in whole)), lambda x: x.isNotNull())
    residue = _of_lines(prose, MARKERS, lambda x: F.transform(F.regexp_extract_all(x["line"], F.lit(RESIDUE), F.lit(0)), lambda m: _found("residue", x["n"], m)))
    ruled = _of_lines(text, ["解析："], lambda x: F.when(x["line"].rlike(SEPARATOR), F.array(_found("table_separator", x["n"], F.lit("解析：")))).otherwise(none))
    found = F.flatten(F.array(of_note, F.coalesce(F.when(~guidance, residue), none), F.coalesce(ruled, none)))
    return rows.select("path", F.inline(found)).select("rule", "path", "line_no", "message")


def link_issues(resolved: DataFrame) -> DataFrame:
    """Links (``path``, ``raw``, ``status``) that lead nowhere, to several notes or to their own."""
    rule = F.coalesce(*(F.when(F.col("status") == status, F.lit(name)) for status, name in LINK_RULES.items()))
    named = resolved.withColumn("folio_rule", rule).where("folio_rule is not null")
    return named.select(F.col("folio_rule").alias("rule"), F.col("path").cast("string").alias("path"), F.lit(0).alias("line_no"), F.col("raw").alias("message"))


def code_issues(notes: DataFrame) -> DataFrame:
    """Python blocks that do not parse; only notes with such a block are read by Python."""
    found = code_blocks(notes, "python").withColumn("e", python_syntax("code")).where("e.message is not null")
    return issue(found, "invalid_python", F.col("e.message"), F.col("line_no") + F.col("e.line") - 1)


def core_gate(notes: DataFrame, resolved: DataFrame) -> DataFrame:
    """All issues of the gate: of the texts, of their Python blocks and of the links that ``links.resolve_wikilinks`` placed."""
    return own_issues(notes).unionByName(code_issues(notes)).unionByName(link_issues(resolved))


def summary(notes: DataFrame, issues: DataFrame, resolved: DataFrame) -> DataFrame:
    """One row: ``notes``, ``checked_links``, ``broken_links``, ``ambiguous_links``, ``self_links``, ``core_issues`` and ``passed``."""
    of_notes = notes.where("path is not null").agg(F.count("*").alias("notes"))
    of_links = resolved.agg(F.count("*").alias("checked_links"), *(F.count_if(F.col("status") == status).alias(f"{rule}s") for status, rule in LINK_RULES.items()))
    of_issues = issues.agg(F.count("*").alias("core_issues"))
    one = of_notes.crossJoin(of_links).crossJoin(of_issues)  # one row each
    return one.withColumn("passed", F.col("core_issues") == 0)
