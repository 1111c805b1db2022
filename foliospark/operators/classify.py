"""Ordered classifications: the first rule that fits decides."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def first_match(rules: list[tuple[Column, str]], otherwise: str | None = None) -> Column:
    out = F.lit(otherwise)
    for condition, value in reversed(rules):
        out = F.when(condition, F.lit(value)).otherwise(out)
    return out


def note_type(path: Column, declared: Column, valid: list[str]) -> Column:
    """Template paths first, then a valid declared type, then the path's own signs."""
    name = F.lower(F.substring_index(path, "/", -1))
    inferred = first_match(
        [
            (name == "source_manifest.md", "source_manifest"),
            (name == "agent.md", "agent_rule"),
            (name.rlike("覆盖审查|coverage_audit"), "coverage_audit"),
            (name.rlike("精简|compact"), "review_compact"),
            (name.rlike("详细|detailed"), "review_detailed"),
            (name.rlike("考试|exam"), "exam_review"),
            (path.rlike("论文|papers?/"), "paper_note"),
            (name.rlike("导航|index|overview|readme"), "navigation"),
        ],
        "course_note",
    )
    return F.when(path.contains(".obsidian/templates/"), "template").when(declared.isin(valid), declared).otherwise(inferred)


def provenance_status(expected: Column, found: Column, contract: Column) -> Column:
    """missing, exact, contract (digests differ, the contract holds) or mismatch."""
    return first_match([(found.isNull(), "missing"), (found == expected, "exact"), (F.coalesce(contract, F.lit(False)), "contract")], "mismatch")


def checked_state(checked: Column, passed: Column) -> Column:
    """Three values: null where the check was skipped."""
    return F.when(checked, passed)
