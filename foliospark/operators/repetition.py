"""Repetition across and within documents: group, count, keep what passes a threshold.

Long texts are grouped by digest, so a shuffle carries 32 bytes and not the
text; the text shown is the least location's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# How often a text may be repeated.
IN_FILE, ACROSS, OPENINGS, LIST_ITEMS, SENTENCES, SKELETONS, SECTION_NAMES = 3, 5, 4, 4, 5, 4, 6


def repeated(rows: DataFrame, text: str, place: str = "line_no") -> DataFrame:
    """``context``, ``count``, ``files`` (distinct), ``path`` and ``line_no`` of the first place, per distinct text."""
    first = F.min(F.struct("path", F.col(place).alias("line_no"), F.substring(text, 1, 180).alias("context")))
    grouped = rows.groupBy(F.sha2(text, 256).alias("digest")).agg(F.count("*").alias("count"), F.min("path").alias("low"), F.max("path").alias("high"), first.alias("f"))
    return grouped.select("digest", F.col("f.context").alias("context"), "count", F.col("f.path").alias("path"), F.col("f.line_no").alias("line_no"), (F.col("low") == F.col("high")).alias("one_file"))


def in_file(rows: DataFrame, text: str, least: int = IN_FILE) -> DataFrame:
    """Repeated in one document and in no other."""
    return repeated(rows, text).where((F.col("count") >= least) & F.col("one_file"))


def across(rows: DataFrame, text: str, least: int = ACROSS, in_file_least: int = IN_FILE) -> DataFrame:
    """Repeated otherwise."""
    return repeated(rows, text).where((F.col("count") >= least) & ~((F.col("count") >= in_file_least) & F.col("one_file")))


def shared(rows: DataFrame, text: str, least: int) -> DataFrame:
    """Repeated anywhere, openings or list items."""
    return repeated(rows, text).where(F.col("count") >= least)


def in_files(rows: DataFrame, text: str, least: int = SENTENCES) -> DataFrame:
    """In at least so many documents; distinct documents are counted after map-side distinct."""
    pairs = rows.groupBy(F.sha2(text, 256).alias("digest"), "path").agg(F.count("*").alias("n"), F.min(F.substring(text, 1, 180)).alias("context"))
    return pairs.groupBy("digest").agg(F.count("*").alias("files"), F.sum("n").alias("count"), F.min("path").alias("path"), F.min("context").alias("context")).where(F.col("files") >= least)


def shared_skeletons(headings: DataFrame, allowed: Column, least: int = SKELETONS) -> DataFrame:
    """Second-level heading sequences of three or more that documents of one directory share; intentional if all are ``allowed``."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("line_no", "title"))), lambda h: h["title"])
    per_note = headings.where("level = 2").groupBy("path").agg(ordered.alias("skeleton")).where(F.size("skeleton") >= 3)
    grouped = per_note.groupBy(F.regexp_replace("path", "/[^/]*$", "").alias("dir"), "skeleton").agg(F.count("*").alias("count"), F.min("path").alias("path"), F.bool_and(allowed).alias("intentional"))
    return grouped.where(F.col("count") >= least)


def roll_up(candidates: DataFrame) -> DataFrame:
    """Candidates of all kinds: ``kind``, ``count``, number of distinct files named."""
    return candidates.groupBy("kind").agg(F.count("*").alias("count"), F.countDistinct("path").alias("files"))
