"""Reconciliation of sources, manifests, notes and trees: equi-joins with null tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliospark.operators.many import containing


def tree_diff(old: DataFrame, new: DataFrame, key: str = "path", digest: str = "sha256") -> DataFrame:
    """``key``, ``state``: added, stale, changed or unchanged."""
    a, b = old.select(key, F.col(digest).alias("d_old")), new.select(key, F.col(digest).alias("d_new"))
    state = F.when(F.col("d_old").isNull(), "added").when(F.col("d_new").isNull(), "stale").when(F.col("d_old") != F.col("d_new"), "changed").otherwise("unchanged")
    return a.join(b, key, "full").select(key, state.alias("state"))


def uncovered(required: DataFrame, present: DataFrame, keys: list[str]) -> DataFrame:
    """Required rows that are not present."""
    return required.join(present.select(*keys).distinct(), keys, "left_anti")


def reconcile(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys of either side with ``side``: both, left or right."""
    a, b = left.select(key).distinct().withColumn("l", F.lit(1)), right.select(key).distinct().withColumn("r", F.lit(1))
    side = F.when(F.col("l").isNull(), "right").when(F.col("r").isNull(), "left").otherwise("both")
    return a.join(b, key, "full").select(key, side.alias("side"))


def nearest_ancestor(notes: DataFrame, manifests: DataFrame) -> DataFrame:
    """For (path, dir, source) the manifest of the same source in the note's own or nearest ancestor directory.

    ``notes`` has path, dir, source; ``manifests`` dir, source and any payload
    as ``manifest``.  Ancestors are few per note, so they are exploded and joined by equality.
    """
    parts = F.split("dir", "/")
    depths = F.sequence(F.lit(0), F.size(parts))
    up = F.transform(depths, lambda d: F.struct(d.alias("depth"), F.array_join(F.slice(parts, F.lit(1), d), "/").alias("up")))
    each = notes.where("dir <> ''").select("path", "source", F.inline(up)).union(notes.where("dir = ''").select("path", "source", F.lit(0), F.lit("")))
    hit = each.join(manifests.select(F.col("dir").alias("up"), "source", "manifest"), ["up", "source"])
    best = hit.groupBy("path", "source").agg(F.max_by(F.struct("up", "manifest"), "depth").alias("m"))
    joined = notes.select("path", "source").join(best, ["path", "source"], "left")
    return joined.select("path", "source", F.col("m.up").alias("manifest_dir"), F.col("m.manifest").alias("manifest"))


def four_way(sources: DataFrame, manifest: DataFrame, audit: DataFrame, notes: DataFrame, key: str = "source") -> DataFrame:
    """Sources with flags for manifest, audit and owning note, where one is missing."""
    out = sources.select(key).distinct()
    for name, side in (("in_manifest", manifest), ("in_audit", audit), ("in_note", notes)):
        out = out.join(side.select(key).distinct().withColumn(name, F.lit(True)), key, "left").withColumn(name, F.coalesce(name, F.lit(False)))
    return out.where("not (in_manifest and in_audit and in_note)")


def matched_references(refs: DataFrame, entries: DataFrame) -> DataFrame:
    """References against entries by path, course path or name, exact or in lower case: ``ref``, ``hits``, ``status``."""
    keys = F.array_distinct(F.flatten(F.transform(F.array("root_relative", "course_relative", "name"), lambda k: F.array(k, F.lower(k)))))
    index = entries.select(F.explode(keys).alias("key"), F.col("root_relative").alias("hit"))
    tried = refs.select("ref", F.explode(F.array_distinct(F.array("ref", F.lower("ref")))).alias("key")).distinct()
    found = tried.join(index, "key", "left").groupBy("ref").agg(F.count_distinct("hit").alias("hits"))
    return found.withColumn("status", F.when(F.col("hits") == 0, "unknown").when(F.col("hits") > 1, "ambiguous").otherwise("ok"))


def contained(passages: DataFrame, docs: DataFrame, tokens: int = 5) -> DataFrame:
    """``item_id``, ``doc_id`` where the document holds the passage's text.

    Both sides are keyed by hashes of ``tokens`` words: the passage's second to
    sixth word, every run of the document; of a shorter passage by fewer.  Runs
    carry ids only; the texts of candidate pairs are joined once, and
    ``contains`` decides.  Words at the passage's ends may be cut in the
    document, so passages of fewer than three words have no key; they are looked
    for together, by one automaton over each document.
    """
    words = lambda t: F.split(F.trim(F.regexp_replace(t, r"\s+", " ")), " ")
    sized = passages.where("text is not null and text <> ''").select("item_id", F.col("text").alias("passage"), words(F.col("text")).alias("w"))
    width = F.least(F.size("w") - 2, F.lit(tokens))
    keyed = sized.where(F.size("w") >= 3).select("item_id", "passage", width.alias("width"), F.xxhash64(F.array_join(F.slice("w", F.lit(2), width), " ")).alias("key"))
    split = docs.where("text is not null").select("doc_id", words(F.col("text")).alias("w"))
    widths = [r[0] for r in keyed.select("width").distinct().collect()]  # at most ``tokens`` numbers
    pairs = None

    def runs_of(n: int) -> DataFrame:
        run = F.transform(F.sequence(F.lit(1), F.size("w") - n + 1), lambda i: F.xxhash64(F.array_join(F.slice("w", i, F.lit(n)), " ")))
        return split.where(F.size("w") >= n).select("doc_id", F.explode(F.array_distinct(run)).alias("key"))

    for n in widths:
        runs = runs_of(n)
        one = runs.join(keyed.where(F.col("width") == n).select("item_id", "key"), "key").select("item_id", "doc_id")
        pairs = one if pairs is None else pairs.unionByName(one)
    found = None
    if pairs is not None:
        held = pairs.distinct().join(keyed.select("item_id", "passage").distinct(), "item_id").join(docs.select("doc_id", "text"), "doc_id")
        found = held.where("contains(text, passage)").select("item_id", "doc_id")
    short = sized.where(F.size("w") < 3).select(F.col("item_id").alias("id"), F.col("passage").alias("text"))
    if not short.isEmpty():
        one = containing(docs, "doc_id", short).select(F.col("id").alias("item_id"), "doc_id")
        found = one if found is None else found.unionByName(one)
    return (found if found is not None else passages.select("item_id").limit(0).join(docs.select("doc_id"))).distinct()


def second_places(rows: DataFrame, key: str) -> DataFrame:
    """Rows whose key an earlier (path, line_no) has, with the first place."""
    first = rows.groupBy(key).agg(F.min(F.struct("path", "line_no")).alias("f"), F.count("*").alias("n")).where("n > 1")
    later = rows.join(first, key).where("struct(path, line_no) > f")
    return later.select(key, "path", "line_no", F.col("f.path").alias("first_path"), F.col("f.line_no").alias("first_line"))


def adjacent_parts(entries: DataFrame) -> DataFrame:
    """Files of one course whose names differ in their number only: ``source``, ``adjacent``."""
    family = F.lower(F.regexp_replace("stem", r"[0-9]+", "#"))
    keyed = entries.select("course", family.alias("family"), F.col("root_relative").alias("source")).where("family like '%#%'")
    line = Window.partitionBy("course", "family").orderBy("source")
    return keyed.select("source", F.lag("source").over(line).alias("before"), F.lead("source").over(line).alias("after")).where("before is not null or after is not null")


def declared_and_found(declared: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """Keys whose declared ``n`` is not the found ``n``; absent ones count as zero."""
    joined = declared.select(key, F.col("n").alias("declared")).join(found.select(key, F.col("n").alias("found")), key, "full")
    return joined.select(key, F.coalesce("declared", F.lit(0)).alias("declared"), F.coalesce("found", F.lit(0)).alias("found")).where("declared <> found")


def keep_first(rows: DataFrame, keys: list[str], weaker: str, pos: str) -> DataFrame:
    """One row per key: a row that is not ``weaker`` replaces an earlier one that is, at the earlier place."""
    best = F.min_by(F.struct(*[c for c in rows.columns if c not in keys]), F.struct(weaker, pos))
    return rows.groupBy(*keys).agg(best.alias("b"), F.min(pos).alias("first_pos")).select(*keys, "b.*", "first_pos")


def category_by_overlap(items: DataFrame, folders: DataFrame) -> DataFrame:
    """``id``, ``folder`` sharing the most tokens (ties: first by name); items without a common token are left out."""
    a, b = items.select("id", F.explode(F.array_distinct("tokens")).alias("t")), folders.select("folder", F.explode(F.array_distinct("tokens")).alias("t"))
    score = a.join(b, "t").groupBy("id", "folder").agg(F.count("*").alias("n"))
    return score.groupBy("id").agg(F.min_by("folder", F.struct((-F.col("n")).alias("n"), "folder")).alias("folder"))


def source_references(entries: DataFrame) -> DataFrame:
    """Adds ``url`` to entries with a ``ref``: a URL as it stands, a local path as a file URL with its blanks and marks escaped."""
    local = F.concat(F.lit("file://"), F.replace(F.url_encode(F.col("ref")), F.lit("%2F"), F.lit("/")))
    return entries.withColumn("url", F.when(F.col("ref").rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), F.col("ref")).otherwise(F.replace(local, F.lit("+"), F.lit("%20"))))


def within_time(rows: DataFrame, scan: str, order: str, seconds: str, budget: float, most: int | None = None) -> DataFrame:
    """Rows of each scan with ``stopped`` for those beyond its total of ``budget`` seconds or its first ``most`` rows."""
    line = Window.partitionBy(scan).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    over = F.sum(seconds).over(line) > budget
    return rows.withColumn("stopped", over if most is None else over | (F.count("*").over(line) > most))
