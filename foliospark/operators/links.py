"""Links between notes: extraction, tiered resolution, inventories, traversal.

Resolution is an equi-join: each link gives its candidate keys in order of
precedence, each note gives the keys it answers to, and the first tier with a
match decides.  No pair of notes is ever compared.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliospark.functions.markdown import markdown_links as inline_links
from foliospark.functions.markdown import masked_code, without_code
from foliospark.functions.text import nfkc, slug, stem_key, unescaped
from foliospark.session import written

WIKI = r"(?<!!)\[\[([^\]]+)\]\]"
PATTERN = r"(?<!!)\[[^\]]*\]\(([^)\s]+)[^)]*\)"


def wikilinks(notes: DataFrame, text: str = "text") -> DataFrame:
    """``path``, ``pos``, ``raw``, ``target``, ``fragment`` outside code; embeds do not count, aliases are cut."""
    held = notes.where(F.contains(text, F.lit("[["))).select("path", without_code(F.col(text)).alias("folio_text"))
    each = held.select("path", F.posexplode(F.regexp_extract_all("folio_text", F.lit(WIKI), F.lit(1))).alias("pos", "raw"))
    bare = F.trim(F.substring_index("raw", "|", 1))
    return each.select("path", "pos", "raw", F.trim(F.substring_index(bare, "#", 1)).alias("target"), F.nullif(F.regexp_extract(bare, "#(.*)$", 1), F.lit("")).alias("fragment"))


def pattern_links(notes: DataFrame, text: str = "text") -> DataFrame:
    """Inline links by a plain pattern, all in the JVM: a destination ends at its first blank, code is not masked."""
    each = notes.select("path", F.posexplode(F.regexp_extract_all(text, F.lit(PATTERN), F.lit(1))).alias("pos", "raw")).where(~F.col("raw").rlike("^[A-Za-z][A-Za-z0-9+.-]*:"))
    kept = F.regexp_replace("raw", r"\+", "%2B")
    target = F.coalesce(F.try_url_decode(F.regexp_extract(kept, "^([^#?]*)", 1)), F.regexp_extract("raw", "^([^#?]*)", 1))
    return each.select("path", "pos", "raw", target.alias("target"), F.nullif(F.regexp_extract("raw", "#(.*)$", 1), F.lit("")).alias("fragment"))


def _decoded(text):
    return F.trim(F.coalesce(F.try_url_decode(F.regexp_replace(unescaped(text), r"\+", "%2B")), unescaped(text)))


def markdown_links(notes: DataFrame, text: str = "text") -> DataFrame:
    """Inline links to other notes, by the tokenizer, outside code: nested labels, escapes, balanced or bracketed destinations.

    An unescaped ``?`` or ``#`` ends the path; escapes are resolved before percent signs.
    """
    held = notes.where(F.contains(text, F.lit("](")))
    each = held.select("path", F.posexplode(inline_links(masked_code(text)["masked"])).alias("pos", "l")).select("path", "pos", F.col("l.target").alias("raw"))
    local = each.where(~F.col("raw").rlike("^(?:[A-Za-z][A-Za-z0-9+.-]*:|//)"))
    split = r"(?s)^((?:[^?#\\]|\\.|\\\z)*)(?:\?[^#]*)?(?:#(.*))?$"
    parts = local.withColumns({"target": _decoded(F.regexp_extract("raw", split, 1)), "fragment": F.nullif(_decoded(F.coalesce(F.regexp_extract("raw", split, 2), F.lit(""))), F.lit(""))})
    return parts.where("target <> '' or fragment is not null").select("path", "pos", "raw", "target", "fragment")


def note_keys(notes: DataFrame) -> DataFrame:
    """``key``, ``hit``: every name that a note answers to - path, path without suffix, name, stem, rooted forms."""
    bare = F.regexp_replace("path", r"\.md$", "")
    name = F.substring_index("path", "/", -1)
    keys = F.array_distinct(F.array("path", bare, name, F.regexp_replace(name, r"\.md$", ""), F.concat(F.lit("/"), bare), F.concat(F.lit("/"), "path")))
    return notes.select(F.explode(keys).alias("key"), F.col("path").alias("hit"))


def resolve_wikilinks(links: DataFrame, notes: DataFrame) -> DataFrame:
    """``path``, ``pos``, ``raw``, ``target``, ``status`` (ok, broken, ambiguous, self), ``hits``, ``hit``.

    A bare name tries its sibling before the vault; a path the root; a leading
    slash the root alone.  Several matches in the first tier that has one are ambiguous.
    """
    clean = F.regexp_replace("target", "^/+", "")
    suffixed = F.when(~clean.endswith(".md"), F.concat(clean, F.lit(".md")))
    folder = F.when(F.contains("path", F.lit("/")), F.concat(F.regexp_replace("path", "/[^/]*$", ""), F.lit("/"))).otherwise(F.lit(None).cast("string"))
    rooted = F.col("target").startswith("/")
    slash = lambda c: F.concat(F.lit("/"), c)
    near = lambda c: F.when(~F.contains(clean, F.lit("/")), F.concat(folder, c))
    tiers = F.when(rooted, F.array(slash(clean), slash(suffixed), clean, suffixed)).otherwise(F.array(near(clean), near(suffixed), clean, suffixed))
    tried = links.where("target <> ''").select("path", "pos", "raw", "target", F.posexplode(tiers).alias("tier", "key")).where("key is not null")
    found = tried.join(note_keys(notes), "key").groupBy("path", "pos", "tier").agg(F.count_distinct("hit").alias("hits"), F.min("hit").alias("hit"))
    first = found.groupBy("path", "pos").agg(F.min_by(F.struct("hits", "hit"), "tier").alias("m"))
    joined = links.where("target <> ''").join(first, ["path", "pos"], "left")
    status = F.when(F.col("m").isNull(), "broken").when(F.col("m.hits") > 1, "ambiguous").when(F.col("m.hit") == F.col("path"), "self").otherwise("ok")
    return joined.select("path", "pos", "raw", "target", "fragment", status.alias("status"), F.coalesce("m.hits", F.lit(0)).alias("hits"), F.when(F.col("m.hits") == 1, F.col("m.hit")).alias("hit"))


def normal_path(path):
    """A relative path without ``.`` and ``..`` steps."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    empty = F.array().cast("array<string>")
    steps = F.aggregate(parts, empty, lambda a, p: F.when((p == "..") & (F.size(a) > 0), F.slice(a, F.lit(1), F.size(a) - 1)).otherwise(F.concat(a, F.array(p))))
    return F.array_join(steps, "/")


def resolve_markdown(links: DataFrame, notes: DataFrame) -> DataFrame:
    """Inline links seen from their note's folder only; a leading slash means the root."""
    folder = F.when(F.contains("path", F.lit("/")), F.regexp_replace("path", "/[^/]*$", "")).otherwise("")
    where = F.when(F.col("target").startswith("/"), F.col("target")).otherwise(F.concat_ws("/", folder, "target"))
    keyed = links.withColumn("key", F.when(F.col("target") == "", F.col("path")).otherwise(normal_path(where)))
    keys = notes.select(F.col("path").alias("hit"), F.explode(F.array_distinct(F.array("path", F.regexp_replace("path", r"\.md$", "")))).alias("key"))
    joined = keyed.join(keys, "key", "left")
    status = F.when(F.col("hit").isNull(), "broken").when((F.col("hit") == F.col("path")) & (F.col("target") != ""), "self").otherwise("ok")
    return joined.select("path", "pos", "raw", "target", "fragment", status.alias("status"), "hit")


def anchors(headings: DataFrame) -> DataFrame:
    """``path``, ``anchor_key``: all names that a heading answers to.

    The title in lower case, its slug, the slug with ``-n`` from the second of a
    kind on, and an explicit id, both as it stands (in lower case) and as a slug.
    """
    mark = r"\{#([^}\s]+)\}\s*$"
    split = headings.withColumns({"explicit": F.regexp_extract("title", mark, 1), "bare": F.trim(F.regexp_replace("title", r"\s*" + mark, ""))})
    normal = split.withColumn("slug", slug(nfkc("bare")))
    nth = F.row_number().over(Window.partitionBy("path", "slug").orderBy("line_no")) - 1
    again = F.when((nth > 0) & (F.col("slug") != ""), F.concat_ws("-", "slug", nth.cast("string")))
    named = normal.withColumn("again", again)
    keys = F.array(F.lower("bare"), "slug", F.lower("explicit"), slug(nfkc("explicit")), "again")
    return named.select("path", F.explode(F.filter(keys, lambda k: k.isNotNull() & (k != ""))).alias("anchor_key")).distinct()


def missing_anchors(resolved: DataFrame, headings: DataFrame) -> DataFrame:
    """Resolved links whose fragment, neither in lower case nor as a slug, is a name of a heading of their target; ``anchor_key`` is the slug."""
    wanted = resolved.where("hit is not null and fragment is not null")
    plain = F.trim(F.coalesce(F.try_url_decode(F.replace("fragment", F.lit("+"), F.lit("%2B"))), "fragment"))
    wanted = wanted.withColumns({"plain": F.lower(plain), "anchor_key": slug(nfkc(plain))})
    keys = anchors(headings).withColumnRenamed("path", "hit")
    unnamed = wanted.join(keys, ["hit", "anchor_key"], "left_anti")
    return unnamed.join(keys.withColumnRenamed("anchor_key", "plain"), ["hit", "plain"], "left_anti").drop("plain")


def inventory(links: DataFrame, group: str, subgroup: str) -> DataFrame:
    """Links and distinct targets per ``subgroup``, per ``group`` and in total, in one pass of grouping sets."""
    links.createOrReplaceTempView("folio_links")
    return links.sparkSession.sql(
        f"SELECT {group}, {subgroup}, count(*) AS total_links, count(DISTINCT target) AS unique_targets "
        f"FROM folio_links GROUP BY GROUPING SETS (({group}, {subgroup}), ({group}), ())"
    )


def duplicate_stems(notes: DataFrame) -> DataFrame:
    """Stems of several notes; bridge notes, short pages that point to a new place, do not count."""
    bridge = (F.length("text") <= 260) & F.col("text").rlike(r"本页保留旧路径，正文请读 \[\[[^\]]+\]\]。")
    stem = stem_key(F.regexp_replace(F.substring_index("path", "/", -1), r"\.md$", ""))
    return notes.where(~bridge).groupBy(stem.alias("stem")).agg(F.count("*").alias("notes"), F.min("path").alias("first_path")).where("notes > 1")


def reach(edges: DataFrame, start: DataFrame, depth: int) -> DataFrame:
    """Breadth-first: ``src``, ``dst``, ``steps`` (the least) of what ``start`` (src) reaches in at most ``depth`` links.

    ``depth`` joins, each of the last round's front only; every front is written
    before it is joined, so the plan does not grow with the depth.
    """
    hops = written(edges.select(F.col("src").alias("dst"), F.col("dst").alias("to")).distinct(), "hops")
    seen = front = written(start.select("src", F.col("src").alias("dst"), F.lit(0).alias("steps")).distinct(), "front")
    for step in range(1, depth + 1):
        hop = front.join(hops, "dst").select("src", F.col("to").alias("dst")).distinct()
        front = written(hop.join(seen.select("src", "dst"), ["src", "dst"], "left_anti").withColumn("steps", F.lit(step)), "front")
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def url_citations(notes: DataFrame, urls) -> DataFrame:
    """``url``, ``files``: how many documents cite each URL of the array ``urls``."""
    return notes.select("path", F.explode(urls).alias("url")).groupBy("url").agg(F.count_distinct("path").alias("files"), F.min("path").alias("first_path"))
