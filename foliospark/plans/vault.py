"""Queries over a vault projected from the dimension tables.

``NOTES`` makes regions, nations and suppliers into notes with links between
them, known broken, ambiguous and self links among them; the same statement
runs in Spark and in the oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.operators import coverage, frames, links, matching, repetition, rules, state
from foliospark.plans.registry import query, table

NOTES = """
SELECT concat(r_name, '/', r_name, '.md') AS path, concat('# ', r_name, chr(10), chr(10), 'See [[', r_name, ']] and [[Missing ', r_regionkey, ']].', chr(10)) AS text FROM region
UNION ALL SELECT concat(r_name, '/', n_name, '/', n_name, '.md'), concat('# ', n_name, chr(10), chr(10), 'Part of [[', r_name, '|its region]]; read [[overview]] and [up](../', r_name, '.md).', chr(10)) FROM nation JOIN region ON n_regionkey = r_regionkey
UNION ALL SELECT concat(r_name, '/', n_name, '/overview.md'), concat('# Overview', chr(10), chr(10), '[[', n_name, '#History]] and [gone](gone.md), ![[picture]].', chr(10)) FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 2 = 0
UNION ALL SELECT concat(r_name, '/', n_name, '/', s_name, '.md'), concat('# ', s_name, chr(10), chr(10), 'In [[', n_name, ']], [[/', r_name, '/', r_name, ']].', chr(10), '## Contact', chr(10), s_name, chr(10)) FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
"""


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The projected vault, built with DataFrame joins of small dimensions."""
    region, nation, supplier = (table(spark, sf_dir, n) for n in ("region", "nation", "supplier"))
    for name, frame in (("region", region), ("nation", nation), ("supplier", supplier)):
        frame.createOrReplaceTempView(f"folio_{name}")
    sql = NOTES
    for name in ("region", "nation", "supplier"):
        sql = sql.replace(f"FROM {name} ", f"FROM folio_{name} {name} ").replace(f"FROM {name}\n", f"FROM folio_{name} {name}\n").replace(f"JOIN {name} ", f"JOIN folio_{name} {name} ")
    return spark.sql(sql)


_VAULT = f"WITH notes AS ({NOTES}), "
_WIKI = (
    _VAULT
    + r"""
masked AS (SELECT path, regexp_replace(text, '!\[\[[^\]]+\]\]', '', 'g') AS text FROM notes),
a AS (SELECT path, regexp_extract_all(text, '\[\[([^\]]+)\]\]', 1) AS h FROM masked),
w AS (SELECT path, unnest(range(0, len(h)))::INT AS pos, unnest(h) AS raw FROM a),
l AS (SELECT path, pos, raw, trim(string_split(string_split(raw, '|')[1], '#')[1]) AS target FROM w),
keys AS (SELECT DISTINCT unnest([path, regexp_replace(path, '\.md$', ''), regexp_extract(path, '[^/]*$'), regexp_replace(regexp_extract(path, '[^/]*$'), '\.md$', ''), '/' || regexp_replace(path, '\.md$', ''), '/' || path]) AS key, path AS hit FROM notes),
c AS (SELECT path, pos, target, regexp_replace(target, '^/+', '') AS clean, regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir FROM l),
t AS (SELECT path, pos, unnest([0, 1, 2, 3]) AS tier, unnest(CASE WHEN target LIKE '/%' THEN ['/' || clean, '/' || clean || '.md', clean, clean || '.md']
  WHEN contains(clean, '/') THEN [NULL, NULL, clean, clean || '.md'] ELSE [dir || '/' || clean, dir || '/' || clean || '.md', clean, clean || '.md'] END) AS key FROM c),
f AS (SELECT path, pos, tier, count(DISTINCT hit) AS hits, min(hit) AS hit FROM t JOIN keys USING (key) GROUP BY ALL),
b AS (SELECT path, pos, arg_min(hits, tier) AS hits, arg_min(hit, tier) AS hit FROM f GROUP BY ALL),
r AS (SELECT l.path, l.pos, raw, coalesce(hits, 0) AS hits, CASE WHEN hits IS NULL THEN 'broken' WHEN hits > 1 THEN 'ambiguous' WHEN hit = l.path THEN 'self' ELSE 'ok' END AS status, CASE WHEN hits = 1 THEN hit END AS hit
  FROM l LEFT JOIN b ON l.path = b.path AND l.pos = b.pos)
"""
)


def _resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = notes(spark, sf_dir)
    return links.resolve_wikilinks(links.wikilinks(rows), rows)


@query(_WIKI + "SELECT path, pos, raw, status, hits, coalesce(hit, '') AS hit FROM r")
def vault_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every wikilink with the outcome of the tiered resolution."""
    return _resolved(spark, sf_dir).select("path", "pos", "raw", "status", "hits", F.coalesce("hit", F.lit("")).alias("hit"))


@query(_WIKI + "SELECT path, raw FROM r WHERE status = 'broken'")
def broken_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _resolved(spark, sf_dir).where("status = 'broken'").select("path", "raw")


@query(_WIKI + "SELECT path, raw, hits FROM r WHERE status = 'ambiguous'")
def ambiguous_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _resolved(spark, sf_dir).where("status = 'ambiguous'").select("path", "raw", "hits")


@query(_WIKI + "SELECT path, raw FROM r WHERE status = 'self'")
def self_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _resolved(spark, sf_dir).where("status = 'self'").select("path", "raw")


@query(_WIKI + "SELECT status, count(*) AS n, count(DISTINCT path) AS files FROM r GROUP BY ALL")
def link_status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and notes per outcome."""
    return _resolved(spark, sf_dir).groupBy("status").agg(F.count("*").alias("n"), F.count_distinct("path").alias("files"))


_INLINE = _VAULT + r"""
a AS (SELECT path, regexp_extract_all(text, '[^!]\[[^\]\[]*\]\(([^)\s]+)[^)]*\)', 1) AS h FROM notes),
l AS (SELECT path, unnest(h) AS target FROM a)
SELECT l.path, target, CASE WHEN n.path IS NULL THEN 'broken' ELSE 'ok' END AS status FROM l LEFT JOIN notes n
ON n.path = CASE WHEN target LIKE '../%' THEN regexp_replace(l.path, '/[^/]*/[^/]*$', '') || '/' || substr(target, 4) ELSE regexp_replace(l.path, '/[^/]*$', '') || '/' || target END
"""


@query(_INLINE)
def markdown_link_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inline links between notes, relative to their folder; destinations end at a blank (``inline_link_status`` has the tokenizer)."""
    rows = notes(spark, sf_dir)
    return links.resolve_markdown(links.pattern_links(rows), rows).select("path", "target", "status")


@query(_INLINE.replace(r"'[^!]\[[^\]\[]*\]\(([^)\s]+)[^)]*\)', 1)", r"'[^!]\[[^\]\[]*\]\(([^)\s]+)\)', 1)"))
def inline_link_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inline links by the tokenizer, resolved; a bare destination with a blank in it is no link."""
    rows = notes(spark, sf_dir)
    return links.resolve_markdown(links.markdown_links(rows), rows).select("path", "target", "status")


@query(_WIKI + ", s AS (SELECT DISTINCT lower(replace(trim(regexp_extract(raw, '#([^|]*)', 1)), ' ', '-')) AS k, hit, path FROM r WHERE status IN ('ok', 'self') AND contains(raw, '#')) SELECT path, hit, k AS anchor_key FROM s WHERE k <> 'overview'")
def missing_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links to headings that their target lacks."""
    found = links.missing_anchors(_resolved(spark, sf_dir), frames.headings(notes(spark, sf_dir), underlined=True))
    return found.select("path", "hit", "anchor_key").distinct()


@query(_VAULT.rstrip(", ") + " SELECT lower(regexp_replace(regexp_extract(path, '[^/]*$'), '\\.md$', '')) AS stem, count(*) AS notes, min(path) AS first_path FROM notes GROUP BY ALL HAVING count(*) > 1")
def duplicate_stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stems that several notes share."""
    return links.duplicate_stems(notes(spark, sf_dir))


@query(_WIKI.replace("WITH ", "WITH RECURSIVE ", 1) + ", e AS (SELECT DISTINCT path AS src, hit AS dst FROM r WHERE status = 'ok'), reach(src, dst, steps) AS (SELECT path, path, 0 FROM notes WHERE path LIKE '%/Supplier%' UNION SELECT reach.src, e.dst, steps + 1 FROM reach JOIN e ON reach.dst = e.src WHERE steps < 3) SELECT src, dst, min(steps)::INT AS steps FROM reach GROUP BY ALL")
def link_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes that supplier notes reach in at most three links."""
    edges = _resolved(spark, sf_dir).where("status = 'ok'").select(F.col("path").alias("src"), F.col("hit").alias("dst")).distinct()
    return links.reach(edges, notes(spark, sf_dir).where("path like '%/Supplier%'").select(F.col("path").alias("src")), 3)


@query(_WIKI + "SELECT DISTINCT n.path FROM notes n LEFT JOIN r ON r.hit = n.path AND r.status = 'ok' WHERE r.path IS NULL")
def orphan_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes that no other note links."""
    linked = _resolved(spark, sf_dir).where("status = 'ok'").select(F.col("hit").alias("path"))
    return coverage.uncovered(notes(spark, sf_dir).select("path"), linked, ["path"])


@query(_VAULT + "l AS (SELECT path, unnest(range(1, len(a) + 1))::INT AS line_no, unnest(a) AS line FROM (SELECT path, string_split(text, chr(10)) AS a FROM notes)) SELECT path, line_no, length(regexp_extract(line, '^(#+)', 1))::INT AS level, trim(regexp_replace(line, '^#+', '')) AS title FROM l WHERE regexp_matches(line, '^#{1,6}\\s+\\S')")
def note_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All headings of the notes."""
    return frames.headings(notes(spark, sf_dir))


@query(_VAULT.rstrip(", ") + " SELECT sha256('Contact') AS skeleton, count(*) AS n, regexp_replace(path, '/[^/]*$', '') AS dir FROM notes WHERE contains(text, '## Contact') GROUP BY ALL HAVING count(*) >= 4")
def shared_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Second-level titles that four notes of one directory share."""
    found = frames.headings(notes(spark, sf_dir)).where("level = 2")
    grouped = found.groupBy(F.regexp_replace("path", "/[^/]*$", "").alias("dir"), F.sha2("title", 256).alias("skeleton")).agg(F.count("*").alias("n"))
    return grouped.where(F.col("n") >= repetition.SKELETONS).select("skeleton", "n", "dir")


_PLACES = """
n AS (SELECT concat(r_name, '/', n_name, '/', s_name) AS path, concat(r_name, '/', n_name) AS dir, concat('src', s_suppkey % 3) AS source FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
m AS (SELECT r_name AS dir, 'src0' AS source, concat('region ', r_name) AS manifest FROM region UNION ALL SELECT concat(r_name, '/', n_name), 'src0', concat('nation ', n_name) FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 3 = 0 UNION ALL SELECT '', 'src1', 'root')
"""


@query("WITH " + _PLACES + ", u AS (SELECT path, source, unnest([dir, regexp_extract(dir, '^(.*)/[^/]*$', 1), '']) AS up, unnest([2, 1, 0]) AS depth FROM n), h AS (SELECT u.path, u.source, arg_max(m.dir, depth) AS manifest_dir, arg_max(manifest, depth) AS manifest FROM u JOIN m ON u.up = m.dir AND u.source = m.source GROUP BY ALL) SELECT n.path, n.source, coalesce(manifest_dir, '-') AS manifest_dir, coalesce(manifest, '-') AS manifest FROM n LEFT JOIN h ON n.path = h.path AND n.source = h.source")
def nearest_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each supplier's source the manifest of its own or nearest ancestor directory."""
    region, nation, supplier = (table(spark, sf_dir, n) for n in ("region", "nation", "supplier"))
    places = nation.join(region, nation["n_regionkey"] == region["r_regionkey"])
    folder = F.concat_ws("/", "r_name", "n_name")
    own = supplier.join(places, supplier["s_nationkey"] == places["n_nationkey"]).select(F.concat_ws("/", "r_name", "n_name", "s_name").alias("path"), folder.alias("dir"), F.concat(F.lit("src"), F.col("s_suppkey") % 3).alias("source"))
    manifests = (
        region.select(F.col("r_name").alias("dir"), F.lit("src0").alias("source"), F.concat(F.lit("region "), "r_name").alias("manifest"))
        .union(places.where("n_nationkey % 3 = 0").select(folder, F.lit("src0"), F.concat(F.lit("nation "), "n_name")))
        .union(spark.createDataFrame([("", "src1", "root")], "dir string, source string, manifest string"))
    )
    found = coverage.nearest_ancestor(own, manifests)
    return found.select("path", "source", F.coalesce("manifest_dir", F.lit("-")).alias("manifest_dir"), F.coalesce("manifest", F.lit("-")).alias("manifest"))


@query()
def per_link_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A maximum assignment of suppliers to notes of their nation (augmenting paths have no SQL form)."""
    supplier = table(spark, sf_dir, "supplier")
    edges = supplier.select(F.col("s_suppkey").alias("left"), F.explode(F.array(F.col("s_nationkey") * 4 + F.col("s_suppkey") % 4, F.col("s_nationkey") * 4 + (F.col("s_suppkey") + 1) % 4)).alias("right"))
    return matching.match(edges)


@query("""WITH c AS (SELECT s_nationkey AS n, s_suppkey % 4 AS i, count(*) AS e FROM supplier GROUP BY ALL), g AS (SELECT x.n, y.i, coalesce(e, 0) AS e FROM (SELECT DISTINCT s_nationkey AS n FROM supplier) x CROSS JOIN (SELECT unnest([0, 1, 2, 3]) AS i) y LEFT JOIN c ON c.n = x.n AND c.i = y.i),
a AS (SELECT n, min(i) FILTER (e = 0) AS a, sum(e) AS t FROM g GROUP BY n), r AS (SELECT g.n, (i - a + 4) % 4 AS o, e FROM g JOIN a USING (n) WHERE a IS NOT NULL), s AS (SELECT *, sum((e = 0)::INT) OVER (PARTITION BY n ORDER BY o) AS island FROM r), k AS (SELECT n, island, sum(e) AS t, count(*) FILTER (e > 0) AS m FROM s GROUP BY ALL)
SELECT n AS s_nationkey, sum(least(t, m + 1))::BIGINT AS matched FROM k WHERE m > 0 GROUP BY n UNION ALL SELECT n, least(t, 4)::BIGINT FROM a WHERE a IS NULL""")
def matching_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many suppliers of each nation get a note; the four notes are a ring, whose parts hold as many as they have notes."""
    matched = per_link_matching(spark, sf_dir).where("right is not null").withColumnRenamed("left", "s_suppkey")
    return matched.join(table(spark, sf_dir, "supplier"), "s_suppkey").groupBy("s_nationkey").agg(F.count("*").alias("matched"))


_TEXTS = r"""
SELECT 'a' AS path, '# A' || chr(10) || '### Deep' || chr(10) || 'x' || chr(10) || '# A' || chr(10) || '| a | b |' || chr(10) || '|---|---|' || chr(10) || '| 1 | 2 | 3 |' || chr(10) || '| 1 ' || chr(92) || '| 2 | 3 |' AS text
UNION ALL SELECT 'b', '<<<<<<< mine' || chr(10) || 'TODO later' || chr(10) || '=======' || chr(10) || '>>>>>>> theirs'
UNION ALL SELECT 'c', '   ' UNION ALL SELECT 'd', '=======' || chr(10) || '## Empty'
"""


@query("SELECT * FROM (VALUES ('heading_jump', 'a', 2, 'Deep'), ('duplicate_anchor', 'a', 1, 'A'), ('duplicate_anchor', 'a', 4, 'A'), ('empty_section', 'd', 2, 'Empty'), ('table_columns', 'a', 7, '3 for 2'), ('conflict_marker', 'b', 1, '<<<<<<< mine'), ('conflict_marker', 'b', 3, '======='), ('conflict_marker', 'b', 4, '>>>>>>> theirs'), ('template_residue', 'b', 2, 'TODO'), ('empty_file', 'c', 0, 'no content')) AS t(rule, path, line_no, message)")
def structure_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heading, table, conflict, residue and emptiness rules over a literal fixture."""
    docs = spark.sql(_TEXTS)
    found = frames.headings(docs)
    return rules.all_of(rules.heading_issues(found, frames.lines(docs)), rules.table_issues(docs), rules.conflict_markers(docs), rules.residue(docs), rules.empty_notes(docs))


_STRUCTURE = (
    f"WITH t AS ({_TEXTS}),"
    + r"""
d AS (SELECT CAST(doc_id AS VARCHAR) AS path, CASE WHEN t.path IS NULL THEN o.text ELSE o.text || chr(10) || t.text END AS text FROM documents o LEFT JOIN t ON t.path = substr('-abcd', (doc_id % 5)::INT + 1, 1) UNION ALL SELECT path, text FROM t),
l AS (SELECT path, unnest(range(1, len(a) + 1))::INT AS line_no, unnest(a) AS line, edged FROM (SELECT path, string_split_regex(text, '\r\n|\r|\n') AS a, contains(text, '<<<<<<<') AND contains(text, '>>>>>>>') AS edged FROM d)),
f AS (SELECT *, sum(regexp_matches(line, '^ {0,3}(`{3,}|~{3,})')::INT) OVER (PARTITION BY path ORDER BY line_no ROWS UNBOUNDED PRECEDING) % 2 AS fenced FROM l),
h AS (SELECT path, line_no, length(regexp_extract(line, '^(#{1,6})', 1)) AS level, trim(regexp_extract(line, '^#{1,6}\s+(.+?)\s*$', 1)) AS title FROM f WHERE fenced = 0 AND regexp_matches(line, '^#{1,6}\s+\S')),
g AS (SELECT *, lag(level) OVER w AS before, lead(level) OVER w AS next_level, lead(line_no) OVER w AS next_line, regexp_replace(lower(trim(regexp_replace(title, '\s+', ' ', 'g'))), '\]', '', 'g') AS anchor FROM h WINDOW w AS (PARTITION BY path ORDER BY line_no)),
c AS (SELECT *, line LIKE '|%' AND line LIKE '%|' AS is_row, regexp_matches(line, '^\|(\s*:?-+:?\s*\|)+$') AS is_rule, len(string_split(regexp_replace(regexp_replace(line, '\\\\|\\\|', '', 'g'), '^\||\|$', '', 'g'), '|')) AS cells FROM l),
i AS (SELECT *, sum((NOT is_row)::INT) OVER (w ROWS UNBOUNDED PRECEDING) AS island, is_row AND coalesce(lead(is_rule) OVER w, false) AS head FROM c WINDOW w AS (PARTITION BY path ORDER BY line_no)),
e AS (SELECT *, last_value(CASE WHEN head THEN cells END IGNORE NULLS) OVER (PARTITION BY path, island ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS expected FROM i)
SELECT 'heading_jump' AS rule, path, line_no, title AS message FROM g WHERE level - before > 1
UNION ALL SELECT 'duplicate_anchor', path, line_no, title FROM g WHERE level <= 2 AND (path, anchor) IN (SELECT (path, anchor) FROM g GROUP BY path, anchor HAVING count(*) > 1)
UNION ALL SELECT 'empty_section', path, line_no, title FROM g WHERE (next_level IS NULL OR next_level <= level) AND NOT EXISTS (SELECT 1 FROM l WHERE l.path = g.path AND l.line_no > g.line_no AND (g.next_line IS NULL OR l.line_no < g.next_line) AND trim(l.line) <> '')
UNION ALL SELECT 'table_columns', path, line_no, cells || ' for ' || expected FROM e WHERE is_row AND NOT head AND cells <> expected
UNION ALL SELECT 'conflict_marker', path, line_no, line FROM l WHERE line LIKE '<<<<<<<%' OR line LIKE '>>>>>>>%' OR line LIKE '=======%' AND edged
UNION ALL SELECT 'template_residue', path, line_no, regexp_extract(line, '相关知识链接|TODO|FIXME|TBD|待补|待完善') FROM l WHERE regexp_matches(line, '相关知识链接|TODO|FIXME|TBD|待补|待完善')
UNION ALL SELECT 'empty_file', path, 0, 'no content' FROM d WHERE trim(text) = ''
"""
)


@query(_STRUCTURE)
def document_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules of ``structure_rules`` over all documents, four in five of which end with one of the fixture's notes, and over the fixture."""
    fixture = spark.sql(_TEXTS)
    tails = F.broadcast(fixture.select(F.col("path").alias("tail"), F.col("text").alias("more")))
    ended = table(spark, sf_dir, "documents").withColumn("tail", F.expr("substr('-abcd', cast(doc_id % 5 as int) + 1, 1)")).join(tails, "tail", "left")
    text = F.when(F.col("more").isNull(), F.col("text")).otherwise(F.concat("text", F.lit("\n"), "more"))
    docs = ended.select(F.col("doc_id").cast("string").alias("path"), text.alias("text")).union(fixture)
    found = frames.headings(docs)
    return rules.all_of(rules.heading_issues(found, frames.lines(docs)), rules.table_issues(docs), rules.conflict_markers(docs), rules.residue(docs), rules.empty_notes(docs))


@query("SELECT rule, count(*) AS n, count(DISTINCT path) AS files FROM (" + _STRUCTURE + ") GROUP BY rule")
def issue_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues of ``document_structure`` by code."""
    return document_structure(spark, sf_dir).groupBy("rule").agg(F.count("*").alias("n"), F.count_distinct("path").alias("files"))


@query(_VAULT + "k AS (SELECT path, regexp_extract(path, '[^/]*$') AS stem FROM notes), c AS (SELECT *, row_number() OVER (PARTITION BY lower(stem) ORDER BY path) AS i FROM k) SELECT path, CASE WHEN i = 1 THEN stem ELSE stem || '_' || substr(sha256(path), 1, 10) END AS out_name FROM c")
def stable_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Output names without clashes: the first keeps its stem."""
    return state.stable_names(notes(spark, sf_dir).select("path", F.substring_index("path", "/", -1).alias("stem")), "stem", "path").select("path", "out_name")
