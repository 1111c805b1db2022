"""Source manifests: tables of source files in notes, their contract and their closure with the notes.

Rows are cut out of a manifest's own array of lines, so parsing never shuffles;
only duplicate sources and link resolution group by key.

Cases: null and empty texts have no rows; a table without rows is one issue;
cells that are missing are nulls of the record; repeated manifests give repeated rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.functions.text import lines_of, valid_date
from foliospark.operators.classify import first_match
from foliospark.operators.links import WIKI, resolve_wikilinks
from foliospark.operators.rules import issue

# Headers, evidence states and words of the manifest contract.
HEADER = "| 源文件 | 类型 | 页/slide/记录数 | 抽取方式 | 对应笔记 | 覆盖状态 | 例题状态 | 限制说明 | 最后检查日期 |"
HEADER_START = "| 源文件 |"
RULE = "|---|---|---:|---|---|---|---|---|---|"
WEB_HEADER = "| 来源 | URL | 类型 | 访问状态 | 用途 |"
STALE_TERMS = ["99_内容覆盖审查", "覆盖审查页", "覆盖审查表", "逐页审查表", "审查表", "审查页"]
FORBIDDEN_NOTE = "99_内容覆盖审查.md"
FORBIDDEN_TYPES = ["audit_record", "coverage_audit", "global_coverage_audit", "source_manifest_history", "vault_audit"]
SUPPORT_DIRS = [".github", "agent", "scripts", "tests"]
EVIDENCE_STATES = ["已映射：", "仅映射：", "未核验："]
BLANKET_EXAMPLES = "已在章节笔记配置源资料例题或生成补充题"
STRONG_CLAIMS = "可抽取文本已覆盖|语义覆盖完成|完整覆盖|已全部覆盖"
AGGREGATE_WORDS = "聚合|范围级|汇总"
RANGE_WORDS = "聚合|范围"
VISUAL_WORDS = "OCR|视觉|图片|图表|图示|版式"
FIELDS = ["source_cell", "kind", "count_cell", "method", "note_cell", "status", "example_status", "limitations", "checked"]
INACCESSIBLE = "inaccessible|blocked|paywalled|skipped|failed|error|http_|login_required|timeout|network_error|parse_error"
NO_ERROR = ["", "-", "none", "n/a", "ok"]


def row_cells(line: Column) -> Column:
    """Cells of a piped row, trimmed; none unless a bar opens and closes it."""
    inner = F.regexp_replace(line, r"^\|+|\|+$", "")
    return F.when(line.startswith("|") & line.endswith("|"), F.transform(F.split(inner, r"\|"), lambda c: F.trim(c))).otherwise(F.array().cast("array<string>"))


def escaped_cells(line: Column) -> Column:
    """Cells of a row whose bars may be escaped by a backslash; escapes are resolved."""
    inner = F.regexp_replace(F.trim(line), r"^\||(?<!\\)\|$", "")
    parts = F.regexp_extract_all(F.concat(inner, F.lit("|")), F.lit(r"((?:\\.|[^\\|])*)\|"), F.lit(1))
    return F.transform(parts, lambda c: F.trim(F.regexp_replace(c, r"\\([!-/:-@\[-`{-~])", "$1")))


def _table(notes: DataFrame, is_header) -> DataFrame:
    """``path``, ``line_no``, ``line`` from the first header to the first line without a bar."""
    rows = lines_of(F.col("text"))
    head = F.array_position(F.transform(rows, lambda x: F.coalesce(is_header(x), F.lit(False))), True).cast("int")
    rest = F.slice(rows, head + 1, F.size(rows))
    stop = F.array_position(F.transform(rest, lambda x: ~x.startswith("|")), True).cast("int")
    body = F.slice(rest, F.lit(1), F.when(stop > 0, stop - 1).otherwise(F.size(rest)))
    found = notes.select("path", head.alias("head"), F.when(head > 0, body).alias("body")).where("head > 0")
    each = found.select("path", "head", F.posexplode("body").alias("i", "line"))
    return each.where(~F.col("line").startswith("|---") & ~is_header(F.col("line"))).select("path", (F.col("head") + F.col("i") + 1).cast("int").alias("line_no"), "line")


def local_rows(notes: DataFrame) -> DataFrame:
    """``path``, ``line_no``, ``cells`` of the table of source files."""
    return _table(notes, lambda x: x.startswith(HEADER_START)).select("path", "line_no", row_cells(F.col("line")).alias("cells"))


def web_rows(notes: DataFrame) -> DataFrame:
    """``path``, ``line_no``, ``cells`` of the table of web sources."""
    return _table(notes, lambda x: x == WEB_HEADER).select("path", "line_no", row_cells(F.col("line")).alias("cells")).where("size(cells) > 0")


def records(notes: DataFrame) -> DataFrame:
    """Rows of nine cells: the cells by name, ``source``, ``exact`` (a single code cell) and ``count`` (null unless positive)."""
    full = local_rows(notes).where("size(cells) = 9")
    named = full.select("path", "line_no", *[F.col("cells")[k].alias(name) for k, name in enumerate(FIELDS)])
    exact = F.col("source_cell").rlike("^`[^`]+`$")
    count = F.when(F.col("count_cell").rlike("^[0-9]+$"), F.expr("try_cast(count_cell as bigint)"))
    return named.withColumns({"exact": exact, "source": F.when(exact, F.regexp_replace("source_cell", "`", "")).otherwise(F.col("source_cell")), "count": F.when(count > 0, count)})


def full_identity(source: Column) -> Column:
    """A relative path of two parts or more without parent steps."""
    parts = F.filter(F.split(source, "/"), lambda p: (p != "") & (p != "."))
    return ~source.startswith("/") & (F.size(parts) >= 2) & ~F.array_contains(parts, "..")


def _suffix(source: Column) -> Column:
    return F.lower(F.regexp_extract(F.regexp_extract(source, "([^/]*)/*$", 1), r"^.+(\.[^.]+)$", 1))


def aggregate() -> Column:
    """Whether a record stands for many units at once."""
    return F.lower("method").rlike("legacy-ppt|aggregate") | F.concat("status", "limitations").rlike(AGGREGATE_WORDS)


def record_issues(found: DataFrame, today: Column) -> DataFrame:
    """Issues of each record on its own, and of sources named again in the same manifest."""
    source, kind, method, limits = (F.col(c) for c in ("source", "kind", "method", "limitations"))
    again = F.row_number().over(Window.partitionBy("path", "source").orderBy("line_no")) > 1
    rows = found.withColumns({"whole": F.col("exact") & full_identity(source), "again": again})
    legacy, paged = F.lower(method).contains("legacy-ppt"), F.lower(method).rlike("pdftotext|pptx|slide")
    bounded = F.when(legacy, limits.rlike(RANGE_WORDS) & limits.rlike(VISUAL_WORDS)).when(paged, limits.rlike(VISUAL_WORDS + "|流程箭头")).otherwise(True)
    stated = F.exists(F.array(*map(F.lit, EVIDENCE_STATES)), lambda s: F.startswith(F.col("status"), s))
    checks = [
        ("SOURCE_IDENTITY_INVALID", ~F.col("whole")),
        ("SOURCE_DUPLICATE", F.col("whole") & F.col("again")),
        ("SOURCE_TYPE_INVALID", ~kind.rlike(r"^`\.[A-Za-z0-9]+`$") | (full_identity(source) & (F.lower(F.regexp_replace(kind, "`", "")) != _suffix(source)))),
        ("SOURCE_COUNT_INVALID", F.col("count").isNull()),
        ("EXTRACTION_METHOD_MISSING", method == ""),
        ("MAPPING_LINK_MISSING", F.size(note_targets(F.col("note_cell"))) == 0),
        ("COVERAGE_STATE_INVALID", ~stated),
        ("EXAMPLE_STATE_INVALID", ~F.col("example_status").rlike("例题|补充题") | (F.col("example_status") == BLANKET_EXAMPLES)),
        ("LIMITATIONS_MISSING", limits == ""),
        ("CHECKED_DATE_INVALID", ~valid_date(F.col("checked"), today)),
        ("AGGREGATE_NOT_SEMANTIC_PROOF", aggregate() & F.col("status").rlike(STRONG_CLAIMS)),
        ("LIMITATIONS_INCOMPLETE", (limits != "") & ~bounded),
    ]
    hit = F.filter(F.array(*[F.when(F.coalesce(cond, F.lit(False)), F.lit(code)) for code, cond in checks]), lambda c: c.isNotNull())
    each = rows.select("path", "line_no", "source", F.explode(hit).alias("rule"))
    return each.select("rule", F.col("path").cast("string").alias("path"), "line_no", F.col("source").alias("message"))


def note_targets(cell: Column) -> Column:
    """Distinct link targets of a cell, aliases and fragments cut."""
    raw = F.regexp_extract_all(cell, F.lit(r"\[\[([^\]]+)\]\]"), F.lit(1))
    bare = F.transform(raw, lambda r: F.trim(F.substring_index(F.substring_index(r, "|", 1), "#", 1)))
    return F.array_distinct(F.filter(bare, lambda t: t != ""))


def table_issues(manifests: DataFrame) -> DataFrame:
    """Headers, stale references, wrong numbers of cells, empty tables and web rows of manifests."""
    rows = lines_of(F.col("text"))
    heads = F.filter(rows, lambda x: x.startswith(HEADER_START))
    web = F.array_contains(rows, WEB_HEADER)
    state = manifests.select("path", F.try_element_at(heads, F.lit(1)).alias("head"), web.alias("web"), F.col("text").rlike("|".join(STALE_TERMS)).alias("stale"))
    wrong = first_match([(F.col("head").isNotNull() & (F.col("head") != HEADER), "non-standard header"), (F.col("head").isNull() & ~F.col("web"), "missing header")])
    local, online = local_rows(manifests), web_rows(manifests)
    cells = F.col("cells")
    no_local = state.where("head is not null").join(local.where("size(cells) = 9"), "path", "left_anti")
    no_web = state.where("web").join(online, "path", "left_anti")
    five = online.where("size(cells) = 5")
    parts = [
        issue(state.withColumn("m", wrong).where("m is not null"), "MANIFEST_HEADER_INVALID", F.col("m")),
        issue(state.where("stale"), "STALE_AUDIT_REFERENCE", F.lit("audit page")),
        issue(local.where("size(cells) <> 9"), "MANIFEST_COLUMNS_INVALID", F.size(cells).cast("string"), F.col("line_no")),
        issue(no_local, "MANIFEST_ROWS_MISSING", F.lit("sources")),
        issue(no_web, "MANIFEST_ROWS_MISSING", F.lit("web sources")),
        issue(online.where("size(cells) <> 5"), "WEB_SOURCE_COLUMNS_INVALID", F.size(cells).cast("string"), F.col("line_no")),
        issue(five.where(~cells[1].rlike(r"^https?://\S+$")), "WEB_SOURCE_URL_INVALID", cells[1], F.col("line_no")),
        issue(five.where((cells[0] == "") | (cells[2] == "") | (cells[3] == "") | (cells[4] == "")), "OTHER_CONTRACT_ISSUE", F.lit("empty web cell"), F.col("line_no")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def mapping_issues(found: DataFrame, notes: DataFrame) -> DataFrame:
    """Links of note cells that no note or several notes answer."""
    each = found.select("path", "line_no", F.posexplode(F.regexp_extract_all("note_cell", F.lit(WIKI), F.lit(1))).alias("k", "raw"))
    target = F.trim(F.substring_index(F.substring_index("raw", "|", 1), "#", 1))
    links = each.select("path", (F.col("line_no").cast("long") * 4096 + F.col("k")).alias("pos"), "raw", target.alias("target"), F.lit(None).cast("string").alias("fragment"))
    broken = resolve_wikilinks(links, notes).where("status in ('broken', 'ambiguous')").select("path", "target", F.floor(F.col("pos") / 4096).alias("line_no")).distinct()
    return issue(broken, "MAPPING_LINK_BROKEN", F.col("target"), F.col("line_no"))


def contract_issues(notes: DataFrame, types: DataFrame) -> DataFrame:
    """Forbidden audit pages and note types of learners, and manifests of another type.

    ``notes`` has path; ``types`` path and note_type (null or absent: undeclared).
    """
    name = F.substring_index("path", "/", -1)
    support = (F.col("path") == "AGENT.md") | (F.contains("path", F.lit("/")) & F.substring_index("path", "/", 1).isin(SUPPORT_DIRS))
    rows = notes.select("path").distinct().join(types.select("path", "note_type"), "path", "left").withColumns({"name": name, "support": support})
    formal = (F.col("name") == "source_manifest.md") & ~F.col("path").rlike(r"(^|/)\.") & ~F.col("support")
    return (
        issue(rows.where((F.col("name") == FORBIDDEN_NOTE) & ~F.col("support")), "FORBIDDEN_AUDIT_ARTIFACT", F.col("name"))
        .unionByName(issue(rows.where(F.col("note_type").isin(FORBIDDEN_TYPES) & ~F.col("support")), "FORBIDDEN_AUDIT_NOTE_TYPE", F.col("note_type")))
        .unionByName(issue(rows.where(formal & ~F.col("note_type").eqNullSafe("source_manifest")), "MANIFEST_NOTE_TYPE_INVALID", F.coalesce("note_type", F.lit(""))))
    )


def closure_issues(declared: DataFrame, found: DataFrame, manifests: DataFrame) -> DataFrame:
    """Declared sources of notes against the manifests of their own or an ancestor directory.

    ``declared``: path, source; ``found``: records; ``manifests``: path of every
    manifest.  The nearest manifest with the source decides, and has to link back.
    Ancestors are few per note and joined by equality.
    """
    folder = lambda c: F.when(F.contains(c, F.lit("/")), F.regexp_replace(c, "/[^/]*$", "")).otherwise("")
    rows = declared.select("path", "source").distinct().withColumn("dir", folder(F.col("path")))
    parts = F.filter(F.split("dir", "/"), lambda p: p != "")
    ups = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda d: F.struct(d.alias("depth"), F.array_join(F.slice(parts, F.lit(1), d), "/").alias("up")))
    each = rows.select("path", "source", F.inline(ups))
    homes = manifests.select(folder(F.col("path")).alias("up")).distinct()
    last = found.groupBy(folder(F.col("path")).alias("up"), "source").agg(F.max_by("note_cell", "line_no").alias("note_cell"))
    covered = each.select("path", "up").distinct().join(homes, "up", "left_semi").select("path").distinct()
    best = each.join(last, ["up", "source"]).groupBy("path", "source").agg(F.max_by("note_cell", "depth").alias("note_cell"))
    joined = rows.join(covered, "path", "left_semi").join(best, ["path", "source"], "left")
    back = F.array_contains(note_targets(F.col("note_cell")), F.regexp_replace("path", r"\.md$", ""))
    return (
        issue(rows.select("path").distinct().join(covered, "path", "left_anti"), "APPLICABLE_MANIFEST_MISSING", F.lit(""))
        .unionByName(issue(joined.where("note_cell is null"), "SOURCE_NOT_IN_APPLICABLE_MANIFEST", F.col("source")))
        .unionByName(issue(joined.where(F.col("note_cell").isNotNull() & ~back), "SOURCE_NOTE_MAPPING_MISSING", F.col("source")))
    )


def section_rows(notes: DataFrame) -> DataFrame:
    """``path``, ``line_no``, ``section``, ``values`` (map) of header-driven tables, the header of each second-level section first."""
    rows = notes.select("path", F.posexplode(lines_of(F.col("text"))).alias("i", "raw")).withColumns({"line": F.trim("raw"), "line_no": F.col("i") + 1})
    so_far = Window.partitionBy("path").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    is_head = F.col("line").startswith("## ")
    marked = rows.withColumns({"no": F.sum(is_head.cast("int")).over(so_far), "section": F.last(F.when(is_head, F.trim(F.substring("line", 4, 1 << 20))), ignorenulls=True).over(so_far)})
    piped = marked.where(F.col("line").startswith("|") & ~F.col("line").rlike(r"^\|?\s*:?-{3,}:?\s*(\|\s*:?-{3,}:?\s*)+\|?$")).withColumn("cells", escaped_cells(F.col("line")))
    part = Window.partitionBy("path", "no").orderBy("line_no")
    headed = piped.withColumns({"headers": F.first("cells").over(part.rowsBetween(Window.unboundedPreceding, 0)), "nth": F.row_number().over(part)})
    kept = headed.where((F.col("nth") > 1) & (F.size("cells") == F.size("headers")))
    # Of equal headers the last value counts.
    pairs = F.reverse(F.arrays_zip(F.col("headers").alias("k"), F.col("cells").alias("v")))
    unique = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, F.lit(1), i), lambda q: q["k"] == p["k"]))
    return kept.select("path", "line_no", F.coalesce("section", F.lit("")).alias("section"), F.map_from_entries(unique).alias("values"))


def inaccessible(values: Column) -> Column:
    """A resource row whose access, status or error says that it cannot be read."""
    cell = lambda name: F.lower(F.regexp_replace(F.trim(F.coalesce(F.try_element_at(values, F.lit(name)), F.lit(""))), r"\s+", " "))
    return F.concat_ws(" ", cell("Access"), cell("Status")).rlike(INACCESSIBLE) | ~cell("Error").isin(NO_ERROR)


def mentioned_units(text: Column, widest: int = 10_000) -> Column:
    """Page and slide numbers that a text names, ranges of up to ``widest`` opened; sorted, distinct.

    Numbers count only beside a word for pages or slides, so dates and versions do not.
    """
    atom = r"[0-9]{1,9}(?:\s*[-–—~～至]\s*[0-9]{1,9})?"
    values = rf"({atom}(?:\s*[、,，]\s*{atom})*)"
    shapes = [
        rf"(?i)(?:(?<![A-Za-z0-9_])p(?:ages?)?\.?|(?<![A-Za-z0-9_])slides?|页(?:面)?)\s*{values}",
        rf"(?i)第\s*{values}\s*(?:页|张)",
        rf"(?i){values}\s*(?:页|张)(?![A-Za-z0-9_])",
        rf"(?i)[0-9]+\s*(?:页|张)\s*[（(]\s*{values}\s*[）)]",
        rf"(?i)(?:空白|无可读|未抽到)(?:页|slides?)?\s*(?:为|[:：])\s*{values}",
    ]
    lists = F.flatten(F.array(*[F.regexp_extract_all(text, F.lit(s), F.lit(1)) for s in shapes]))
    items = F.flatten(F.transform(lists, lambda v: F.split(v, r"\s*[、,，]\s*")))
    bound = lambda x, k: F.regexp_extract(x, r"^([0-9]+)(?:\s*[-–—~～至]\s*([0-9]+))?$", k)
    low = lambda x: bound(x, 1).cast("long")
    high = lambda x: F.when(bound(x, 2) == "", bound(x, 1)).otherwise(bound(x, 2)).cast("long")
    opened = F.transform(items, lambda x: F.when((low(x) <= high(x)) & (high(x) - low(x) <= widest), F.sequence(low(x), high(x))).otherwise(F.array().cast("array<bigint>")))
    return F.array_sort(F.array_distinct(F.flatten(opened)))


def extractability_issues(found: DataFrame, observed: DataFrame) -> DataFrame:
    """Records against what a source was seen to hold: ``source``, ``observed_units``, ``blank_units``, ``has_text``.

    A mismatch of counts, a source without text, and blank units that the limitations do not name.
    Sources that were not observed are skipped.
    """
    joined = found.join(observed, "source")
    named = mentioned_units(F.col("limitations"))
    silent = F.array_except("blank_units", named)
    return (
        issue(joined.where("count <> observed_units"), "COUNT_MISMATCH", F.concat(F.col("count").cast("string"), F.lit(" for "), F.col("observed_units").cast("string")), F.col("line_no"))
        .unionByName(issue(joined.where("not has_text"), "NO_EXTRACTABLE_TEXT", F.col("source"), F.col("line_no")))
        .unionByName(issue(joined.where(F.col("has_text") & (F.size(silent) > 0)), "BLANK_UNITS_UNDECLARED", F.array_join(silent.cast("array<string>"), ","), F.col("line_no")))
    )


def normalized(notes: DataFrame) -> DataFrame:
    """``path``, ``text`` with headers, rules and rows of the source table in their standard form, ``unsafe`` for rows of six cells.

    An unsafe manifest keeps its text: what its rows lack needs evidence.
    """
    rows = lines_of(F.col("text"))
    head = F.array_position(F.transform(rows, lambda x: x.startswith(HEADER_START)), True).cast("int")
    cells = row_cells
    coded = lambda x: x.startswith("| `")
    rule = lambda x: x.rlike(r"^\|(\s*:?-{3,}:?\s*\|)+$")
    one = lambda x, inside: (
        F.when(x.startswith(HEADER_START), F.lit(HEADER))
        .when(inside & rule(x), F.lit(RULE))
        .when(coded(x) & (F.size(cells(x)) == 9), F.concat(F.lit("| "), F.array_join(cells(x), " | "), F.lit(" |")))
        .otherwise(x)
    )
    # Inside: since the last line that is neither a bar nor a header, a header was seen.
    inside = lambda k: F.aggregate(F.slice(rows, F.lit(1), k + 1), F.lit(False), lambda s, x: F.when(x.startswith(HEADER_START), True).when(x.startswith("|"), s).otherwise(False))
    unsafe = F.exists(rows, lambda x: coded(x) & (F.size(cells(x)) == 6))
    done = F.concat(F.array_join(F.transform(rows, lambda x, k: one(x, inside(k))), "\n"), F.when(F.col("text").endswith("\n"), "\n").otherwise(""))
    plain = ~unsafe & ((head > 0) | F.exists(rows, coded))
    return notes.select("path", F.when(plain, done).otherwise(F.col("text")).alias("text"), F.coalesce(unsafe, F.lit(False)).alias("unsafe"))


def without_section(notes: DataFrame, heading: str) -> DataFrame:
    """Notes without the sections under a second-level heading; one blank line parts what stays.  ``changed`` tells which."""
    quoted = r"\Q" + heading + r"\E"
    # A section ends before the next second-level heading; the heading itself is looked ahead at.
    cut = F.regexp_replace("text", rf"(?ms)\n*^{quoted}$(?:(?!\n## ).)*(?:\n+(?=## )|\n*\z)", "\n\n")
    tidy = F.regexp_replace(F.regexp_replace(cut, r"^\n+", ""), r"\n*\z", "")
    done = F.concat(tidy, F.when(F.col("text").endswith("\n") & (tidy != ""), "\n").otherwise(""))
    has = F.coalesce(F.col("text").rlike(rf"(?m)^{quoted}$"), F.lit(False))
    return notes.select("path", F.when(has, done).otherwise(F.col("text")).alias("text"), has.alias("changed"))
