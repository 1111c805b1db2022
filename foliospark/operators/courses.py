"""Course folders: overview, review pages, thin notes, web collections, audit residue, formulas and taxonomy routes.

Input is ``path`` and ``text``; a course is the first part of a path.  Code is
masked in Arrow tasks, and only in notes that hold what a rule looks for.

Cases: null texts count as empty; a course without files at its top has neither
overview nor review pages; rules give the columns of ``operators.rules``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.functions.markdown import markdown_links, masked_code, masked_comments, visible_text
from foliospark.functions.text import stem_key
from foliospark.operators.frames import by_line, frontmatter, without_frontmatter
from foliospark.operators.links import wikilinks
from foliospark.operators.rules import all_of, issue

# Names of overviews, review pages, chapters, audits and manifests.
OVERVIEWS = ["00_课程总览.md", "00_学习地图.md"]
OVERVIEW_ENDS = ["课程总览.md", "学习地图.md", "总览.md"]
DETAILED, CONCISE = "知识点详细版_含公式.md", "知识点精简复习版_含公式.md"
EXAM = "考试复习|复习笔记"
CHAPTER = r"^(?!00_|99_)\d{2}_.+\.md$"
AUDIT, MANIFEST = "(?i)覆盖审查|coverage", "(?i)source[_-]?manifest|源材料|source.*manifest"
LEAST_CHAPTER, LEAST_DETAILED, LEAST_EXAM = 80, 250, 250
COURSE_RESIDUE = "相关知识链接|TODO|FIXME|TBD|待补|待完善"
ALONE_MATH = r"^[\s>]*(?:(?:[-+*]|\d{1,9}[.)])[\s>]+){0,20}\$\$\s*$"
LINE_END = "\r\n|\r|\n"
GENERIC_RESIDUE = r"例题模板|高频答题模板|答题模板|空话|套话|占位|\.\.\."
# Notes of web collections.
SCAFFOLD = "(?i)status:\\s*scaffold|待补充|TODO|To complete"
ENTRY_MAP = r"(?i)^00[_ ].*(?:学习地图|课程总览|Learning[_ ]+Map|Course[_ ]+Overview).*\.md$"
SUPPORT_STEMS = [
    "agent", "agents", "readme", "source_manifest", "99_内容覆盖审查", "99_来源覆盖审查", "99_质量审查", "内容覆盖审查", "来源覆盖审查", "质量审查",
    "source_coverage_audit", "content_coverage_audit", "coverage_audit", "validation_report",
]
# Audit residue of ordinary notes, and the roots that may hold it.
EXEMPT_ROOTS = ["agent", "模板", "scripts", "tests"]
LEGACY_AUDIT = "99_内容覆盖审查.md"
PSEUDO_QUESTION = "解决的核心问题是什么？它和本课程前后章节的哪个概念最容易混淆？"
AUDIT_RESIDUE = {
    "UNVERIFIED marker": r"\bUNVERIFIED\b",
    "page-level supplement heading": r"^#{1,6}\s+.*页级补充\s*$",
    "page-level evidence label": r"^(?:\s*[-*]\s*)?(?:\*\*)?(?:页级证据|页级公式/边界证据)(?:\*\*)?\s*[:：]",
    "formal page-level source claim": r"(?:^\s*(?:[-*]\s*)?正式页级来源\s*[:：]|20\d{2}\s*(?:年)?\s*正式页级来源(?:是|另见))",
    "page-level mainline claim": r"(?:^\s*(?:[-*]\s*)?页级主线\s*[:：]|20\d{2}\s*(?:年)?\s*Lecture\s+\d+\s+的页级主线是)",
    "representative page-level claim": r"代表页级(?:例子|公式)(?:/示例)?(?:是|见|\s*[:：])",
    "coverage weak-hit residue": "(?:覆盖审查[^\n]{0,80}原关键词弱命中|原关键词弱命中[^\n]{0,80}覆盖审查)",
}
# LaTeX that an extraction spoils.
DOUBLED = r"\\\\(theta|frac|top|rightarrow|nabla|sum|prod|alpha|beta|lambda)"
# The nine directions and the routes that are no directions of their own.
DIRECTION_KEYS = ["direction", "directions", "job_track", "job_tracks", "track", "tracks"]
DIRECTION_IDS = ["ai_infra", "automotive", "cv", "embodied_ai", "nlp_llm", "recommendation", "robotics", "search", "speech"]
GENERIC_DIRECTIONS = ["p0", "p1", "p2", "foundation", "common", "cross-cutting", "cross_cutting", "topic", "application"]
LEGACY_ROUTES = [
    "多模态算法岗", "强化学习算法岗", "图学习算法岗", "时序算法岗", "广告算法岗", "风控算法岗", "风险控制算法岗", "数据科学岗", "量化算法岗", "医疗AI算法岗",
    "遥感算法岗", "供应链算法岗", "RAG算法岗", "Agent算法岗", "AIGC算法岗",
]
COMBINED_ROUTES = ["搜索与推荐路线", "搜索与推荐方向", "机器人与具身智能路线", "机器人与具身方向"]
LEGACY_LABELS = [
    "多模态", "强化学习", "图学习", "GNN", "时序", "广告", "风控", "数据科学", "量化", "医疗 AI", "遥感", "供应链", "RAG", "Agent", "AIGC", "生成模型",
    "Diffusion", "MLOps", "自动驾驶", "智能驾驶",
]
LEGACY_VALUES = [
    "multimodal", "reinforcement_learning", "rl", "gnn", "graph_learning", "time_series", "advertising", "ads", "risk_control", "data_science", "quant",
    "finance", "healthcare_ai", "remote_sensing", "supply_chain", "rag", "agent", "aigc", "generative_model", "mlops",
]
NAMING_KEYS, FORBIDDING = ["aliases", "tags"], "不能做|禁止|不得"
ROUTE_CONTEXT = "(?i)岗位|方向|路线|入口|地图|矩阵|分类|主线|track|direction|route"
REJECTED_BEFORE = (
    "(?:禁止(?:创建|新增|保留)?|不得(?:创建|新增|保留|作为)?|不应(?:创建|新增|保留|作为)?|不能(?:创建|新增|保留)?|不要(?:创建|新增|保留)?|不再|不设置|不新增|不创建|"
    "不构成|不是|并非|不作为|取消|删除|移除|清理)\\s*(?:把|将)?\\s*(?:独立的)?\\s*[“\"']?\\s*$"
)
REJECTED_AFTER = r"^\s*(?:[|，,:：;；-]\s*)*(?:路线|方向|入口)?\s*(?:不是|并非|不作为|不得作为|不再作为|不应作为|不再保留|不创建|不新增|已删除|应删除|归属|挂靠|只能作为|仅作为)"


def _name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def _stem(name: Column) -> Column:
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def masked_lines(docs: DataFrame) -> DataFrame:
    """``path``, ``line_no``, ``line`` (code blanked) and ``raw``."""
    both = docs.select("path", "text", masked_code("text")["masked"].alias("masked"))
    pairs = F.arrays_zip(F.split("masked", "\r\n|\r|\n").alias("line"), F.split("text", "\r\n|\r|\n").alias("raw"))
    return both.select("path", F.posexplode(pairs).alias("i", "p")).select("path", (F.col("i") + 1).alias("line_no"), F.col("p.line").alias("line"), F.col("p.raw").alias("raw"))


def visible_lines(notes: DataFrame) -> DataFrame:
    """``path``, ``line_no``, ``line`` with frontmatter, fences and comments out of it; inline code stays."""
    return notes.select("path", F.posexplode(F.split(visible_text("text"), LINE_END)).alias("i", "line")).select("path", (F.col("i") + 1).alias("line_no"), "line")


def nonblank_lines(text: Column) -> Column:
    return F.size(F.filter(F.split(text, "\r\n|\r|\n"), lambda x: x.rlike(r"(?U)\S")))


def course_pages(notes: DataFrame) -> DataFrame:
    """One row per course: ``overview``, ``detailed``, ``concise`` (paths, null where missing) and ``exams`` (number)."""
    top = notes.select("path", F.substring_index("path", "/", 1).alias("course"), _name(F.col("path")).alias("name"), (F.size(F.split("path", "/")) == 2).alias("top"))
    rank = F.when(F.col("name") == OVERVIEWS[0], 0).when(F.col("name") == OVERVIEWS[1], 1)
    for k, end in enumerate(OVERVIEW_ENDS):
        rank = rank.when(F.col("name").startswith("00_") & F.col("name").endswith(end), 2 + k)
    first = lambda exact: F.min(F.when(F.col("top") & F.col("name").endswith(exact), F.struct((F.col("name") != exact).alias("other"), "path")))["path"]
    return top.groupBy("course").agg(
        F.min(F.when(F.col("top") & rank.isNotNull(), F.struct(rank.alias("rank"), "path")))["path"].alias("overview"),
        first(DETAILED).alias("detailed"),
        first(CONCISE).alias("concise"),
        F.count_if(_stem(F.col("name")).rlike(EXAM)).alias("exams"),
        F.bool_or(F.col("name").rlike(AUDIT)).alias("audited"),
        F.bool_or(F.col("name").rlike(MANIFEST)).alias("listed"),
    )


def linked_stems(notes: DataFrame) -> DataFrame:
    """``path``, ``stem`` of the local targets of a note's wikilinks and inline links outside code."""
    seen = notes.select("path", masked_code("text")["masked"].alias("text"))
    wiki = wikilinks(seen).select("path", "target")
    inline = seen.select("path", F.explode(markdown_links("text")).alias("l")).select("path", F.regexp_extract("l.target", "^([^?#]*)", 1).alias("target"))
    local = wiki.union(inline.where(~F.col("target").rlike("^[A-Za-z][A-Za-z0-9+.-]*:"))).where("target <> ''")
    return local.select("path", _stem(_name(F.coalesce(F.try_url_decode(F.replace("target", F.lit("+"), F.lit("%2B"))), "target"))).alias("stem")).distinct()


def content_issues(notes: DataFrame, strict: bool = False) -> DataFrame:
    """Empty notes, conflict markers, left-overs, open fences, odd block math and broken tables, in one pass over masked lines.

    An empty note breaks no other rule.  A table is a run of lines between bars;
    its first line says how many columns the others have.
    """
    docs = notes.select("path", F.coalesce("text", F.lit("")).alias("text"))
    empty = docs.where(~F.col("text").rlike(r"(?U)\S"))
    both = docs.where(F.col("text").rlike(r"(?U)\S")).select("path", "text", masked_code("text").alias("m"))
    edges = F.contains("text", F.lit("<<<<<<<")) & F.contains("text", F.lit(">>>>>>>"))
    zipped = F.arrays_zip(F.split("m.masked", LINE_END).alias("line"), F.split("text", LINE_END).alias("raw"), F.split(masked_comments(F.col("m.masked")), LINE_END).alias("seen"))
    rows = both.select("path", F.col("m.left_open").alias("open"), edges.alias("edges"), F.posexplode(zipped).alias("i", "p")).select("path", "open", "edges", (F.col("i") + 1).alias("line_no"), "p.*")
    line, bare = F.col("line"), F.regexp_replace("raw", r"(?U)^\s+|(?<!\s)\s+$", "")
    cells = F.regexp_count(F.regexp_replace("line", r"\\.", ""), F.lit(r"\|")) - 1
    is_row = F.contains("line", F.lit("|")) & line.rlike(r"^(?U:\s*)\|") & line.rlike(r"\|(?U:\s*)$")
    so_far = by_line().rowsBetween(Window.unboundedPreceding, 0)
    marked = rows.withColumns({"cells": F.when(is_row, cells), "island": F.sum((~is_row).cast("int")).over(so_far), "math": F.sum((F.contains("seen", F.lit("$$")) & F.col("seen").rlike(ALONE_MATH)).cast("int")).over(Window.partitionBy("path"))})
    marked = marked.withColumn("expected", F.first("cells", ignorenulls=True).over(Window.partitionBy("path", "island").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)))
    first = F.col("line_no") == 1
    told = lambda when, rule, message, at: F.when(when, F.struct(F.lit(rule).alias("rule"), at.cast("int").alias("line_no"), message.alias("message")))
    here, whole = F.col("line_no"), F.lit(0)
    checks = [
        told(F.col("raw").rlike("<<<<<<<|>>>>>>>|=======") & (bare.startswith("<<<<<<<") | bare.startswith(">>>>>>>") | (F.col("edges") & (bare == "======="))), "conflict_marker", bare, here),
        told(line.rlike(COURSE_RESIDUE), "template_residue", F.regexp_extract("line", COURSE_RESIDUE, 0), here),
        told(F.lit(strict) & line.rlike(GENERIC_RESIDUE), "generic_template_residue", F.regexp_extract("line", GENERIC_RESIDUE, 0), here),
        told(first & F.col("open"), "unbalanced_fence", F.lit("fence"), whole),
        told(first & (F.col("math") % 2 == 1), "unbalanced_math", F.col("math").cast("string"), whole),
        told(F.col("cells") != F.col("expected"), "broken_table", F.concat(F.col("cells").cast("string"), F.lit(" for "), F.col("expected").cast("string")), here),
    ]
    found = marked.select("path", F.inline(F.filter(F.array(*checks), lambda x: x.isNotNull())))
    return all_of(issue(empty, "empty_file", F.lit("no content")), found.select("rule", F.col("path").cast("string").alias("path"), "line_no", "message"))


def course_issues(notes: DataFrame, strict_depth: bool = False, allow_exam: bool = False, require_audit: bool = False, least: tuple[int, int, int] = (LEAST_CHAPTER, LEAST_DETAILED, LEAST_EXAM)) -> DataFrame:
    """Missing overviews, review pages, audits and review links; if strict, notes with too few lines that are not blank.

    What single notes hold is told by ``content_issues``.
    """
    pages = course_pages(notes)
    exam_only = F.lit(allow_exam) & (F.col("exams") > 0) & (F.col("detailed").isNull() | F.col("concise").isNull())
    absent = lambda column, rule, message: issue(pages.where(column).select(F.col("course").alias("path")), rule, F.lit(message))
    found = [
        absent(F.col("overview").isNull(), "missing_overview", OVERVIEWS[0]),
        absent(F.col("detailed").isNull() & ~exam_only, "missing_review_page", DETAILED),
        absent(F.col("concise").isNull() & ~exam_only, "missing_review_page", CONCISE),
    ]
    if require_audit:
        found += [absent(~F.col("audited"), "missing_coverage_audit", "audit"), absent(~F.col("listed"), "missing_source_manifest", "manifest")]
    placed = notes.select("path", F.substring_index("path", "/", 1).alias("course"), "text", _name(F.col("path")).alias("name"))
    if strict_depth:
        sized = placed.join(pages.select("course", "detailed", "concise"), "course").withColumn("n", nonblank_lines(F.coalesce("text", F.lit("")))).where(F.coalesce("text", F.lit("")).rlike(r"(?U)\S"))
        exam = _stem(F.col("name")).rlike(EXAM)
        detailed = F.coalesce(F.col("path") == F.col("detailed"), F.lit(False))
        review = detailed | F.coalesce(F.col("path") == F.col("concise"), F.lit(False))
        chapter, long, revision = least
        rule = F.when(detailed & (F.col("n") < long), "thin_detailed_review").when(exam & (F.col("n") < revision), "thin_exam_review")
        rule = rule.when(F.col("name").rlike(CHAPTER) & ~review & ~exam & (F.col("n") < chapter), "thin_chapter_note")
        thin = sized.withColumn("rule", rule).where("rule is not null")
        found.append(thin.select("rule", "path", F.lit(0).alias("line_no"), F.col("n").cast("string").alias("message")))
    # Both pages found: these are linked; otherwise exam notes where they may stand in, else the default names.
    both = F.col("detailed").isNotNull() & F.col("concise").isNotNull()
    named = pages.where("overview is not null").select("course", "overview", F.when(both, F.array("detailed", "concise")).when(~exam_only, F.array(F.lit(DETAILED), F.lit(CONCISE))).alias("targets"))
    wanted = named.where("targets is not null").select("overview", F.explode("targets").alias("target"))
    if allow_exam:
        exams = placed.where(_stem(F.col("name")).rlike(EXAM)).select("course", F.col("path").alias("target"))
        wanted = wanted.union(named.where("targets is null").join(exams, "course").select("overview", "target"))
    stems = linked_stems(notes.join(named.select(F.col("overview").alias("path")), "path", "left_semi"))
    unlinked = wanted.select(F.col("overview").alias("path"), _name(F.col("target")).alias("name"), _stem(_name(F.col("target"))).alias("stem")).join(stems, ["path", "stem"], "left_anti")
    found.append(issue(unlinked, "missing_review_link", F.col("name")))
    return all_of(*found)


def audit_residue(notes: DataFrame) -> DataFrame:
    """Audit wording that ordinary notes must not keep, legacy audit files, and the fixed pseudo-question; lines count without frontmatter."""
    body = without_frontmatter(notes.select("path", F.coalesce("text", F.lit("")).alias("text"))).select("path", F.col("body").alias("text"))
    wanted = "|".join(["UNVERIFIED", "页级", "弱命中", PSEUDO_QUESTION])
    rows = masked_lines(body.where(F.col("text").rlike(wanted)))
    exempt = (_name(F.col("path")) == "source_manifest.md") | (F.col("path").contains("/") & F.substring_index("path", "/", 1).isin(EXEMPT_ROOTS)) | (F.col("path") == "AGENT.md")
    named = lambda label: lambda m: F.struct(F.lit(label).alias("message"), m.alias("hit"))
    hits = F.flatten(F.array(*(F.transform(F.regexp_extract_all("line", F.lit(pattern), F.lit(0)), named(label)) for label, pattern in AUDIT_RESIDUE.items())))
    residue = rows.where(~exempt).select("path", "line_no", F.inline(hits))
    asked = rows.select("path", "line_no", F.explode(F.regexp_extract_all("line", F.lit(PSEUDO_QUESTION), F.lit(0))).alias("hit"))
    legacy = notes.where((_name(F.col("path")) == LEGACY_AUDIT) & ~exempt)
    return all_of(
        issue(residue, "audit_residue", F.col("message"), F.col("line_no")),
        issue(asked, "pseudo_question", F.lit("fixed pseudo-question"), F.col("line_no")),
        issue(legacy, "legacy_audit", F.lit("forbidden legacy audit artifact"), F.lit(1)),
    )


def formula_defects(notes: DataFrame) -> DataFrame:
    """Formulas with a replacement character, a doubled command or a backslash at the end (``line_no`` is the formula's number), and odd delimiters."""
    seen = notes.where(F.contains("text", F.lit("$$"))).select("path", masked_code("text")["masked"].alias("text"))
    parts = seen.select("path", F.split("text", r"\$\$").alias("parts"))
    each = parts.select("path", F.posexplode(F.filter("parts", lambda x, k: k % 2 == 1)).alias("i", "formula"))
    labels = F.array(
        F.when(F.contains("formula", F.lit("�")), "replacement character"),
        F.when(F.col("formula").rlike(DOUBLED), "double-escaped LaTeX command"),
        F.when(F.col("formula").rlike(r"\\\n?\z"), "dangling backslash"),
    )
    bad = each.select("path", (F.col("i") + 1).alias("nth"), F.explode(F.filter(labels, lambda x: x.isNotNull())).alias("label"))
    odd = parts.where(F.size("parts") % 2 == 0)
    return all_of(issue(bad, "formula_defect", F.col("label"), F.col("nth")), issue(odd, "formula_defect", F.lit("unbalanced $$ delimiters")))


def web_collection_issues(notes: DataFrame) -> DataFrame:
    """Per collection (first part of the path): no entry map, no detail note, a missing manifest, and scaffold text outside code."""
    placed = notes.select("path", F.substring_index("path", "/", 1).alias("course"), _name(F.col("path")).alias("name"), "text")
    top, note = F.size(F.split("path", "/")) == 2, F.col("name") != "source_manifest.md"
    entry = F.col("name").rlike(ENTRY_MAP)
    support = F.lower(_stem(F.col("name"))).isin(SUPPORT_STEMS)
    per = placed.groupBy("course").agg(F.bool_or(top & ~note).alias("listed"), F.bool_or(note & entry).alias("mapped"), F.bool_or(note & ~entry & ~support).alias("detailed"))
    absent = lambda column, rule: issue(per.where(column).select(F.col("course").alias("path")), rule, F.lit(rule))
    left = masked_lines(placed.where(note & F.col("text").rlike(SCAFFOLD)).join(per.where("listed"), "course", "left_semi").select("path", "text")).where(F.col("line").rlike(SCAFFOLD))
    return all_of(
        absent(~F.col("listed"), "missing_manifest"),
        absent(F.col("listed") & ~F.col("mapped"), "missing_entry_map"),
        absent(F.col("listed") & ~F.col("detailed"), "missing_detail_note"),
        issue(left, "scaffold_residue", F.regexp_extract("line", SCAFFOLD, 0), F.col("line_no")),
    )


def _route_fragments(notes: DataFrame) -> DataFrame:
    """``path``, ``line_no``, ``line``, ``fragment``: what may name a route, outside frontmatter, fences and comments.

    A table's columns whose head forbids are left out of its rows; the set of
    such columns is carried along the rows until the table ends or another head
    forbids others.
    """
    rows = visible_lines(notes)
    line = F.trim("line")
    is_row = F.ltrim("line").startswith("|")
    cells = F.when(is_row, F.transform(F.split(F.regexp_replace(line, r"^\|+|\|+$", ""), r"\|"), lambda c: F.trim(c)))
    rule = F.forall("cells", lambda c: c.rlike("^:?-{3,}:?$"))
    forbids = lambda c: c.rlike(FORBIDDING)
    heads = F.filter(F.transform("cells", lambda c, k: F.when(forbids(c), k)), lambda k: k.isNotNull())
    placed = rows.withColumn("cells", cells).withColumn("rule", F.coalesce(rule, F.lit(False)))
    state = F.when(F.col("cells").isNull(), F.array().cast("array<int>")).when(~F.col("rule") & (F.size(heads) > 0), heads)
    carried = placed.withColumn("out", F.last(state, ignorenulls=True).over(by_line().rowsBetween(Window.unboundedPreceding, 0)))
    left = F.filter(F.transform("cells", lambda c, k: F.when(~F.array_contains("out", k), c)), lambda c: c.isNotNull())
    whole = F.col("cells").isNull() | F.col("out").isNull() | (F.size("out") == 0)
    return carried.select("path", "line_no", "line", F.explode(F.when(F.col("rule"), F.array().cast("array<string>")).when(whole, F.array("line")).otherwise(left)).alias("fragment"))


def route_issues(notes: DataFrame) -> DataFrame:
    """Lines about routes that name a category of their own beside the nine directions, unless they reject it or stand in a forbidding column."""
    phrases = LEGACY_ROUTES + COMBINED_ROUTES
    rows = _route_fragments(notes.where(F.col("text").rlike("|".join(phrases)))).where(F.col("fragment").rlike(ROUTE_CONTEXT))
    each = rows.select("path", "line_no", "fragment", F.explode(F.filter(F.array(*map(F.lit, phrases)), lambda p: F.contains("fragment", p))).alias("phrase"))
    parts = each.withColumn("parts", F.split("fragment", F.concat(F.lit(r"\Q"), "phrase", F.lit(r"\E")), -1))
    # An occurrence stands between two neighbouring parts; what is before and after it decides.
    joined = lambda some: F.call_function("array_join", some, F.col("phrase"))
    before = lambda k: F.regexp_extract(joined(F.slice("parts", F.lit(1), k)), r"(?s)(.{0,32})\z", 1)
    after = lambda k: F.substring(joined(F.slice("parts", k + 1, F.size("parts"))), 1, 40)
    open_ = F.exists(F.sequence(F.lit(1), F.size("parts") - 1), lambda k: ~(before(k).rlike(REJECTED_BEFORE) | after(k).rlike(REJECTED_AFTER)))
    return issue(parts.where(open_).select("path", "line_no", "phrase").distinct(), "extra_route", F.col("phrase"), F.col("line_no"))


def matrix_headers(notes: DataFrame) -> DataFrame:
    """Table rows that head a matrix of knowledge points or directions and name a category that is no direction."""
    rows = visible_lines(notes.where(F.col("text").rlike("知识点|岗位方向"))).where(F.ltrim("line").startswith("|") & F.col("line").rlike("知识点|岗位方向"))
    bare = F.transform(F.split(F.regexp_replace(F.trim("line"), r"^\|+|\|+$", ""), r"\|"), lambda c: F.regexp_replace(F.trim(c), "^[`*\"']+|[`*\"']+$", ""))
    each = rows.select("path", "line_no", F.explode(F.array_intersect(bare, F.array(*map(F.lit, LEGACY_LABELS)))).alias("label"))
    return issue(each, "extra_matrix_category", F.col("label"), F.col("line_no"))


def direction_values(notes: DataFrame) -> DataFrame:
    """Frontmatter directions that are legacy routes or unknown, and aliases and tags that name a legacy route."""
    front = frontmatter(notes)
    scalars = front.select("path", F.explode(F.map_entries("keys")).alias("e")).select("path", F.col("e.key").alias("key"), F.col("e.value").alias("raw"))
    inline = F.transform(F.split(F.regexp_replace("raw", r"^\[|\]$", ""), ","), lambda x: F.regexp_replace(F.trim(x), "^[\"']|[\"']$", ""))
    singles = scalars.select("path", "key", F.explode(F.when(F.col("raw").rlike(r"^\[.*\]$"), inline).otherwise(F.array("raw"))).alias("value"))
    lists = front.select("path", F.explode("lists").alias("l")).select("path", F.col("l.key").alias("key"), F.explode("l.value").alias("value"))
    values = singles.union(lists).where(F.col("key").isin(DIRECTION_KEYS + NAMING_KEYS) & (F.trim("value") != ""))
    plain = F.regexp_replace(F.regexp_replace(F.lower(F.trim("value")), r"[\s/.-]+", "_"), "^_+|_+$", "")
    phrase, direction = F.lower("value").rlike("|".join(p.lower() for p in LEGACY_ROUTES)), F.col("key").isin(DIRECTION_KEYS)
    why = (
        F.when(~direction & phrase, "legacy_route_name")
        .when(direction & (plain.isin(LEGACY_VALUES) | phrase), "legacy_direction")
        .when(direction & (plain != "") & ~plain.isin(DIRECTION_IDS) & ~plain.isin(GENERIC_DIRECTIONS), "unknown_direction")
    )
    return values.withColumn("rule", why).where("rule is not null").select("rule", F.col("path").cast("string").alias("path"), F.lit(0).alias("line_no"), F.col("value").alias("message"))


def sibling_mapping(sources: DataFrame, notes: DataFrame, explicit: DataFrame, ignored: list[str] | None = None) -> DataFrame:
    """``source_dir``, ``notes_dir``: explicit pairs first, then source folders that notes have a folder of the same name for."""
    top = lambda rows, name: rows.where(F.contains("path", F.lit("/"))).select(F.substring_index("path", "/", 1).alias(name)).distinct()
    free = top(sources, "source_dir").where(~F.col("source_dir").isin(ignored or [])).join(explicit.select("source_dir"), "source_dir", "left_anti")
    same = free.join(top(notes, "notes_dir"), F.col("source_dir") == F.col("notes_dir"))
    return explicit.select("source_dir", "notes_dir").unionByName(same)


def path_collisions(files: DataFrame) -> DataFrame:
    """``key``, ``paths``, ``first_path``, ``last_path`` of different paths that are one on common file systems."""
    keyed = files.select("path").distinct().withColumn("key", stem_key("path"))
    return keyed.groupBy("key").agg(F.count("*").alias("paths"), F.min("path").alias("first_path"), F.max("path").alias("last_path")).where("paths > 1")


def symlink_issues(files: DataFrame) -> DataFrame:
    """Symbolic links of a listing (``path``, ``is_link``, ``target_inside``): any link is unsafe, one that leaves the root is outside it."""
    rule = F.when(~F.col("target_inside"), "outside_root").otherwise("unsafe_symlink")
    return files.where("is_link").select(rule.alias("rule"), "path", F.lit(0).alias("line_no"), F.lit("symbolic link").alias("message"))


def merged_listings(*listings: DataFrame) -> DataFrame:
    """Distinct paths of several listings (tracked, untracked, changed, of a range) with the number of listings that hold them."""
    out = None
    for k, rows in enumerate(listings):
        one = rows.select("path").distinct().withColumn("listing", F.lit(k))
        out = one if out is None else out.unionByName(one)
    return out.groupBy("path").agg(F.count("*").alias("listings"))
