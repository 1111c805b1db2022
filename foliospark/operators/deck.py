"""Slide decks from notes: summaries, the deck's mode, briefs, slide plans and their limits.

Notes may be many, the slides of one deck are few: plans are keyed by ``deck``
and windows stay inside one.

Cases: a note without headings has its stem as title; a plan without slides
gets the limitations and the appendix; null texts count as empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.functions.text import word_count
from foliospark.operators.classify import first_match

# Words that decide a deck's mode and a slide's role, and the spines of each mode.
MODES = {
    "proposal": ["proposal", "hypothesis", "milestone", "risk", "expected contribution", "计划", "方案", "假设", "里程碑", "风险", "预期"],
    "progress-report": ["progress", "status", "completed", "next step", "blocker", "log", "进展", "状态", "已完成", "下一步", "阻塞", "实验记录"],
    "teaching": ["lecture", "teaching", "tutorial", "example", "common mistake", "prerequisite", "课程", "教学", "教程", "例题", "常见错误", "前置知识"],
    "defense": ["defense", "thesis", "dissertation", "committee", "contribution", "答辩", "学位论文", "委员会", "贡献"],
    "paper-reading": ["paper", "related work", "method", "experiment", "ablation", "limitation", "论文", "相关工作", "方法", "实验", "消融", "局限"],
}
DEFAULT_MODE = "paper-reading"
HEADING_ROLES = [
    ("背景|motivation|problem|问题", "problem framing"),
    ("方法|method|mechanism|pipeline|机制", "method/mechanism"),
    ("公式|equation|algorithm|算法", "formula/algorithm"),
    ("实验|result|结果|ablation|消融|评估", "evidence/results"),
    ("局限|limitation|risk|风险|failure|失败", "limitations"),
    ("总结|discussion|讨论|future|未来", "discussion"),
]
TITLE_ROLES = [
    ("formula|algorithm|equation|公式|算法", "formula/algorithm"),
    ("result|experiment|evidence|table|ablation|实验|结果|证据|表格|对比表", "evidence/results"),
    ("limitation|risk|failure|局限|风险|失败", "limitations"),
    ("appendix|backup|附录", "appendix"),
    ("method|mechanism|pipeline|方法|机制", "method/mechanism"),
]
SPINE_HEADINGS = "Suggested Scientific Deck Spine|建议科学演示主线"
BACKLOG_HEADINGS = "Draft Slide Backlog|草稿幻灯片待办"
TOTAL_SLIDES = r"(?m)^-\s+(?:Maximum total slide count|最大总幻灯片数量):\s*(-?\d+)\b"
BACKLOG_ITEM = r"(?m)^\s*-\s+\[([^\]]+)\].*?`([^`]+)`.*?Proof object:\s*(.+?)\.?\s*$"
DEFAULT_PROOF = "claim with source-grounded proof object"
LIMITATION = ("Limitations and open questions", "limitations", "limitation/failure-case slide")
APPENDIX = ("Appendix index", "appendix", "appendix navigation")
IMAGES = r"(?i)\.(png|jpe?g|gif|webp|svg|bmp|tiff?)$"
MAX_TITLE_CHARS, MAX_TITLE_UNITS = 180, 12.2 * 72 / 28 * 2 * 0.95
CORPUS_CHARS = 1200
CJK_LEAST = 8


def summaries(notes: DataFrame) -> DataFrame:
    """Counts of a note (code masked by the caller; frontmatter and comments are left out here): ``title``, ``headings``, ``links``, ``images``, ``attachments``, ``tables``, ``math_blocks``, ``words``."""
    text = F.coalesce("text", F.lit(""))
    body = F.regexp_replace(text, r"(?s)^\ufeff?---\n.*?\n---(?:\n|\z)", "\n")
    visible = F.regexp_replace(body, r"(?s)<!--.*?-->|%%.*?%%", " ")
    heads = F.regexp_extract_all("t", F.lit(r"(?m)^(#{1,6}[ \t]+\S.*?)\s*$"), F.lit(1))
    parsed = F.transform(heads, lambda h: F.struct(F.length(F.regexp_extract(h, "^(#+)", 1)).alias("level"), F.trim(F.regexp_replace(h, "^#+", "")).alias("text")))
    every = lambda pattern: F.regexp_extract_all("t", F.lit(pattern), F.lit(1))
    embeds = every(r"!\[\[([^\]\n]+)\]\]")
    wiki = F.array_except(every(r"\[\[([^\]\n]+)\]\]"), embeds)
    targets = F.array_union(every(r"(?<!!)\[[^\]]*\]\(<?([^)\s>]+)[^)]*\)"), every(r"(https?://[^\s)>\]]+)"))
    shown = F.filter(embeds, lambda e: F.trim(F.substring_index(F.substring_index(e, "|", 1), "#", 1)).rlike(IMAGES))
    stem = F.regexp_replace(F.substring_index("path", "/", -1), r"\.[^.]*$", "")
    first = F.try_element_at(F.filter("headings", lambda h: h["level"] == 1), F.lit(1))["text"]
    rows = notes.select("path", visible.alias("t")).withColumn("headings", parsed)
    return rows.select(
        "path",
        F.coalesce(first, stem).alias("title"),
        "headings",
        F.array_sort(targets).alias("markdown_links"),
        F.array_sort(wiki).alias("wiki_links"),
        (F.regexp_count("t", F.lit(r"!\[[^\]]*\]\([^)]*\)")) + F.size(shown)).alias("images"),
        (F.size(embeds) - F.size(shown)).alias("attachments"),
        F.regexp_count("t", F.lit(r"(?m)^[ \t]*\|.*\n\s*\|?\s*:?-{3,}:?\s*\|")).alias("tables"),
        F.floor(F.regexp_count("t", F.lit(r"\$\$")) / 2).cast("int").alias("math_blocks"),
        word_count(F.col("t")).alias("words"),
        F.substring("t", 1, CORPUS_CHARS).alias("opening"),
        F.regexp_count("t", F.lit("[\u4e00-\u9fff]")).alias("cjk"),
    )


def deck_mode(found: DataFrame, deck: str | None = None) -> DataFrame:
    """``mode`` (and ``deck``) whose words occur most in titles, headings and openings; the first of equals, a paper without any.

    A word counts once per deck, so flags are combined and no text is gathered.
    """
    corpus = F.lower(F.concat_ws(" ", "title", F.transform("headings", lambda h: h["text"]), "opening"))
    flags = [F.bool_or(corpus.contains(word)).alias(f"f_{m}_{k}") for m, words in enumerate(MODES.values()) for k, word in enumerate(words)]
    keyed = found.groupBy(*([deck] if deck else [])).agg(*flags)
    scores = [F.struct(sum((F.coalesce(F.col(f"f_{m}_{k}"), F.lit(False)).cast("int") for k in range(len(words))), F.lit(0)).alias("score"), F.lit(-m).alias("order"), F.lit(name).alias("mode")) for m, (name, words) in enumerate(MODES.items())]
    best = F.array_max(F.array(*scores))
    return keyed.select(*([deck] if deck else []), F.when(best["score"] > 0, best["mode"]).otherwise(DEFAULT_MODE).alias("mode"))


def language(found: DataFrame) -> DataFrame:
    """``language``: zh with eight CJK characters or more in all notes together, else en."""
    return found.groupBy().agg(F.when(F.coalesce(F.sum("cjk"), F.lit(0)) >= CJK_LEAST, "zh").otherwise("en").alias("language"))


def heading_role(title: Column) -> Column:
    return first_match([(F.lower(title).rlike(words), role) for words, role in HEADING_ROLES], "supporting concept")


def title_role(title: Column) -> Column:
    return first_match([(F.lower(title).rlike(words), role) for words, role in TITLE_ROLES], "claim")


def _labels(pairs: list[tuple[Column, Column | str]], otherwise: str) -> Column:
    found = F.filter(F.array(*[F.when(cond, label if isinstance(label, Column) else F.lit(label)) for cond, label in pairs]), lambda x: x.isNotNull())
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(otherwise)))


def evidence(found: DataFrame) -> DataFrame:
    """``path``, ``evidence``, ``proofs``, ``gaps`` of each summarised note."""
    heads = F.lower(F.array_join(F.transform("headings", lambda h: h["text"]), " "))
    links = F.size("markdown_links") + F.size("wiki_links")
    counted = lambda n, what: F.concat(n.cast("string"), F.lit(f" {what}"))
    maths, tables, images = F.col("math_blocks"), F.col("tables"), F.col("images")
    limits, tested = heads.rlike("局限|limitation|risk|风险|failure|失败"), heads.rlike("experiment|实验|结果|result|ablation|消融")
    present = _labels([(maths > 0, counted(maths, "formula block(s)")), (tables > 0, counted(tables, "table(s)")), (images > 0, counted(images, "image/figure(s)")), (links > 0, counted(links, "link(s)")), (tested, "experiment/result section"), (limits, "limitation/risk section")], "headings/text only")
    proofs = _labels(
        [(heads.rlike(HEADING_ROLES[0][0]), "problem contrast"), (heads.rlike(HEADING_ROLES[1][0]), "mechanism diagram"), (maths > 0, "equation-to-intuition bridge"), (tables > 0, "result/comparison table"), (images > 0, "annotated figure or example panel"), (tested, "evidence slide"), (limits, "limitation/failure-case slide")],
        "claim-and-evidence text slide",
    )
    missing = _labels(
        [(links == 0, "no source links detected"), ((maths == 0) & heads.rlike(HEADING_ROLES[2][0]), "formula-related heading without math block"), ((tables + images == 0) & heads.rlike("实验|experiment|result|结果"), "evidence heading without table/figure"), (~limits, "limitations not explicit")],
        "no obvious structural gaps",
    )
    return found.select("path", present.alias("evidence"), proofs.alias("proofs"), missing.alias("gaps"))


def backlog(found: DataFrame, most: int = 10) -> DataFrame:
    """``path``, ``pos``, ``title``, ``role``, ``proof`` for the first headings of level two and three of each note (a report of ten)."""
    heads = F.slice(F.filter("headings", lambda h: h["level"].between(2, 3)), F.lit(1), F.lit(most))
    proofs = evidence(found).select("path", F.array_join(F.slice("proofs", 1, 2), ", ").alias("two"))
    each = found.select("path", "math_blocks", "tables", "images", F.posexplode(heads).alias("pos", "h")).withColumn("role", heading_role(F.col("h")["text"])).join(proofs, "path")
    proof = (
        F.when(F.col("role") == "problem framing", "problem contrast or motivation evidence")
        .when(F.col("role") == "method/mechanism", "mechanism diagram")
        .when(F.col("role") == "formula/algorithm", F.when(F.col("math_blocks") > 0, "equation-to-intuition bridge").otherwise("algorithm sketch with variable checklist"))
        .when(F.col("role") == "evidence/results", F.when(F.col("tables") > 0, "result/comparison table").when(F.col("images") > 0, "annotated result figure").otherwise("evidence summary with missing table/figure flagged"))
        .when(F.col("role") == "limitations", "limitation/failure-case slide")
        .when(F.col("role") == "discussion", "discussion prompts and implication map")
        .otherwise(F.col("two"))
    )
    return each.select("path", "pos", F.col("h")["text"].alias("title"), "role", proof.alias("proof"))


def _section(names: str) -> Column:
    return F.regexp_extract("text", rf"(?s)(?:^|\n)## (?:{names})[ \t]*\n(.*?)(?=\n## |\z)", 1)


def spine(briefs: DataFrame) -> DataFrame:
    """``deck``, ``pos``, ``title``, ``role``, ``proof``: numbered lines of a brief's spine, the proof of the first backlog item of that role."""
    items = F.regexp_extract_all(_section(BACKLOG_HEADINGS), F.lit(BACKLOG_ITEM), F.lit(0))
    parsed = F.transform(items, lambda x: F.struct(F.regexp_extract(x, BACKLOG_ITEM, 1).alias("role"), F.regexp_extract(x, BACKLOG_ITEM, 3).alias("proof")))
    lines = F.regexp_extract_all(_section(SPINE_HEADINGS), F.lit(r"(?m)^\s*\d+\.\s+(.+?)\s*$"), F.lit(1))
    read = briefs.select("deck", parsed.alias("items"), lines.alias("lines"))  # apart: a generator's own select drops names inside structs
    each = read.select("deck", "items", F.posexplode("lines").alias("pos", "title")).withColumn("role", title_role(F.col("title")))
    first = F.try_element_at(F.filter("items", lambda x: x["role"] == F.col("role")), F.lit(1))["proof"]
    return each.select("deck", "pos", "title", "role", F.coalesce(first, F.lit(DEFAULT_PROOF)).alias("proof"))


def total_slides(briefs: DataFrame) -> DataFrame:
    """``deck``, ``total`` that a brief states; null without one, ``valid`` is false below two."""
    total = F.expr(f"try_cast(nullif(regexp_extract(text, r'{TOTAL_SLIDES}', 1), '') as int)")
    return briefs.select("deck", total.alias("total"), F.coalesce(total >= 2, F.lit(True)).alias("valid"))


def within_budget(slides: DataFrame, most: int | None = None) -> DataFrame:
    """Slides of each deck with limitations and appendix last, one of each, within ``most`` slides.

    A single slide is the first of the others, two are that and the limitations;
    without a budget, missing ones are added and the order stays.
    """
    columns = ["deck", "pos", "title", "role", "proof"]
    decks = slides.select("deck").distinct()
    plain = slides.where("role not in ('limitations', 'appendix')")
    extra = []
    for order, (title, role, proof) in enumerate((LIMITATION, APPENDIX)):
        own = slides.where(F.col("role") == role).groupBy("deck").agg(F.min_by(F.struct("title", "proof"), "pos").alias("own"))
        extra.append(decks.join(own, "deck", "left").select("deck", F.lit((1 << 30) + order).alias("pos"), F.coalesce("own.title", F.lit(title)).alias("title"), F.lit(role).alias("role"), F.coalesce("own.proof", F.lit(proof)).alias("proof"), F.col("own").isNull().alias("added")))
    if most is None:
        return slides.select(*columns).unionByName(extra[0].unionByName(extra[1]).where("added").select(*columns))
    most = max(1, most)
    nth = F.row_number().over(Window.partitionBy("deck").orderBy("pos"))
    kept = plain.select(*columns).withColumn("nth", nth).where(F.col("nth") <= max(1, most - 2)).drop("nth")
    filled = plain.select("deck").distinct().withColumn("filled", F.lit(True))
    last = extra[0].unionByName(extra[1]).join(filled, "deck", "left")
    room = F.when(F.col("filled"), F.lit(most - 1)).otherwise(F.lit(most))
    spare = F.row_number().over(Window.partitionBy("deck").orderBy("pos"))
    return kept.unionByName(last.withColumn("nth", spare).where(F.col("nth") <= room).select(*columns))


def title_issues(titles: DataFrame) -> DataFrame:
    """``deck``, ``pos``, ``issue`` of titles that are empty, of several lines, too long or too wide; ``units`` is their width."""
    text = F.col("title")
    why = first_match([(F.trim(text) == "", "empty"), (text.rlike("[\r\n]"), "several lines"), (F.length(text) > MAX_TITLE_CHARS, "too long"), (F.col("units") > MAX_TITLE_UNITS, "too wide")])
    return titles.select("deck", "pos", why.alias("issue")).where("issue is not null")
