"""Guidance files, workspaces, special folders, documented commands and package metadata.

Input is ``path`` and ``text`` of the files in question, so every rule is a
filter or a join over rows; code is blanked by the fence toggle only.

Cases: null texts count as empty; a file without frontmatter breaks the
frontmatter rule once; rules give the columns of ``operators.rules``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.functions.text import has_control
from foliospark.operators.frames import by_line, frontmatter, lines, without_frontmatter
from foliospark.operators.rules import all_of, issue
from foliospark.sources import yaml

# What a guidance file declares, and wording about commits that it must or must not have.
VALUES = {"course": "仓库规则", "note_type": "agent_rule", "source_files": "[]", "coverage": "special_rule"}
TAGS = ["course/仓库规则", "type/agent_rule"]
DEFAULT_AUTHORITY = "默认[^。！？\n]{0,80}(?:提交|推送)"
AUTOMATIC_AUTHORITY = (
    "(?:自动(?:提交|推送)|(?:无需|无须|不需要|不必)(?:用户)?(?:明确)?授权[^。！？\n]{0,20}(?:提交|推送)|(?:提交|推送)[^。！？\n]{0,20}(?:无需|无须|不需要|不必)(?:用户)?(?:明确)?授权|(?<!不)可(?:以)?直接(?:提交|推送))"
)
BINDING = "必须|只有|仅(?:在|当)?|经"
RESERVED = ["scripts", "tests", ".githooks", "pyproject.toml"]
# Objects of a workspace and paths of one machine.
WORKSPACE = ["AGENT.md", "agent", "notes", "skills"]
MACHINE_PATH = r"(?:/Users/|/opt/anaconda3|/opt/homebrew|[A-Za-z]:\\Users\\)"
# Templates, and wording of special folders.
TEMPLATE_DIR = ".obsidian/templates"
TEMPLATES = [
    "algorithm_error_log.md", "course_note.md", "paper_note.md", "concept_note.md", "source_manifest.md", "review_compact.md", "review_detailed.md",
    "game_design_note.md", "exam_review.md",
]
TEMPLATE_RESIDUE, PLAN_WORDS = "在此填写|必填字段说明", "每周复盘模板|达标标准"
CONCEPTS, TABLES, METHODS, DENOISING = "概念索引/", "游戏数值策划/表格模板/", "科研方法论/", "计算机视觉/图像Raw域去噪/"
LEAST_TABLE_LINES = 6
# The keys of a package's metadata.
NAME = "^[a-z0-9]+(?:-[a-z0-9]+)*$"
TOP_KEYS, INTERFACE_KEYS = ["dependencies", "interface", "policy"], ["brand_color", "default_prompt", "display_name", "icon_large", "icon_small", "short_description"]
POLICY_KEYS, DEPENDENCY_KEYS, ICON_KEYS = ["allow_implicit_invocation"], ["tools"], ["icon_large", "icon_small"]
TOOL_KEYS = ["description", "transport", "type", "url", "value"]
NEEDED_KEYS = ["default_prompt", "display_name", "short_description"]
COMMAND = r"(?<![\w./-])((?:scripts|skill|agent|notes)/[A-Za-z0-9_./-]+\.(?:py|sh))"


def _name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def unfenced(docs: DataFrame) -> DataFrame:
    """``path``, ``line_no``, ``line`` and ``inside``: whether a fence is open there (fence lines are inside)."""
    rows = lines(docs.select("path", F.coalesce("text", F.lit("")).alias("text")))
    fence = F.col("line").rlike("^ {0,3}(`{3,}|~{3,})")
    so_far = F.sum(fence.cast("int")).over(by_line().rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumns({"fences": so_far, "inside": fence | (so_far % 2 == 1)})


def guidance_issues(files: DataFrame) -> DataFrame:
    """Frontmatter values and tags, fences, math, conflict markers, control characters, and wording about commits."""
    docs = files.select("path", F.coalesce("text", F.lit("")).alias("text"))
    front = frontmatter(docs)
    expected = F.explode(F.array(*(F.struct(F.lit(k).alias("key"), F.lit(v).alias("value")) for k, v in VALUES.items())))
    wrong = front.select("path", "keys", expected.alias("e")).where(~F.try_element_at("keys", F.col("e.key")).eqNullSafe(F.col("e.value")))
    checked = F.try_element_at("keys", F.lit("last_checked"))
    stale = front.where(~F.coalesce(checked.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$") & F.try_to_date(checked, "yyyy-MM-dd").isNotNull(), F.lit(False)))
    tags = F.flatten(F.transform(F.filter("lists", lambda x: x["key"] == "tags"), lambda x: x["value"]))
    untagged = front.select("path", F.array_except(F.array(*map(F.lit, TAGS)), tags).alias("missing")).where(F.size("missing") > 0)
    rows = unfenced(docs)
    prose = rows.where("not inside")
    fences = rows.groupBy("path").agg(F.max("fences").alias("n")).where("n % 2 = 1")
    maths = prose.groupBy("path").agg(F.sum(F.regexp_count("line", F.lit(r"\$\$"))).alias("n")).where("n % 2 = 1")
    sentence = F.explode(F.split("line", "[。！？]+"))
    granted = prose.select("path", sentence.alias("s")).where(F.contains("s", F.lit("提交")) & F.contains("s", F.lit("推送")) & F.contains("s", F.lit("用户")) & F.contains("s", F.lit("授权")) & F.col("s").rlike(BINDING))
    return all_of(
        issue(docs.where(~F.col("text").rlike(r"(?s)^---\n.*?\n---")), "guidance_frontmatter", F.lit("missing frontmatter")),
        issue(wrong, "guidance_value", F.col("e.key")),
        issue(stale, "guidance_value", F.lit("last_checked")),
        issue(untagged, "guidance_tags", F.array_join("missing", ", ")),
        issue(fences, "unclosed_fence", F.lit("fence")),
        issue(maths, "unbalanced_math", F.col("n").cast("string")),
        issue(docs.where(F.col("text").rlike("(?m)^(<<<<<<<|=======|>>>>>>>)")), "conflict_marker", F.lit("conflict marker")),
        issue(docs.where(has_control(F.col("text"))), "control_character", F.lit("control character")),
        issue(prose.where(F.col("line").rlike(DEFAULT_AUTHORITY)), "default_authority", F.lit("default commit or push"), F.col("line_no")),
        issue(prose.where(F.col("line").rlike(AUTOMATIC_AUTHORITY)), "automatic_authority", F.lit("automatic commit or push"), F.col("line_no")),
        issue(docs.join(granted.select("path").distinct(), "path", "left_anti"), "authority_not_stated", F.lit("user authorization")),
    )


def boundary_issues(files: DataFrame) -> DataFrame:
    """Guidance under another name or place, and maintenance code inside a vault (``files``: path of files and folders)."""
    name = _name(F.col("path"))
    extra = files.where((F.lower(name) == "agent.md") & (F.col("path") != "AGENT.md"))
    return all_of(
        issue(extra, "guidance_boundary", F.when(F.contains("path", F.lit("/")), "additional guidance").otherwise("canonical name")),
        issue(files.where(name.isin(RESERVED)), "maintenance_inside", name),
    )


def workspace_issues(files: DataFrame) -> DataFrame:
    """Missing objects, a doubled agent folder, machine paths in guidance, and commits in workflows that the lock does not name."""
    spark = files.sparkSession
    tops = files.select(F.substring_index("path", "/", 1).alias("path")).distinct()
    missing = spark.createDataFrame([(p,) for p in WORKSPACE], "path string").join(tops, "path", "left_anti")
    guidance = files.where(F.col("path").isin("AGENT.md", "notes/AGENT.md") | F.col("path").rlike(r"^agent/[^/]+\.md$"))
    locked = files.where(F.col("path").endswith(".lock.json")).select(F.get_json_object("text", "$.commit").alias("commit"))
    full = locked.where(F.col("commit").rlike("^[0-9a-f]{40}$"))
    flows = files.where(F.col("path").rlike(r"\.github/workflows/[^/]+\.ya?ml$")).select("path", F.explode(F.regexp_extract_all("text", F.lit("(?<![0-9a-f])[0-9a-f]{40}(?![0-9a-f])"), F.lit(0))).alias("commit"))
    return all_of(
        issue(missing, "missing_workspace_object", F.lit("required")),
        issue(tops.where("path = 'agents'"), "duplicate_agent_folder", F.lit("agents")),
        issue(guidance.where(F.col("text").rlike(MACHINE_PATH)), "machine_path", F.lit("absolute path")),
        issue(files.where(F.col("path").endswith(".lock.json")).where(~F.coalesce(F.get_json_object("text", "$.commit").rlike("^[0-9a-f]{40}$"), F.lit(False))), "lock_commit", F.lit("not a full commit")),
        issue(flows.join(full, "commit", "left_anti"), "unlocked_commit", F.col("commit")),
    )


def special_folder_issues(notes: DataFrame, folders: list[str], entries: list[str], contracts: dict[str, tuple[str, str]]) -> DataFrame:
    """Missing folders, entries, templates and contract notes (path: type and tag), and wording that special folders must not have."""
    spark = notes.sparkSession
    docs = notes.select("path", F.coalesce("text", F.lit("")).alias("text"))
    there = docs.select("path")
    wanted = spark.createDataFrame([(p,) for p in [*entries, *(f"{TEMPLATE_DIR}/{t}" for t in TEMPLATES), *contracts]], "path string")
    parts = F.split("path", "/")
    ups = docs.where(F.contains("path", F.lit("/"))).select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))).alias("path")).distinct()
    absent = spark.createDataFrame([(p,) for p in folders], "path string").join(ups, "path", "left_anti")
    template = F.col("path").startswith(TEMPLATE_DIR + "/")
    front = frontmatter(docs)
    kind = F.try_element_at("keys", F.lit("note_type"))
    typed = F.flatten(F.transform(F.filter("lists", lambda x: x["key"] == "tags"), lambda x: F.filter(x["value"], lambda t: t.startswith("type/"))))
    expected = spark.createDataFrame([(p, *v) for p, v in contracts.items()] or [("", "", "")], "path string, type string, tag string").where("path <> ''")
    held = docs.join(front.withColumnsRenamed({"keys": "k", "lists": "l"}), "path", "left").select("path", F.try_element_at("k", F.lit("note_type")).alias("kind"))
    broken = expected.join(front.select("path", kind.alias("kind"), typed.alias("tags")), "path").where("not (kind <=> type) or tags <> array(tag)")
    body = without_frontmatter(docs).select("path", F.size(F.filter(F.split("body", "\n"), lambda x: x.rlike(r"\S"))).alias("n"))
    return all_of(
        issue(absent, "missing_special_folder", F.lit("folder")),
        issue(wanted.join(there, "path", "left_anti"), "missing_special_entry", F.lit("file")),
        issue(held.where(template & ~F.col("kind").eqNullSafe("template")), "template_type", F.coalesce("kind", F.lit(""))),
        issue(docs.where(template & F.col("text").rlike(TEMPLATE_RESIDUE)), "template_instruction", F.lit("instruction")),
        issue(broken, "note_contract", F.coalesce("kind", F.lit(""))),
        issue(docs.where(F.col("path").startswith(CONCEPTS) & (_name(F.col("path")) == "source_manifest.md")), "concept_manifest", F.lit("manifest")),
        issue(body.where(F.col("path").startswith(TABLES) & (F.col("n") < LEAST_TABLE_LINES)), "short_table_template", F.col("n").cast("string")),
        issue(docs.where(F.col("path").startswith(METHODS) & F.col("text").rlike(PLAN_WORDS)), "study_plan_wording", F.lit("wording")),
        issue(front.where(F.col("path").startswith(DENOISING) & F.map_contains_key("keys", "source_url") & ~F.map_contains_key("keys", "source_type")), "source_type_missing", F.lit("source_type")),
    )


def documented_commands(files: DataFrame, known: DataFrame) -> DataFrame:
    """``path``, ``line_no``, ``token``, ``target`` of documented scripts and whether the file is ``known`` (path).

    In a fence, the last ``cd skill/<name>`` says whose ``scripts/`` are meant; a
    guide inside ``skill/<name>`` means its own; otherwise the root's.
    """
    rows = unfenced(files)
    fenced = F.col("inside") & ~F.col("line").rlike("^ {0,3}(`{3,}|~{3,})")
    moved = F.when(fenced, F.nullif(F.regexp_extract("line", r"\bcd\s+skill[/\\]([A-Za-z0-9_.-]+)", 1), F.lit("")))
    block = Window.partitionBy("path", "fences").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    each = rows.withColumn("skill", F.last(moved, ignorenulls=True).over(block)).select("path", "line_no", "skill", F.explode(F.regexp_extract_all("line", F.lit(COMMAND), F.lit(1))).alias("token"))
    own = F.nullif(F.regexp_extract("path", "^skill/([^/]+)/", 1), F.lit(""))
    whose = F.coalesce("skill", own)
    target = F.when(F.col("token").startswith("scripts/") & whose.isNotNull(), F.concat_ws("/", F.lit("skill"), whose, "token")).otherwise(F.col("token"))
    placed = each.withColumn("target", target)
    return placed.join(known.select(F.col("path").alias("target")).distinct().withColumn("there", F.lit(True)), "target", "left").select("path", "line_no", "token", "target", F.coalesce("there", F.lit(False)).alias("known"))


def yaml_pairs(text: str) -> list[tuple[str, str]]:
    """Dotted keys and values of a YAML mapping; anything else raises ``ValueError``."""
    found = yaml.read(text)
    if not isinstance(found, dict):
        raise yaml.YamlError(1, "no key")
    return [(key, value) for key, value, _, _, _ in yaml.leaves(found)]


def metadata_issues(packages: DataFrame, assets: DataFrame | None = None) -> DataFrame:
    """Problems of packages (``path``: the name, ``text``: its YAML metadata).

    Unknown or missing keys, types, unquoted strings, lengths, colours, icons
    (that exist, where ``assets`` lists ``path`` and ``asset``), policy, tools, and
    the name's token in the prompt.
    """
    # A filter on what was read would go below the function and call it again; that which is not deterministic is called once.
    read = packages.select("path", yaml.yaml_leaves.asNondeterministic()("text").alias("y"))
    told = read.select("path", F.col("y.problem").alias("problem"), F.col("y.leaves").alias("leaves"), F.map_from_entries(F.transform("y.leaves", lambda p: F.struct(p["key"], p["value"]))).alias("m"))
    names = F.transform("leaves", lambda p: p["key"])
    part = lambda k, n: F.regexp_extract(k, r"^([^.\[]+)(?:\[\d+\])?(?:\.([^.\[]+))?", n)
    tops = F.array_distinct(F.transform(names, lambda k: part(k, 1)))
    below = lambda top: F.array_remove(F.array_distinct(F.transform(F.filter(names, lambda k: k.startswith(top)), lambda k: part(k, 2))), "")
    of = lambda key: F.coalesce(F.try_element_at("m", F.lit(f"interface.{key}")), F.lit(""))
    listed = lambda values: F.array(*map(F.lit, values))
    unknown = F.concat(F.array_except(tops, listed(TOP_KEYS)), F.array_except(below("interface."), listed(INTERFACE_KEYS)), F.array_except(below("policy."), listed(POLICY_KEYS)), F.array_except(below("dependencies."), listed(DEPENDENCY_KEYS)))
    empty = F.filter(F.array(*(F.when(F.trim(of(k)) == "", F.lit(k)) for k in NEEDED_KEYS)), lambda k: k.isNotNull())
    known = F.filter("leaves", lambda p: p["key"].isin([f"interface.{k}" for k in INTERFACE_KEYS]))
    named = lambda found: F.array_join(F.array_sort(F.transform(found, lambda p: F.substring_index(p["key"], ".", -1))), ",")
    bare = F.filter("leaves", lambda p: (p["type"] == "str") & ~p["quoted"])
    color, tools = of("brand_color"), F.filter("leaves", lambda p: p["key"].startswith("dependencies.tools"))
    token = F.concat(F.lit(r"(?<![A-Za-z0-9_$-])\$\Q"), "path", F.lit(r"\E(?![A-Za-z0-9_-])"))
    outside = r"^\s*$|\\|^/|^[A-Za-z]:|(?:^|/)\.\.(?:/|$)"
    number = F.array_distinct(F.transform(F.filter(tools, lambda p: p["key"].rlike(r"\[\d+\]")), lambda p: F.regexp_extract(p["key"], r"\[(\d+)\]", 1)))
    tool = lambda i, key: F.coalesce(F.try_element_at("m", F.concat(F.lit("dependencies.tools["), i, F.lit(f"].{key}"))), F.lit(""))
    text_of = [f"dependencies.tools[].{k}" for k in TOOL_KEYS if k != "type"]
    loose = F.filter(tools, lambda p: F.regexp_replace(p["key"], r"\[\d+\]", "[]").isin(text_of) & ((p["type"] != "str") | (F.trim(p["value"]) == "")))
    strange = F.array_except(F.array_distinct(F.transform(F.filter(tools, lambda p: p["key"].rlike(r"\]")), lambda p: F.regexp_extract(p["key"], r"\](?:\.([^.\[]+))?", 1))), listed(TOOL_KEYS))
    checks = F.array(
        F.when(~F.col("path").rlike(NAME), "name"),
        F.when(F.size(unknown) > 0, F.concat(F.lit("unknown: "), F.array_join(F.array_sort(unknown), ","))),
        F.when(F.size(empty) > 0, F.concat(F.lit("missing: "), F.array_join(empty, ","))),
        F.when(F.exists(known, lambda p: p["type"] != "str"), F.concat(F.lit("not a string: "), named(F.filter(known, lambda p: p["type"] != "str")))),
        F.when(F.size(bare) > 0, F.concat(F.lit("unquoted: "), named(bare))),
        F.when((color != "") & ~color.rlike("^#[0-9A-Fa-f]{6}$"), "brand_color"),
        F.when((of("short_description") != "") & ~F.length(of("short_description")).between(25, 64), "short_description"),
        F.when((of("default_prompt") != "") & ~F.regexp_like(of("default_prompt"), token), "default_prompt"),
        *(F.when(F.map_contains_key("m", f"interface.{k}") & of(k).rlike(outside), k) for k in ICON_KEYS),
        F.when(F.exists("leaves", lambda p: (p["key"] == "policy.allow_implicit_invocation") & (p["type"] != "bool")), "allow_implicit_invocation"),
        F.when(F.exists(names, lambda k: k.startswith("dependencies")) & ~F.exists(names, lambda k: k.rlike(r"^dependencies\.tools(?:\[|$)")), "tools"),
        F.when(F.exists("leaves", lambda p: (p["key"] == "dependencies.tools") & (p["type"] != "list")) | F.exists(names, lambda k: k.rlike(r"^dependencies\.tools\.")), "tools"),
        F.when(F.size(strange) > 0, F.concat(F.lit("unknown tool keys: "), F.array_join(F.array_sort(strange), ","))),
        F.when(F.exists(number, lambda i: tool(i, "type") != "mcp"), "tool type"),
        F.when(F.exists(number, lambda i: F.trim(tool(i, "value")) == "") | (F.size(loose) > 0), "tool text"),
    )
    unreadable = F.array(F.struct(F.lit("metadata_unreadable").alias("rule"), F.col("problem").alias("what")))
    unsound = F.transform(F.filter(checks, lambda x: x.isNotNull()), lambda x: F.struct(F.lit("metadata").alias("rule"), x.alias("what")))
    found = told.select("path", F.inline(F.when(F.col("problem").isNotNull(), unreadable).otherwise(unsound)))
    streams = [issue(found, F.col("rule"), F.col("what"))]
    if assets is not None:
        icons = told.where("problem is null").select("path", F.explode(F.array(*(F.struct(F.lit(k).alias("what"), F.regexp_replace(of(k), r"^(?:\./)+", "").alias("asset")) for k in ICON_KEYS))).alias("i")).select("path", "i.*").where((F.col("asset") != "") & ~F.col("asset").rlike(outside))
        streams.append(issue(icons.join(assets.select("path", "asset").distinct(), ["path", "asset"], "left_anti"), "metadata_asset", F.col("what")))
    return all_of(*streams)


def install_plan(source: DataFrame, installed: DataFrame, prune: bool = False) -> DataFrame:
    """``path``, ``action`` that make an installed tree equal its source (both path, sha256): copy, replace, keep, and remove or leave what is stale."""
    a, b = source.select("path", F.col("sha256").alias("wanted")), installed.select("path", F.col("sha256").alias("found"))
    action = F.when(F.col("found").isNull(), "copy").when(F.col("wanted").isNull(), "remove" if prune else "leave").when(F.col("wanted") != F.col("found"), "replace").otherwise("keep")
    return a.join(b, "path", "full").select("path", action.alias("action"))
