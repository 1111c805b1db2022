"""Queries of guidance, workspaces, special folders, commands, metadata and trees over suppliers and documents as files."""

from __future__ import annotations

import io
import tarfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.operators import guidance
from foliospark.plans.registers import _SLIDES, _view
from foliospark.plans.registry import query, table
from foliospark.session import dealt
from foliospark.sinks import packages as pack
from foliospark.sources import packages

_NL, _TICK = "chr(10)", "chr(96)"
_FENCE = f"concat({_TICK}, {_TICK}, {_TICK})"
_GUIDES = f"""SELECT concat('g', doc_id, '.md') AS path, doc_id, concat(CASE WHEN doc_id % 9 = 0 THEN '' ELSE concat('---', {_NL}, 'course: ', CASE WHEN doc_id % 5 = 0 THEN 'x' ELSE '仓库规则' END, {_NL}, 'note_type: agent_rule', {_NL}, 'source_files: []', {_NL}, 'coverage: special_rule', {_NL}, 'last_checked: ', CASE WHEN doc_id % 4 = 0 THEN '2024-02-31' ELSE '2024-02-03' END, {_NL},
 'tags:', {_NL}, '  - course/仓库规则', {_NL}, CASE WHEN doc_id % 3 = 0 THEN '' ELSE concat('  - type/agent_rule', {_NL}) END, '---', {_NL}) END, CASE doc_id % 6 WHEN 0 THEN '默认流程会提交代码' WHEN 1 THEN '可以直接推送' WHEN 2 THEN '提交和推送必须经用户授权。' WHEN 3 THEN concat({_FENCE}, {_NL}, '自动提交') WHEN 4 THEN concat('$$ x', {_NL}, '======= ') ELSE concat('bell', chr(7)) END, {_NL}, 'end') AS text FROM documents"""


@query(f"""WITH n AS ({_GUIDES}) SELECT 'guidance_frontmatter' AS rule, path, 0 AS line_no FROM n WHERE doc_id % 9 = 0 UNION ALL SELECT 'guidance_value', path, 0 FROM n WHERE regexp_matches(text, '^---\\ncourse: x') UNION ALL SELECT 'guidance_value', path, 0 FROM n WHERE contains(text, '2024-02-31')
UNION ALL SELECT 'guidance_tags', path, 0 FROM n WHERE text LIKE '---%' AND NOT contains(text, 'type/agent_rule') UNION ALL SELECT 'unclosed_fence', path, 0 FROM n WHERE len(string_split(text, '```')) % 2 = 0 UNION ALL SELECT 'unbalanced_math', path, 0 FROM n WHERE len(string_split(text, '$$')) % 2 = 0
UNION ALL SELECT 'conflict_marker', path, 0 FROM n WHERE contains(text, chr(10) || '=======') UNION ALL SELECT 'control_character', path, 0 FROM n WHERE contains(text, chr(7))
UNION ALL SELECT 'default_authority', path, len(string_split(split_part(text, '默认', 1), chr(10)))::INT FROM n WHERE contains(text, '默认') UNION ALL SELECT 'automatic_authority', path, len(string_split(split_part(text, '可以直接', 1), chr(10)))::INT FROM n WHERE contains(text, '可以直接')
UNION ALL SELECT 'authority_not_stated', path, 0 FROM n WHERE NOT contains(text, '必须经用户授权')""")
def guidance_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frontmatter, fences, math, markers and wording of guidance files."""
    return guidance.guidance_issues(_view(spark, sf_dir, "documents", _GUIDES)).select("rule", "path", "line_no")


_TREE = """SELECT concat(CASE p_partkey % 8 WHEN 0 THEN 'notes/AGENT.md' WHEN 1 THEN 'Agent.md' WHEN 2 THEN 'scripts' WHEN 3 THEN concat('agent/a', p_partkey, '.md') WHEN 4 THEN 'agents/x.md' WHEN 5 THEN concat('notes/.github/workflows/w', p_partkey, '.yml') WHEN 6 THEN concat('notes/.github/l', p_partkey, '.lock.json') ELSE concat('notes/n', p_partkey, '.md') END) AS path,
 CASE p_partkey % 8 WHEN 3 THEN CASE WHEN p_partkey % 3 = 0 THEN '/Users/me/x' ELSE 'fine' END WHEN 5 THEN concat('uses: a@', repeat(CASE WHEN p_partkey % 3 = 0 THEN 'b' ELSE 'a' END, 40)) WHEN 6 THEN CASE WHEN p_partkey % 3 = 0 THEN '{"commit":"short"}' ELSE concat('{"commit":"', repeat('a', 40), '"}') END ELSE 'text' END AS text, p_partkey FROM part"""


@query(f"""WITH f AS ({_TREE}) SELECT 'missing_workspace_object' AS rule, x AS path FROM (SELECT unnest(['AGENT.md', 'agent', 'notes', 'skills']) AS x) WHERE x NOT IN (SELECT split_part(path, '/', 1) FROM f) UNION ALL SELECT DISTINCT 'duplicate_agent_folder', 'agents' FROM f WHERE path LIKE 'agents/%'
UNION ALL SELECT 'machine_path', path FROM f WHERE path LIKE 'agent/%' AND contains(text, '/Users/') UNION ALL SELECT 'lock_commit', path FROM f WHERE path LIKE '%.lock.json' AND contains(text, 'short') UNION ALL SELECT 'unlocked_commit', path FROM f WHERE path LIKE '%.yml' AND contains(text, 'bbb')""")
def workspaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects, machine paths, locks and workflows of a workspace."""
    return guidance.workspace_issues(_view(spark, sf_dir, "part", _TREE)).select("rule", "path")


@query(f"WITH f AS ({_TREE}) SELECT 'guidance_boundary' AS rule, path FROM f WHERE lower(regexp_extract(path, '[^/]*$')) = 'agent.md' AND path <> 'AGENT.md' UNION ALL SELECT 'maintenance_inside', path FROM f WHERE path = 'scripts'")
def guidance_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Guidance under other names and maintenance code inside a vault."""
    return guidance.boundary_issues(_view(spark, sf_dir, "part", _TREE)).select("rule", "path")


_SPECIAL = f"""SELECT concat(CASE doc_id % 6 WHEN 0 THEN '概念索引/' WHEN 1 THEN '游戏数值策划/表格模板/' WHEN 2 THEN '科研方法论/' WHEN 3 THEN '计算机视觉/图像Raw域去噪/' WHEN 4 THEN '.obsidian/templates/' ELSE 'a/' END, CASE WHEN doc_id = 4 THEN 'course_note.md' WHEN doc_id % 12 = 0 THEN 'source_manifest.md' ELSE concat('n', doc_id, '.md') END) AS path, doc_id,
 concat('---', {_NL}, 'note_type: ', CASE WHEN doc_id % 4 = 0 THEN 'template' ELSE 'odd' END, {_NL}, 'source_url: u', {_NL}, CASE WHEN doc_id % 9 = 0 THEN concat('source_type: t', {_NL}) ELSE '' END, '---', {_NL}, CASE WHEN doc_id % 5 = 0 THEN '在此填写 每周复盘模板' ELSE text END) AS text FROM documents"""


@query(f"""WITH n AS ({_SPECIAL}), k AS (SELECT *, len([x FOR x IN string_split(split_part(text, '---' || chr(10), 3) || substr(text, 100000), chr(10)) IF regexp_matches(x, '\\S')]) AS lines FROM n)
SELECT 'missing_special_folder' AS rule, '学习路径' AS path UNION ALL SELECT 'missing_special_entry', '.obsidian/templates/' || t FROM (SELECT unnest({guidance.TEMPLATES}) AS t) WHERE '.obsidian/templates/' || t NOT IN (SELECT path FROM n) UNION ALL SELECT 'missing_special_entry', 'b/gone.md'
UNION ALL SELECT 'template_type', path FROM n WHERE doc_id % 6 = 4 AND doc_id % 4 <> 0 UNION ALL SELECT 'template_instruction', path FROM n WHERE doc_id % 6 = 4 AND doc_id % 5 = 0 UNION ALL SELECT 'note_contract', 'a/n5.md' UNION ALL SELECT 'concept_manifest', path FROM n WHERE doc_id % 12 = 0
UNION ALL SELECT 'study_plan_wording', path FROM n WHERE doc_id % 6 = 2 AND doc_id % 5 = 0 UNION ALL SELECT 'source_type_missing', path FROM n WHERE doc_id % 6 = 3 AND doc_id % 9 <> 0 UNION ALL SELECT 'short_table_template', path FROM k WHERE doc_id % 6 = 1 AND lines < 6""")
def special_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folders, templates, contract notes and wording of special folders."""
    found = guidance.special_folder_issues(_view(spark, sf_dir, "documents", _SPECIAL), ["概念索引", "学习路径", "a"], ["b/gone.md"], {"a/n5.md": ("exam_review", "type/exam_review")})
    return found.select("rule", "path")


_COMMANDS = f"""SELECT concat(CASE WHEN s_suppkey % 3 = 0 THEN concat('skill/k', s_suppkey, '/') ELSE '' END, 'G', s_suppkey, '.md') AS path, s_suppkey, concat('Run scripts/check.py or skill/k1/scripts/own.py now', {_NL}, {_FENCE}, {_NL}, 'cd skill/k', s_suppkey, {_NL}, 'python scripts/own.py', {_NL}, {_FENCE}, {_NL}, 'then scripts/check.py') AS text FROM supplier"""


@query("""WITH s AS (SELECT s_suppkey AS k, CASE WHEN s_suppkey % 3 = 0 THEN 'skill/k' || s_suppkey || '/' ELSE '' END AS base FROM supplier), r AS (SELECT base || 'G' || k || '.md' AS path, unnest([1, 1, 4, 6])::INT AS line_no, unnest(['scripts/check.py', 'skill/k1/scripts/own.py', 'scripts/own.py', 'scripts/check.py']) AS token, unnest([base || 'scripts/check.py', 'skill/k1/scripts/own.py', 'skill/k' || k || '/scripts/own.py', base || 'scripts/check.py']) AS target FROM s)
SELECT *, target = 'scripts/check.py' OR target IN (SELECT 'skill/k' || s_suppkey || '/scripts/own.py' FROM supplier WHERE s_suppkey % 2 = 1) AS known FROM r""")
def documented_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scripts that guides name, resolved by context, against those that exist."""
    files = _view(spark, sf_dir, "supplier", _COMMANDS)
    there = table(spark, sf_dir, "supplier").where("s_suppkey % 2 = 1").select(F.concat(F.lit("skill/k"), "s_suppkey", F.lit("/scripts/own.py")).alias("path"))
    return guidance.documented_commands(files, there.union(spark.createDataFrame([("scripts/check.py",)], "path string")))


_META = f"""SELECT concat('pack-', c_custkey) AS path, c_custkey, CASE WHEN c_custkey % 7 = 0 THEN 'interface' ELSE concat('interface:', {_NL}, '  display_name: "P"', {_NL}, '  short_description: "', CASE WHEN c_custkey % 4 = 0 THEN 'short' ELSE 'a description that is long enough' END, '"', {_NL}, '  default_prompt: "use ', CASE WHEN c_custkey % 5 = 0 THEN 'it' ELSE concat('$pack-', c_custkey) END, ' now"', {_NL},
 CASE WHEN c_custkey % 3 = 0 THEN concat('  brand_color: "red"', {_NL}) ELSE '' END, CASE WHEN c_custkey % 6 = 0 THEN concat('  extra: 1', {_NL}) ELSE '' END, 'policy:', {_NL}, '  allow_implicit_invocation: true') END AS text FROM customer"""


@query(f"""WITH m AS ({_META}), s AS (SELECT * FROM m WHERE c_custkey % 7 <> 0) SELECT 'metadata_unreadable' AS rule, path, 'line 1: no key' AS message FROM m WHERE c_custkey % 7 = 0 UNION ALL SELECT 'metadata', path, 'short_description' FROM s WHERE c_custkey % 4 = 0 UNION ALL SELECT 'metadata', path, 'default_prompt' FROM s WHERE c_custkey % 5 = 0
UNION ALL SELECT 'metadata', path, 'brand_color' FROM s WHERE c_custkey % 3 = 0 UNION ALL SELECT 'metadata', path, 'unknown: extra' FROM s WHERE c_custkey % 6 = 0""")
def package_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Problems of packages' YAML metadata."""
    packs = dealt(_view(spark, sf_dir, "customer", _META).select("path", "text"), "path")
    return guidance.metadata_issues(packs).select("rule", "path", "message")


@query("WITH a AS (SELECT o_orderkey AS k, o_orderkey % 11 AS d FROM orders WHERE o_orderkey % 5 <> 0), b AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 13 ELSE o_orderkey % 11 END AS d FROM orders WHERE o_orderkey % 4 <> 0) SELECT coalesce(a.k, b.k) AS path, CASE WHEN b.k IS NULL THEN 'copy' WHEN a.k IS NULL THEN 'remove' WHEN a.d <> b.d THEN 'replace' ELSE 'keep' END AS action FROM a FULL JOIN b ON a.k = b.k")
def install_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What makes one tree equal another, stale files removed."""
    key = F.col("o_orderkey")
    orders = table(spark, sf_dir, "orders").select("o_orderkey")
    wanted = orders.where(key % 5 != 0).select(key.alias("path"), F.sha2((key % 11).cast("string"), 256).alias("sha256"))
    found = orders.where(key % 4 != 0).select(key.alias("path"), F.sha2(F.when(key % 3 == 0, key % 13).otherwise(key % 11).cast("string"), 256).alias("sha256"))
    return guidance.install_plan(wanted, found, prune=True)


@query("SELECT 't' || n_regionkey || '.tar' AS path, n_name AS name, octet_length(encode(n_name))::BIGINT AS size, sha256(n_name) AS sha256 FROM nation")
def tar_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations packed as tar files by region and read again below a prefix."""

    def one(group: pd.DataFrame) -> pd.DataFrame:
        out = io.BytesIO()
        with tarfile.open(fileobj=out, mode="w") as archive:
            for place, name in [("skill/x/", n) for n in group["n_name"]] + [("other/", "y")]:
                info = tarfile.TarInfo(place + name)
                info.size = len(name.encode())
                archive.addfile(info, io.BytesIO(name.encode()))
        return pd.DataFrame({"path": [f"t{group['n_regionkey'].iloc[0]}.tar"], "content": [out.getvalue()]})

    made = table(spark, sf_dir, "nation").groupBy("n_regionkey").applyInPandas(one, "path string, content binary")
    return packages.tar_members(made, "skill/x/").select("path", "name", "size", "sha256")


@query("SELECT 'd' || n_regionkey || '.pptx' AS path, count(*) + 1 AS slides, CASE WHEN n_regionkey = 2 THEN 'slides' ELSE 'sound' END AS problem FROM nation GROUP BY n_regionkey UNION ALL SELECT 'gone.pptx', 0, 'missing'")
def deck_verification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slide packages against the number of slides they should have."""
    slides = _view(spark, sf_dir, "nation", _SLIDES)
    expected = slides.groupBy(F.concat("deck", F.lit(".pptx")).alias("path")).agg(F.count("*").alias("n")).select("path", (F.col("n") + F.when(F.col("path") == "d2.pptx", 2).otherwise(1)).alias("slides"))
    expected = expected.union(spark.createDataFrame([("gone.pptx", 3)], "path string, slides long"))
    return packages.deck_problems(pack.decks(slides), expected).select("path", "slides", F.coalesce("problem", F.lit("sound")).alias("problem"))
