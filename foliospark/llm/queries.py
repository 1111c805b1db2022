"""The ``opN_*`` queries over the test tables, and the SQL that says the same where SQL can.

Each query applies its operator to the whole table and derives the digest
columns from the operator's own output.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.llm import chat_rotation, decontaminate, fill_middle, late_overwrite, line_dedup, link_graph, ngram_join, packing, quality, secret_scan, shard, token_count, weak_rules
from foliospark.llm._common import shared_dir

URL_RULES = [
    link_graph.Rule("net", "/", "block"),
    link_graph.Rule("example.net", "/en/", "allow"),
    link_graph.Rule("example.com", "/de/", "block"),
    link_graph.Rule("org", "/fr/", "allow"),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_chat_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation from every participant's side, one row per rendered turn; -1 where nothing is trained on."""
    turns = chat_rotation.rotate_perspectives(table(spark, sf_dir, "conversations")).withColumnRenamed("conv", "conv_id")
    return turns.withColumns({c: F.coalesce(c, F.lit(-1)) for c in ("train_start", "train_end")})


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram token counts of all documents."""
    path = public_tokenizers.path("piece_bpe_32k.model")
    return token_count.count_tokens(table(spark, sf_dir, "documents"), path).withColumnRenamed("id", "doc_id")


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents inside windows of benchmark items."""
    found = decontaminate.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 10, ["doc_id"])
    hit = F.aggregate("folio_spans", F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"] + 1)
    return found.select(
        "doc_id",
        F.col("folio_words").alias("n_words"),
        hit.alias("n_hit"),
        F.size("folio_items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("folio_items"), ","), 256).alias("items_sha256"),
        (F.size("folio_spans") > 0).alias("contaminated"),
    )


def op4_histogram_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards of near-equal bytes."""
    placed = shard.shard_by_bytes(table(spark, sf_dir, "documents").select("doc_id", "text"), 24)
    return placed.select(
        "doc_id",
        F.col("folio_size").alias("size"),
        F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"),
        F.lit("bytes").alias("law"),
        F.col("folio_shard").alias("shard"),
        F.col("folio_slot").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op5_quality_qda(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents."""
    return quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).withColumnRenamed("id", "doc_id")


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 3-word shingle sets are 0.9 similar."""
    found = ngram_join.ngram_components(table(spark, sf_dir, "documents"), n=3, percent=90)
    return found.select(F.col("id").alias("doc_id"), F.col("n_grams").alias("n_shingles"), F.col("component").alias("component_id"), F.col("links").alias("n_links"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of all documents that repeat an earlier line within two edits, and what is left."""
    done = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return done.select(
        "doc_id",
        F.size(F.split(F.coalesce("text", F.lit("")), "\n", -1)).cast("long").alias("n_lines"),
        F.size("folio_removed").cast("long").alias("n_removed"),
        F.array_join(F.col("folio_removed").cast("array<string>"), ",").alias("removed_lines"),
        F.sha2(F.coalesce("folio_kept_text", F.lit("")), 256).alias("kept_sha256"),
    )


def op8_link_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict for the url of every page."""
    judged = link_graph.filter_urls(table(spark, sf_dir, "pages"), URL_RULES, ["page_id"])
    return judged.select("page_id", F.col("folio_host").alias("host"), F.col("folio_path").alias("path"), F.col("folio_rule").alias("rule"), F.col("folio_verdict").alias("verdict"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 2048 tokens."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    return packing.pack(table(spark, sf_dir, "documents"), path, 2048).withColumnRenamed("id", "doc_id")


def op10_weak_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base statistics and weak-supervision verdict of all documents."""
    judged = weak_rules.judge(table(spark, sf_dir, "documents"), keep_columns=["doc_id"])
    words, repeats = F.col("folio_words"), F.col("folio_repeat_words")
    failed = (words < 50) | (100 * repeats > 50 * words)
    return judged.select(
        "doc_id",
        words.alias("n_words"),
        F.col("folio_chars").alias("word_chars"),
        F.col("folio_symbols").alias("n_symbols"),
        F.col("folio_dup_lines").alias("n_dup_lines"),
        repeats.alias("n_repeat_words"),
        failed.alias("base_failed"),
        (~failed & F.col("folio_good")).alias("kept"),
        F.round("folio_posterior", 6).alias("posterior"),
    )


def rule_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The statistics that the rules of ``op10_weak_rules`` vote on, for all documents (SQL holds these; the estimate has none)."""
    found = weak_rules.base_statistics(table(spark, sf_dir, "documents").select("doc_id", "text"))
    names = {"words": "n_words", "chars": "word_chars", "symbols": "n_symbols", "dup_lines": "n_dup_lines", "repeat_words": "n_repeat_words"}
    return found.select("doc_id", *(F.col(f"folio_{c}").alias(n) for c, n in names.items()))


def op11_token_efficiency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of all documents: spans of the patterns, and random strings by characters a token."""
    found = secret_scan.find_secrets(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, keep_columns=["doc_id"])
    spans = F.col("folio_secrets")
    written = lambda some: F.array_join(F.transform(some, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter(spans, lambda s: s["kind"] != "random")
    return found.select("doc_id", *map(count, secret_scan.KINDS), F.sha2(written(base), 256).alias("base_sha256"), written(spans).alias("spans"))


def op12_late_overwrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sales as day folders, first without the late rows, then with them; the files of the final layout."""
    sales = table(spark, sf_dir, "sales")
    h, day = F.crc32(F.col("sale_id").cast("string")), late_overwrite.day_of(sales, "sold_at")
    later = lambda column, days: F.expr(f"timestampadd(DAY, cast({days} as int), {column})")
    copies = sales.withColumn("folio_h", h).where((F.col("folio_h") % 3 == 0) & (day % 10 == 0))
    copies = copies.withColumns({"total": F.col("total") + 1, "sold_at": later("sold_at", "folio_h % 2"), "arrived_at": later("arrived_at", "1 + folio_h % 97")}).select(sales.columns)
    rows = sales.unionByName(copies)
    early = F.coalesce(F.col("arrived_at") < F.lit("2024-03-01").cast("timestamp_ntz"), F.lit(False))
    root = f"{shared_dir(spark)}/sales-{uuid.uuid4().hex}"
    layout = late_overwrite.Layout(root, "sold_at", "sale_id", "arrived_at", 1 + sales.count() // 900)
    files = late_overwrite.write_layout(rows.where(early), layout)
    files = late_overwrite.overwrite_late(files, rows.where(~early), layout)
    return late_overwrite.layout_digest(files, layout, "total").select("day", "file_no", "n_rows", "cents", "rows_crc", "path", "columns", "ids_sha256", "rewritten")


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents cut and put together anew for filling in the middle."""
    made = fill_middle.fill_in_middle(table(spark, sf_dir, "documents"), keep_columns=["doc_id"])
    return made.select(
        "doc_id",
        F.col("folio_tokens").alias("n"),
        F.col("folio_form").alias("form"),
        F.col("folio_prefix_chars").alias("prefix_chars"),
        F.col("folio_middle_chars").alias("middle_chars"),
        F.sha2("folio_output", 256).alias("output_sha256"),
        F.sha2(fill_middle.restored(F.col("folio_form"), F.col("folio_output")), 256).alias("restored_sha256"),
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    own = [op1_chat_rotation, op2_token_counts, op3_decontaminate, op4_histogram_sort, op5_quality_qda, op6_ngram_jaccard, op7_line_dedup, op8_link_graph, op9_best_fit_packing, op10_weak_rules]
    own += [op11_token_efficiency, op12_late_overwrite, op13_fill_middle]
    return {f.__name__: f for f in [*own, rule_statistics]} | {"pipeline": corpus_pipeline.run}


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL by query; the others are tested against brute force in ``tests/llm``."""
    import corpus_pipeline

    out = {"op1_chat_rotation": _CHAT, "op3_decontaminate": _LEAKS, "op6_ngram_jaccard": _SHINGLES, "op7_line_dedup": _LINES, "op8_link_graph": _VERDICTS, "rule_statistics": _STATISTICS}
    return out | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})


_CHAT = """
WITH said AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS speaker, coalesce(text, '') AS text FROM conversations),
people AS (SELECT DISTINCT conv_id, speaker AS perspective FROM said WHERE speaker <> 'system'),
faced AS (
  SELECT said.*, perspective,
    CASE WHEN speaker = 'system' THEN 'system' WHEN speaker = perspective THEN 'assistant' ELSE 'user' END AS chat_role,
    CASE WHEN speaker <> 'system' AND speaker <> perspective THEN speaker END AS name
  FROM said JOIN people ON said.conv_id IS NOT DISTINCT FROM people.conv_id),
headed AS (SELECT *, '<|' || chat_role || coalesce(' name=' || name, '') || '|>' || chr(10) AS head FROM faced),
shaped AS (SELECT *, head || text || '<|end|>' || chr(10) AS rendered FROM headed),
placed AS (
  SELECT *, row_number() OVER w - 1 AS position, sum(length(rendered)) OVER w - length(rendered) AS char_start
  FROM shaped WINDOW w AS (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, speaker, text ROWS UNBOUNDED PRECEDING))
SELECT conv_id, perspective, position, speaker, chat_role, name, rendered, char_start::BIGINT AS char_start,
  CASE WHEN chat_role = 'assistant' THEN (char_start + length(head))::BIGINT ELSE -1 END AS train_start,
  CASE WHEN chat_role = 'assistant' THEN (char_start + length(rendered))::BIGINT ELSE -1 END AS train_end
FROM placed
"""

_LEAKS = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER.format("text")}, '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_LOWER.format("text")}, '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') AS w FROM benchmark),
items AS (SELECT DISTINCT item, least(len(w), 10) AS n, unnest([array_to_string(w[i:i + least(len(w), 10) - 1], ' ') FOR i IN range(1, greatest(len(w) - 10, 0) + 2)]) AS g FROM b WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM items),
wins AS (SELECT r, n, unnest(range(1, len(w) - n + 2)) AS i, unnest([array_to_string(w[k:k + n - 1], ' ') FOR k IN range(1, len(w) - n + 2)]) AS g FROM d, sizes WHERE len(w) >= n),
hits AS (SELECT r, i, wins.n, item FROM wins JOIN items ON wins.g = items.g AND wins.n = items.n),
covered AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hits) GROUP BY r),
named AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r)
SELECT doc_id, coalesce(len(w), 0)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (r) LEFT JOIN named USING (r)
"""

_SHINGLES = rf"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(regexp_extract_all({_LOWER.format("text")}, '[^ \t-\r]+'), []) AS w FROM documents),
sets AS (SELECT DISTINCT doc_id, unnest([array_to_string(w[i:i + 2], ' ') FOR i IN range(1, greatest(len(w) - 3, 0) + 2)]) AS g FROM d WHERE len(w) > 0),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sets a JOIN sets b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS MATERIALIZED (SELECT x, y FROM shared JOIN sizes s ON s.doc_id = x JOIN sizes t ON t.doc_id = y WHERE 100 * c >= 90 * (s.n + t.n - c)),
reach(a, b) AS (SELECT x, y FROM links UNION SELECT a, y FROM reach JOIN links ON b = x)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(d.doc_id, (SELECT min(b) FROM reach WHERE a = d.doc_id)) AS component_id,
  (SELECT count(*) FROM links WHERE x = d.doc_id)::BIGINT AS n_links
FROM d LEFT JOIN sizes USING (doc_id)
"""

# The distance of the oracle counts bytes, so letters of two bytes are mapped to one: all that the test tables hold.
_LETTERS = "ÉßçíÇÈÑèéÍäÜêÊÄñüöÖóÓúáàùâîôûÁÚ"[:26]
_BYTES = " || ".join(f"chr({k})" for k in [*range(1, 9), *range(14, 32)][: len(_LETTERS)])
_LINES = f"""
WITH RECURSIVE d AS (SELECT doc_id, text, string_split(text, chr(10)) AS a FROM documents),
l AS (SELECT doc_id, unnest(range(0, len(a)))::INT AS no, unnest(a) AS line FROM d WHERE text IS NOT NULL),
x AS MATERIALIZED (SELECT DISTINCT line, length(line) AS n, translate(line, '{_LETTERS}', {_BYTES}) AS s FROM l WHERE length(line) >= 20),
near AS MATERIALIZED (SELECT a.line AS u, b.line AS v FROM x a JOIN x b ON b.n = a.n AND a.line < b.line WHERE levenshtein(a.s, b.s) <= 2
  UNION ALL SELECT a.line, b.line FROM x a JOIN x b ON b.n = a.n + 1 WHERE levenshtein(a.s, b.s) <= 2 UNION ALL SELECT a.line, b.line FROM x a JOIN x b ON b.n = a.n + 2 WHERE levenshtein(a.s, b.s) <= 2),
both_ways AS MATERIALIZED (SELECT u, v FROM near UNION ALL SELECT v, u FROM near),
reach(u, v) AS (SELECT u, v FROM both_ways UNION SELECT r.u, b.v FROM reach r JOIN both_ways b ON r.v = b.u),
cls AS (SELECT x.line, least(x.line, min(v)) AS c FROM x LEFT JOIN reach ON u = x.line GROUP BY x.line),
placed AS (SELECT doc_id, no, row_number() OVER (PARTITION BY c ORDER BY doc_id, no) AS nth FROM l JOIN cls USING (line)),
gone AS (SELECT doc_id, list(no ORDER BY no) AS nos FROM placed WHERE nth > 1 GROUP BY doc_id)
SELECT doc_id, len(string_split(coalesce(text, ''), chr(10)))::BIGINT AS n_lines, coalesce(len(nos), 0)::BIGINT AS n_removed, coalesce(array_to_string(nos, ','), '') AS removed_lines,
  sha256(coalesce(CASE WHEN nos IS NULL THEN text ELSE array_to_string([a[i + 1] FOR i IN range(0, len(a)) IF NOT list_contains(nos, i::INT)], chr(10)) END, '')) AS kept_sha256
FROM d LEFT JOIN gone USING (doc_id)
"""

# Links of the test tables are relative, so no host has an edge and its ranks are its own shares; edges are tested against brute force.
_VERDICTS = r"""
WITH p AS (SELECT page_id, url, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, lower(regexp_extract(coalesce(rest, ''), '^[^/?#]*')) AS host, regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM p),
f AS (SELECT page_id, host, path, unnest(['net/', 'example.net/en/', 'example.com/de/', 'org/fr/']) AS rule, unnest(['block', 'allow', 'block', 'allow']) AS verdict FROM h),
m AS (SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict FROM f WHERE ('.' || host) LIKE ('%.' || split_part(rule, '/', 1)) AND starts_with(path, substr(rule, instr(rule, '/'))) GROUP BY page_id),
s AS (SELECT host, avg((verdict = 'block')::INT) AS distrust, avg((verdict = 'allow')::INT) AS trust FROM (SELECT host, coalesce(verdict, '') AS verdict FROM h LEFT JOIN m USING (page_id)) GROUP BY host)
SELECT h.page_id, h.host, path, rule, coalesce(verdict, CASE WHEN h.host <> '' AND distrust > 0.5 AND distrust > trust THEN 'block' ELSE 'allow' END) AS verdict
FROM h LEFT JOIN m USING (page_id) JOIN s ON s.host = h.host
"""

_STATISTICS = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, unnest([w[k] || ' ' || w[k + 1] || ' ' || w[k + 2] FOR k IN range(1, len(w) - 1)]) AS g FROM d WHERE len(w) >= 3),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g) WHERE n > 1),
c AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM r) GROUP BY doc_id),
l AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(l.n, 0)::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN l USING (doc_id)
"""
