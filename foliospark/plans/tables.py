"""Queries over ``orders``, ``lineitem``, ``part`` and ``events``: declared against found, state along an order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.functions import text as T
from foliospark.operators import coverage, state
from foliospark.plans.registry import query, table


@query("WITH d AS (SELECT o_orderkey, o_orderkey % 7 + 1 AS n FROM orders), f AS (SELECT l_orderkey AS o_orderkey, count(*) AS n FROM lineitem GROUP BY ALL) SELECT coalesce(d.o_orderkey, f.o_orderkey) AS o_orderkey, coalesce(d.n, 0) AS declared, coalesce(f.n, 0) AS found FROM d FULL JOIN f ON d.o_orderkey = f.o_orderkey WHERE coalesce(d.n, 0) <> coalesce(f.n, 0)")
def manifest_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders whose declared number of lines (made from the key) is not the number found."""
    declared = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 7 + 1).alias("n"))
    found = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    return coverage.declared_and_found(declared, found, "o_orderkey")


@query("WITH a AS (SELECT o_orderkey AS k, sha256(CAST(o_orderkey % 11 AS VARCHAR)) AS d FROM orders WHERE o_orderkey % 5 <> 0), b AS (SELECT o_orderkey AS k, sha256(CAST(CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 13 ELSE o_orderkey % 11 END AS VARCHAR)) AS d FROM orders WHERE o_orderkey % 4 <> 0) SELECT coalesce(a.k, b.k) AS path, CASE WHEN a.k IS NULL THEN 'added' WHEN b.k IS NULL THEN 'stale' WHEN a.d <> b.d THEN 'changed' ELSE 'unchanged' END AS state FROM a FULL JOIN b ON a.k = b.k")
def tree_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two versions of a tree, projected from the orders."""
    key = F.col("o_orderkey")
    orders = table(spark, sf_dir, "orders").select("o_orderkey")
    old = orders.where(key % 5 != 0).select(key.alias("path"), F.sha2((key % 11).cast("string"), 256).alias("sha256"))
    new = orders.where(key % 4 != 0).select(key.alias("path"), F.sha2(F.when(key % 3 == 0, key % 13).otherwise(key % 11).cast("string"), 256).alias("sha256"))
    return coverage.tree_diff(old, new)


@query("SELECT source, in_manifest, in_audit, in_note FROM (SELECT p_partkey AS source, p_partkey % 2 = 0 AS in_manifest, p_partkey % 3 = 0 AS in_audit, p_partkey IN (SELECT l_partkey FROM lineitem) AS in_note FROM part) WHERE NOT (in_manifest AND in_audit AND in_note)")
def coverage_four_way(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as sources against three projected registers."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("source"))
    used = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("source"))
    return coverage.four_way(part, part.where("source % 2 = 0"), part.where("source % 3 = 0"), used)


@query("WITH e AS (SELECT user_id, event_id, event_type, CASE WHEN event_id % 3 = 0 THEN event_type END AS mark FROM events) SELECT user_id, event_id, coalesce(last_value(mark IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING), '') AS section FROM e")
def section_carry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last marked value carried along each user's events."""
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    out = state.carried(events, "user_id", "event_id", F.when(F.col("event_id") % 3 == 0, F.col("event_type")), "section")
    return out.select("user_id", "event_id", F.coalesce("section", F.lit("")).alias("section"))


@query("WITH r AS (SELECT l_orderkey, l_partkey, l_linenumber AS pos, l_quantity < 10 AS weaker FROM lineitem), b AS (SELECT l_orderkey % 50 AS k, l_partkey % 40 AS p, min(struct_pack(w := weaker::INT, o := l_orderkey, x := pos)) AS m, min(l_orderkey * 10 + pos) AS first_pos FROM r GROUP BY ALL) SELECT k, p, m.o * 10 + m.x AS place, m.w = 1 AS weaker, first_pos FROM b")
def keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per key the first row that is not weaker, at the earliest place."""
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 50).alias("k"), (F.col("l_partkey") % 40).alias("p"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("place"), (F.col("l_quantity") < 10).alias("weaker"))
    return coverage.keep_first(rows, ["k", "p"], "weaker", "place")


@query("WITH r AS (SELECT l_orderkey AS path, l_linenumber * 3 AS first, l_linenumber * 3 + l_quantity::INT % 9 AS last FROM lineitem), o AS (SELECT *, max(last) OVER (PARTITION BY path ORDER BY first, last DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM r) SELECT path, first, last FROM o WHERE reach IS NULL OR last > reach")
def outer_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges that no other of the same order holds."""
    line = table(spark, sf_dir, "lineitem")
    ranges = line.select(F.col("l_orderkey").alias("path"), (F.col("l_linenumber") * 3).alias("first"), (F.col("l_linenumber") * 3 + F.col("l_quantity").cast("int") % 9).alias("last"))
    return state.outermost(ranges)


@query("WITH w AS (SELECT p_partkey, string_split(lower(p_name), ' ') AS t FROM part), s AS (SELECT DISTINCT lower(p_brand) AS brand, string_split(lower(p_name), ' ')[1] AS word FROM part) SELECT p_partkey, arg_min(brand, brand) AS brand, count(DISTINCT brand) AS brands FROM w JOIN s ON list_contains(t, word) GROUP BY ALL")
def token_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands whose leading words a part's name shares; brands are gathered once for each set of words, as many parts have the same."""
    part = table(spark, sf_dir, "part")
    split = F.split(F.lower("p_name"), " ")
    leads = part.select(F.lower("p_brand").alias("brand"), split[0].alias("word")).distinct()
    # A part's words: of all its rows, if a key has several.
    keyed = part.groupBy("p_partkey").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set(split)))).alias("words"))
    sets = keyed.select("words").distinct()
    found = sets.select("words", F.explode("words").alias("word")).join(leads, "word").select("words", "brand").distinct()
    told = found.groupBy("words").agg(F.min("brand").alias("brand"), F.count("brand").alias("brands"))
    return keyed.join(told, "words").select("p_partkey", "brand", "brands")


@query("SELECT p_partkey, CASE WHEN p_size * 1000 < 1024 THEN (p_size * 1000)::VARCHAR || ' B' ELSE printf('%.1f KiB', p_size * 1000 / 1024.0) END AS size FROM part")
def human_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes with units."""
    return table(spark, sf_dir, "part").select("p_partkey", T.human_size(F.col("p_size") * 1000).alias("size"))
