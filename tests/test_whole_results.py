"""Queries and operators on small tables of a shape that the given ones lack: copies, piles, packages of several volumes."""

import io
import zipfile

import duckdb
import pandas as pd
from pyspark.sql import functions as F

from foliospark import catalog, session
from foliospark.operators import coverage, frames
from foliospark.sinks import packages
from foliospark.sources import packages as read


def query_over(spark, folder, name, **tables):
    for table, rows in tables.items():
        rows.write.parquet(f"{folder}/{table}.parquet")
    return catalog.queries()[name](spark, str(folder)).collect()


def test_source_references_keep_each_entry(spark, tmp_path):
    entries = spark.createDataFrame([(1, "https://a.example/x"), (2, "https://a.example/x"), (3, "/n/a b#c.md"), (4, None)], "id int, ref string")
    found = {r["id"]: r["url"] for r in coverage.source_references(entries).collect()}
    assert found == {1: "https://a.example/x", 2: "https://a.example/x", 3: "file:///n/a%20b%23c.md", 4: None}
    pages = spark.createDataFrame([(2, "https://a.example/x"), (4, "https://a.example/x")], "page_id long, url string")
    assert sorted(r["page_id"] for r in query_over(spark, tmp_path, "source_urls", pages=pages)) == [2, 4]


def test_paper_sections_count_by_length_as_in_the_sql(spark, tmp_path):
    rows = [(6, "A " * 300), (30, "A " * 300), (7, "x" * 50)]
    found = query_over(spark, tmp_path, "paper_gaps", documents=spark.createDataFrame(rows, "doc_id long, text string"))
    wanted = duckdb.sql(catalog.oracle_sql()["paper_gaps"].replace("FROM documents", f"FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")).fetchall()
    assert sorted(map(tuple, found)) == sorted(wanted)


def test_large_packages_have_volumes(spark, monkeypatch):
    rows = spark.range(40).selectExpr("concat('p', id % 2) AS package", "concat(id, '.md') AS name", "encode(repeat('x', cast(id as int)), 'UTF-8') AS content")
    whole = packages.archives(rows)
    assert [(r["path"], r["volume"]) for r in whole.orderBy("path").collect()] == [("p0.zip", 0), ("p1.zip", 0)]
    monkeypatch.setattr(packages, "VOLUME_ENTRIES", 6)
    made = packages.archives(rows)
    assert made.where("path = 'p0.zip'").count() > 1 and made.groupBy("path", "volume").count().where("count > 1").isEmpty()
    found = read.members(made).where(F.col("name") != packages.MANIFEST)
    assert sorted((r["path"], r["name"], r["size"]) for r in found.collect()) == sorted((f"p{k % 2}.zip", f"{k}.md", k) for k in range(40))


def test_packages_beyond_the_readers_entries_are_read_whole(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(packages, "VOLUME_ENTRIES", 10)
    docs = spark.range(200).selectExpr("id AS doc_id", "concat('text ', id) AS text")
    made = packages.archives(docs.selectExpr("'p' AS package", "concat(doc_id, '.md') AS name", "encode(text, 'UTF-8') AS content"))
    sizes = [len(zipfile.ZipFile(io.BytesIO(r["content"])).namelist()) for r in made.collect()]
    assert sum(sizes) == 200 + len(sizes) and max(sizes) < 40


def test_token_overlap_of_parts_with_equal_words(spark, tmp_path):
    rows = [(1, "Red blue", "B1"), (2, "blue red", "B2"), (3, "blue blue", None), (4, "green", "B3"), (5, None, "B4"), (6, "red x", "B1"), (6, "green", "B5")]
    found = query_over(spark, tmp_path, "token_overlap", part=spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string"))
    assert sorted(map(tuple, found)) == [(1, "b1", 2), (2, "b1", 2), (3, "b2", 1), (4, "b3", 2), (6, "b1", 3)]


def test_queries_keep_arrow_batches_small(spark, tmp_path):
    records, size = session.BATCHES
    before = {key: spark.conf.get(key) for key in (records, size)}
    try:
        spark.conf.set(records, "10000")
        spark.conf.set(size, "64m")
        text = "word " * 2000
        docs = spark.range(0, 1500, 1, 1).select(F.col("id").alias("doc_id"), F.lit(text).alias("text"))
        query_over(spark, tmp_path, "masked_plain", documents=docs)
        seen = lambda batches: (pd.DataFrame({"rows": [len(b)], "size": [int(b["text"].str.len().sum())]}) for b in batches)
        met = docs.mapInPandas(seen, "rows int, size long").agg(F.max("rows"), F.max("size"), F.sum("rows")).first()
        assert met[0] <= session.BATCHES[records] and met[1] <= session.BATCHES[size] + len(text) and met[2] == 1500
        spark.conf.set(records, "7")
        session.bounded_batches(spark)
        assert spark.conf.get(records) == "7"
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def test_headings_meet_the_window_without_other_lines(spark):
    text = "# A\nx\n```\n# code\n```\n## B #\n\n| a |\n~~~\n### no\n~~~\n    # indented\nEnd\n---"
    found = frames.headings(spark.createDataFrame([("a", text), ("b", "no heading")], "path string, text string"))
    assert [tuple(r) for r in found.orderBy("line_no").collect()] == [("a", 1, 1, "A"), ("a", 6, 2, "B #")]
    assert "lead(" not in found._jdf.queryExecution().optimizedPlan().toString()
