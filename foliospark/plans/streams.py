"""Queries that stream: rules that follow notes as they change."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.operators import rules
from foliospark.plans.registry import query, table
from foliospark.session import shared_folder
from foliospark.streaming import versions


@query("""WITH e AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN NULL WHEN doc_id % 3 = 0 THEN coalesce(text, '') || chr(10) || 'TODO ' || (doc_id % 2) WHEN doc_id % 5 = 0 THEN coalesce(text, '') ELSE coalesce(text, '') || chr(10) || 'FIXME' END AS text FROM documents),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1)::INT AS line_no FROM e WHERE text IS NOT NULL)
SELECT 'template_residue' AS rule, doc_id || '.md' AS path, line_no, regexp_extract(line, '相关知识链接|TODO|FIXME|TBD|待补|待完善') AS message FROM l WHERE regexp_matches(line, '相关知识链接|TODO|FIXME|TBD|待补|待完善')
UNION ALL SELECT 'empty_file', doc_id || '.md', 0, 'no content' FROM e WHERE text IS NOT NULL AND NOT regexp_matches(text, '[^\\s\\x0b\\x1c-\\x1f\\x85\\xa0]')""")  # fmt: skip
def followed_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues of all documents after three waves of events (all, changes, late and repeated ones), each worked off by a restart of the stream."""
    root = f"{shared_folder(spark)}/followed-{uuid.uuid4().hex}"
    key, text = F.col("doc_id"), F.coalesce("text", F.lit(""))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    marked = F.concat_ws("\n", text, F.concat(F.lit("TODO "), (key % 2).cast("string")))
    event = lambda rows, value, seq: rows.select(F.concat(key, F.lit(".md")).alias("path"), value.alias("text"), F.lit(seq).cast("long").alias("seq"))
    waves = [
        event(docs, F.concat_ws("\n", text, F.lit("FIXME")), 1),
        event(docs.where("doc_id % 3 = 0"), marked, 5).unionByName(event(docs.where("doc_id % 5 = 0 and doc_id % 3 <> 0"), text, 4)),
        event(docs.where("doc_id % 7 = 0"), F.lit(None).cast("string"), 6).unionByName(event(docs.where("doc_id % 3 = 0"), F.lit("late"), 2)).unionByName(event(docs.where("doc_id % 5 = 0 and doc_id % 3 <> 0 and doc_id % 7 <> 0"), text, 4)),
    ]
    for k, wave in enumerate(waves):
        wave.write.parquet(f"{root}/in/wave={k}")
        events = spark.readStream.schema(versions.EVENTS).option("recursiveFileLookup", "true").parquet(f"{root}/in")
        versions.follow(events, f"{root}/out", f"{root}/checkpoint", lambda notes: rules.all_of(rules.residue(notes), rules.empty_notes(notes))).awaitTermination()
    return versions.current_issues(spark, f"{root}/out")
