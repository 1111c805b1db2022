"""Rules that follow notes: restarts, replays, late events and equal contents end in the same tables as a full run."""

import shutil

from pyspark.sql import functions as F

from foliospark.operators import rules
from foliospark.streaming import versions


def rows_of(found, *columns):
    return sorted(tuple(r[c] for c in columns) for r in found.collect())


def waves():
    return [
        [("a", "TODO", 1), ("b", "fine", 1), ("c", "TODO", 1), (None, "TODO", 1), ("e", "", 1)],
        [("a", "fine", 2), ("b", "TBD\nx\nTODO", 3), ("b", "never", 2), ("c", None, 2), ("d", "TODO", 1)],
        [("a", "TODO", 1), ("b", "late", 2), ("c", "TODO", 3), ("d", "TODO", 1), ("e", "", 2), ("f", "TBD\nx\nTODO", 1)],
    ]


def full(spark):
    last = {}
    for path, text, seq in sum(waves(), []):
        if path is not None and (path not in last or seq > last[path][0]):
            last[path] = (seq, text)
    notes = spark.createDataFrame([(p, t) for p, (_, t) in last.items() if t is not None], "path string, text string")
    return rows_of(rules.residue(notes), "rule", "path", "line_no", "message")


def run(spark, root):
    events = spark.readStream.schema(versions.EVENTS).option("recursiveFileLookup", "true").parquet(f"{root}/in")
    versions.follow(events, f"{root}/out", f"{root}/ckpt", rules.residue).awaitTermination()


def put(spark, root, k):
    spark.createDataFrame(waves()[k], versions.EVENTS).coalesce(1).write.parquet(f"{root}/in/wave={k}")


def test_restarts_equal_a_full_run(spark, tmp_path):
    for k in range(3):
        put(spark, tmp_path, k)
        run(spark, tmp_path)
    issues = rows_of(versions.current_issues(spark, f"{tmp_path}/out"), "rule", "path", "line_no", "message")
    assert issues == full(spark) and len(issues) == 6
    assert rows_of(versions.current(spark, f"{tmp_path}/out"), "path", "seq") == [("a", 2), ("b", 3), ("c", 3), ("d", 1), ("e", 1), ("f", 1)]
    checked = rows_of(spark.read.parquet(f"{tmp_path}/out/checked"), "digest")
    assert len(checked) == len(set(checked)) == 4  # each content once, whatever note has it


def test_a_batch_that_runs_again_replaces_itself(spark, tmp_path):
    put(spark, tmp_path, 0)
    run(spark, tmp_path)
    put(spark, tmp_path, 1)
    run(spark, tmp_path)
    before = {name: rows_of(spark.read.parquet(f"{tmp_path}/out/{name}"), "batch", "digest") for name in ("checked", "issues")}
    shutil.rmtree(tmp_path / "ckpt" / "commits")  # as if the driver had died after its last batch and before its commit
    (tmp_path / "ckpt" / "commits").mkdir()
    run(spark, tmp_path)
    assert {name: rows_of(spark.read.parquet(f"{tmp_path}/out/{name}"), "batch", "digest") for name in ("checked", "issues")} == before
    put(spark, tmp_path, 2)
    run(spark, tmp_path)
    assert rows_of(versions.current_issues(spark, f"{tmp_path}/out"), "rule", "path", "line_no", "message") == full(spark)


def test_one_run_over_everything(spark, tmp_path):
    for k in range(3):
        put(spark, tmp_path, k)
    run(spark, tmp_path)
    assert rows_of(versions.current_issues(spark, f"{tmp_path}/out"), "rule", "path", "line_no", "message") == full(spark)
    assert versions.current_issues(spark, f"{tmp_path}/nothing").count() == 0
    assert spark.read.parquet(f"{tmp_path}/out/versions").where(F.col("path").isNull()).count() == 0
