"""Queries of dependencies between parts and of the checks that changes ask for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.operators import policies
from foliospark.plans.registry import query, table


@query("WITH RECURSIVE c(src, dst) AS (SELECT p_partkey, p_partkey // 3 FROM part WHERE p_partkey >= 3 UNION SELECT c.src, c.dst // 3 FROM c WHERE c.dst >= 3) SELECT src, dst FROM c")
def dependency_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everything that a part depends on when each depends on a third of its number."""
    part = table(spark, sf_dir, "part").where("p_partkey >= 3")
    return policies.closure(part.select(F.col("p_partkey").alias("src"), F.floor(F.col("p_partkey") / 3).alias("dst")))


@query("SELECT 'notes' AS check, count(*) AS paths FROM part WHERE p_partkey % 3 = 0 UNION ALL SELECT 'scripts', count(*) FROM part WHERE p_partkey % 5 = 0 UNION ALL SELECT 'all', count(*) FROM part")
def suggested_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checks that changed paths ask for."""
    folder = F.when(F.col("p_partkey") % 5 == 0, "scripts/").otherwise("C/")
    suffix = F.when(F.col("p_partkey") % 3 == 0, ".md").otherwise(".txt")
    changed = table(spark, sf_dir, "part").select(F.concat(folder, "p_partkey", suffix).alias("path"))
    scopes = spark.createDataFrame([("notes", r"\.md$"), ("scripts", "^scripts/"), ("all", "")], "check string, regex string")
    return policies.suggested_checks(changed, scopes)
