"""Checks of failing sources and of near-duplicate names."""

from pyspark.sql import functions as F

from scorelake.operators import monitor as M


def test_failing_source_and_duplicates_fail(spark):
    at = F.lit("2024-02-01").cast("timestamp")
    norm = spark.createDataFrame([("a", 50.0, 0.9)], "model_name string, normalized_value double, confidence_score double").withColumn("scraped_at", at)
    aliases = spark.createDataFrame([("x", "a")], "alias string, canonical_name string")
    runs = spark.createDataFrame([("good", True), ("bad", True), ("bad", False)], "source string, success boolean").withColumns({"run_at": at, "duration": F.lit(1.0)})
    names = spark.createDataFrame([(f"model{'1' * k}",) for k in range(1, 6)], "model_name string")
    got = {r.test: (r.passed, r.actual) for r in M.run_checks(norm, aliases, at, runs=runs, names=names).collect()}
    assert len(got) == 12 and got["source_success_pct"] == (False, 50.0) and got["near_duplicate_names"] == (False, 10.0)
