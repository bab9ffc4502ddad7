"""Which submissions may be written."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def issue_counts(issues: DataFrame) -> DataFrame:
    error = F.col("severity") == "error"
    return issues.groupBy("submission_id").agg(
        F.count_if(error).alias("errors"), F.count_if(~error).alias("warnings"),
        F.coalesce(F.bool_or(error & ~F.col("bypassable")), F.lit(False)).alias("has_non_bypassable"))


def gate(meta: DataFrame, issues: DataFrame, emit_with_errors: bool = False) -> DataFrame:
    """One row per submission: counts, ``ok`` and whether it passes.  Warnings never block; errors pass only
    with ``emit_with_errors`` and only while all of them are bypassable."""
    out = meta.select("submission_id").join(issue_counts(issues), "submission_id", "left").select(
        "submission_id", F.coalesce("errors", F.lit(0)).alias("errors"), F.coalesce("warnings", F.lit(0)).alias("warnings"),
        F.coalesce("has_non_bypassable", F.lit(False)).alias("has_non_bypassable"))
    ok = F.col("errors") == 0
    return out.withColumn("ok", ok).withColumn(
        "passes", ok | (F.lit(emit_with_errors) & ~F.col("has_non_bypassable")))


def run_outcome(gated: DataFrame, issues: DataFrame) -> DataFrame:
    """success / bypassed / errors per submission, with the number of rules that failed."""
    rules = issues.filter("severity = 'error'").groupBy("submission_id").agg(
        F.count_distinct("rule", "field_key", "sheet").alias("failed_rules"))
    return gated.join(rules, "submission_id", "left").select(
        "submission_id", "errors", "warnings", F.coalesce("failed_rules", F.lit(0)).alias("failed_rules"),
        F.when(F.col("ok"), "success").when(F.col("passes"), "bypassed").otherwise("errors").alias("outcome"))
