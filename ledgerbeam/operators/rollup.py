"""Issue listings and findings rollups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .partitioning import numbered
from .validate import ISSUE_ORDER

TITLE_MAX = 80

# Rule headline and advice.  {label} stands for the field's label.
RULE_TEXT = {
    "enum": ("{label} holds a code outside the catalogue", "Use one of the published codes for {label}."),
    "lookup": ("{label} could not be matched to a code", "Use the catalogue spelling or give the code itself."),
    "format": ("{label} format looks wrong", "Correct {label}, or clear it where it is optional."),
    "date": ("{label} is not a valid date", "Write dates as DD/MM/YYYY."),
    "length": ("{label} is longer than accepted", "Shorten the value; the excess would be cut."),
    "parse": ("{label} could not be read from the sheet", "Correct the source cell; its value would be lost."),
    "mandatory": ("{label} is required but blank", "Fill {label} on every row listed."),
    "cardinality": ("{label} breaks the required record count", "Add the missing record or remove the extra one."),
    "portal-mandatory": ("{label} breaks a rule checked at upload", "Fix it before filing; the upload is refused otherwise."),
    "empty-input": ("No records were read from the input", "Check the file, the sheet and the column headers."),
    "duplicate": ("{label} is repeated across rows", "Correct the number, or delete the repeated row."),
}


def rule_text(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(r, t, a) for r, (t, a) in RULE_TEXT.items()], "rule string, title string, advice string")


def _worded(label: Column, which: int) -> Column:
    out = F.lit("")
    for rule, texts in reversed(RULE_TEXT.items()):
        head, _, tail = texts[which].partition("{label}")
        text = F.concat(F.lit(head), label, F.lit(tail)) if "{label}" in texts[which] else F.lit(head)
        out = F.when(F.col("rule") == rule, text).otherwise(out)
    return out


def place() -> Column:
    return F.struct(*ISSUE_ORDER)


def issue_listing(issues: DataFrame) -> DataFrame:
    """Errors before warnings, original order inside, numbered from 1 per submission, with the A1 cell."""
    ranked = issues.withColumn("severity_rank", F.when(F.col("severity") == "error", 0).otherwise(1))
    out = numbered(ranked, ("severity_rank", *ISSUE_ORDER, "tag", "field_key", "message"), "n")
    cell = F.when(F.col("column").isNotNull() & (F.col("row_number") > 0), F.concat("column", F.col("row_number").cast("string")))
    return out.select("submission_id", "n", "severity", "sheet", F.when(F.col("row_number") > 0, F.col("row_number")).alias("row"),
                      "column", F.coalesce(cell, F.lit("")).alias("cell"),
                      F.coalesce("field_label", "field_key").alias("field"), "message", F.coalesce("reference", F.lit("")).alias("reference"))


def findings_rollup(issues: DataFrame) -> DataFrame:
    """One row per (rule, field, sheet) of a submission; the affected cells stay in the issue table, joined on
    those keys when they are wanted, so that a rule hit by every row never becomes one huge value."""
    first = F.min_by("severity", place())
    same = F.min("message") == F.max("message")
    g = issues.groupBy("submission_id", "rule", "field_key", "sheet").agg(
        first.alias("severity"), F.count(F.lit(1)).alias("cells"), F.when(same, F.min("message")).alias("shared"),
        F.bool_and("bypassable").alias("bypassable"), F.min_by("reference", place()).alias("reference"),
        F.min_by(F.coalesce(F.col("field_label"), F.nullif(F.col("field_key"), F.lit("")), F.col("sheet")), place()).alias("label"))
    short = F.length("shared") <= TITLE_MAX
    where = F.array_join(F.array_compact(F.array(
        F.nullif("sheet", F.lit("")), F.nullif("field_key", F.lit("")), F.nullif("rule", F.lit("")),
        F.when(~F.col("bypassable"), "not bypassable"))), " · ")
    fix = F.array_join(F.array_compact(F.array(
        F.when(~short, F.col("shared")), _worded(F.col("label"), 1),
        F.when(~F.col("bypassable"), "It cannot be bypassed."))), " ")
    return g.select("submission_id", "rule", "field_key", "sheet", "severity", "cells", "bypassable", "reference",
                    F.when(short, F.col("shared")).otherwise(_worded(F.col("label"), 0)).alias("title"),
                    where.alias("where"), fix.alias("fix"))


def rollup_order() -> list[Column]:
    """Errors first, then the most frequent."""
    return [F.when(F.col("severity") == "error", 0).otherwise(1).asc(), F.col("cells").desc()]


def issues_by_sheet(issues: DataFrame) -> DataFrame:
    return issues.groupBy("submission_id", "sheet").agg(
        F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") != "error").alias("warnings"))
