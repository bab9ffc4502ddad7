"""Per-segment report tables, the record listing and the issue export."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import ellipsis
from ..operators.assemble import RECORD_ORDER
from ..operators.partitioning import attach, group_value, numbered
from ..operators.rollup import issue_listing
from ..operators.segments import ORDER
from ..specs.model import Format


def borrower_index(segments: DataFrame) -> DataFrame:
    """(submission_id, ac_no, ac_index): dense 1-based borrower number in first-seen order."""
    firsts = segments.groupBy("submission_id", "ac_no").agg(F.min("first_ord").alias("first_ord"))
    return numbered(firsts, ("first_ord", "ac_no"), "ac_index").select("submission_id", "ac_no", "ac_index")


def with_index(segments: DataFrame) -> DataFrame:
    index = borrower_index(segments)
    counts = group_value(segments, ("submission_id", "ac_no"))
    return attach(segments, index.join(counts, ["submission_id", "ac_no"]), ("submission_id", "ac_no"), ORDER)


def report_tables(segments: DataFrame, fmt: Format) -> dict[str, DataFrame]:
    """One table per body segment: account index, flag, tag, every formatted field, the record."""
    indexed = with_index(segments)
    out = {}
    for s in fmt.body:
        out[s.tag] = indexed.filter(F.col("tag") == s.tag).select(
            "submission_id", F.col("ac_index").alias("A/c No."), F.col("flag").alias("Flag"), F.col("tag").alias("Segment Identifier"),
            *[F.get("values", F.lit(i)).alias(f.key) for i, f in enumerate(s.fields) if f.key != "_tag"],
            F.col("record").alias("Final Formula"), *ORDER)
    return out


def sorting_table(records: DataFrame) -> DataFrame:
    """All records in upload order with their 1-based position."""
    return numbered(records, RECORD_ORDER, "n").select("submission_id", "n", "ac_no", "flag", "tag", "record")


def preview(records: DataFrame, lines: int = 5, width: int = 160) -> DataFrame:
    """First lines of each submission, shortened.  Spark keeps only the first rows per submission of every
    partition before the shuffle (window group limit), so no submission is collected whole."""
    place = Window.partitionBy("submission_id").orderBy(*RECORD_ORDER)
    top = records.filter("record <> ''").withColumn("line_no", F.row_number().over(place)).filter(F.col("line_no") <= lines)
    return top.select("submission_id", "line_no", ellipsis(F.col("record"), width).alias("line"))


def write_report(segments: DataFrame, records: DataFrame, fmt: Format, path: str) -> None:
    for tag, table in report_tables(segments, fmt).items():
        safe = table.toDF(*[c.replace("/", "_").replace(".", "").replace(" ", "_") for c in table.columns])
        safe.write.mode("overwrite").parquet(f"{path}/{tag}")
    sorting_table(records).write.mode("overwrite").parquet(f"{path}/sorting")


def write_issues(issues: DataFrame, path: str) -> None:
    issue_listing(issues).write.mode("overwrite").option("header", True).csv(path)
