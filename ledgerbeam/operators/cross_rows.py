"""Rules over a borrower's segments and over a whole submission."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean
from ..specs.model import Format
from .citations import citation
from .partitioning import attach, cut, group_value
from .segments import ORDER, value
from .validate import ISSUE_COLUMNS


def tag_counts(segments: DataFrame) -> DataFrame:
    return segments.groupBy("submission_id", "ac_no", "tag").agg(F.count(F.lit(1)).alias("segments"))


def _issue_rows(rows: DataFrame, **cols: Column) -> DataFrame:
    base = {
        "severity": F.lit("error"), "column": F.lit(None).cast("string"), "field_label": F.lit(None).cast("string"),
        "field_key": F.lit(""), "value": F.lit(None).cast("string"), "bypassable": F.lit(True), "flag": F.lit(0),
        "spec_ord": F.lit(0), "seq": F.lit(0).cast("bigint"), "item": F.lit(0), "rule_ord": F.lit(0), "phase": F.lit(0),
    }
    base.update(cols)
    return rows.select(*[base[c].alias(c) if c in base else F.col(c) for c in ISSUE_COLUMNS])


def _borrowers(segments: DataFrame, fmt: Format) -> DataFrame:
    """One row per borrower with the counts the borrower rules need and its first segment.

    Envelopes that carry ``borrower_tags`` already hold each borrower on one row, so nothing is shuffled."""
    limited = [s for s in fmt.body if s.cardinality in ("one", "optional")]
    if "borrower_tags" in segments.columns:
        def size(tag: str) -> Column:
            return F.size(F.filter(F.col("borrower_tags"), lambda t: t == tag)).cast("bigint")
        return segments.filter(F.col("borrower_tags").isNotNull()).select(
            "submission_id", "ac_no", "first_ord", F.col("sheet").alias("first_sheet"), "row_no",
            *[size(s.tag).alias(f"n_{s.tag}") for s in limited],
            F.lit(True).alias("registered"), F.lit(None).cast("string").alias("locations"))
    first = F.struct(*ORDER)
    aggs = [F.min("first_ord").alias("first_ord"), F.min_by("sheet", first).alias("first_sheet"),
            F.min_by("row_no", first).alias("row_no"),
            *[F.count_if(F.col("tag") == s.tag).alias(f"n_{s.tag}") for s in limited]]
    office = F.lit(None).cast("string")
    if fmt.borrower_rules:
        office = F.when(F.col("tag") == "AS", F.coalesce(clean(value(fmt.segment("AS"), "officeLocationType")), F.lit("blank")))
    registered = F.coalesce(F.bool_or(office == "01"), F.lit(True))  # no address at all is not this rule's concern
    # Distinct location codes only: the list stays short however many addresses a borrower has.
    locations = F.array_join(F.sort_array(F.collect_set(office)), ", ")
    return segments.groupBy("submission_id", "ac_no").agg(*aggs, registered.alias("registered"), locations.alias("locations"))


def borrower_issues(segments: DataFrame, fmt: Format) -> DataFrame:
    """Cardinality and registered-office findings."""
    b = _borrowers(segments, fmt)
    words = {"one": "one-per-borrower", "optional": "optional-per-borrower"}
    checks = []
    for ord_, s in enumerate(fmt.body):
        if s.cardinality not in words:
            continue
        n = F.col(f"n_{s.tag}")
        checks.append(F.when(n != 1 if s.cardinality == "one" else n > 1, F.struct(
            F.lit(s.sheet or s.tag).alias("sheet"), F.lit(s.tag).alias("field_key"), F.lit("cardinality").alias("rule"),
            F.concat(F.lit(f"Segment {s.tag} stands "), n.cast("string"), F.lit(" times under borrower "), F.col("ac_no"),
                     F.lit(f"; allowed: {words[s.cardinality]}")).alias("message"),
            F.lit(citation(fmt, s, None, "cardinality")).alias("reference"), n.cast("string").alias("value"),
            F.lit(s.tag).alias("tag"), F.lit(1).alias("stage"), F.lit(ord_).alias("item"))))
    if fmt.borrower_rules:
        checks.append(F.when(~F.col("registered"), F.struct(
            F.col("first_sheet").alias("sheet"), F.lit("").alias("field_key"), F.lit("portal-mandatory").alias("rule"),
            F.concat(F.lit("The borrower has no address of Location Type 01 (registered office); types given: ["),
                     F.col("locations"), F.lit("].")).alias("message"),
            F.lit(citation(fmt, None, None, "portal-mandatory", "registered office")).alias("reference"),
            F.lit(None).cast("string").alias("value"), F.lit("AS").alias("tag"), F.lit(2).alias("stage"),
            F.lit(0).alias("item"))))
    rows = b.select("submission_id", "ac_no", F.col("row_no").alias("row_number"), "first_ord",
                    F.explode(F.array_compact(F.array(*checks))).alias("i"))
    names = ("sheet", "field_key", "rule", "message", "reference", "value", "tag", "stage", "item")
    return _issue_rows(rows, **{n: F.col(f"i.{n}") for n in names})


def duplicate_accounts(segments: DataFrame, fmt: Format, hot_rows: int | None = None) -> DataFrame:
    """Second and later facilities carrying an account number already filed in the submission.

    Columns: submission_id, ac_no, row_no, sheet, account, first_row and the order columns.  Only accounts
    seen twice are joined back, salted when one of them covers very many rows."""
    cr = fmt.segment("CR")
    rows = segments.filter(F.col("tag") == "CR").select(
        "submission_id", "ac_no", "row_no", "sheet", *ORDER, clean(value(cr, "accountNumber")).alias("account")
    ).filter("account is not null")
    rows = cut(rows, "accounts")  # read three times below; a few narrow columns
    place = F.struct(*ORDER)
    keys = ("submission_id", "account")
    firsts = group_value(rows, keys, F.min(place).alias("first_place"), F.min_by("row_no", place).alias("first_row"))
    more = {"hot_rows": hot_rows} if hot_rows else {}
    joined = attach(rows, firsts.filter("_n > 1"), keys, ORDER, **more)
    return joined.filter(place > F.col("first_place")).drop("first_place")


def duplicate_issues(segments: DataFrame, fmt: Format) -> DataFrame:
    rows = duplicate_accounts(segments, fmt)
    return _issue_rows(
        rows.withColumnRenamed("row_no", "row_number"), field_key=F.lit("accountNumber"), rule=F.lit("duplicate"),
        tag=F.lit("CR"), phase=F.lit(1), stage=F.lit(0), value=F.col("account"),
        flag=F.col("flag"), spec_ord=F.col("spec_ord"), seq=F.col("seq"),
        reference=F.lit(citation(fmt, fmt.segment("CR"), None, "duplicate")),
        message=F.concat(F.lit("Row "), F.col("row_number").cast("string"), F.lit(" repeats account "), F.col("account"),
                         F.lit(" of row "), F.col("first_row").cast("string"), F.lit(".")))


def empty_issues(meta: DataFrame, segments: DataFrame, fmt: Format) -> DataFrame:
    """Submissions from which nothing was read: one blocking finding each."""
    filled = segments.groupBy("submission_id").agg(F.lit(1).alias("_filled")).select("submission_id")
    rows = meta.select("submission_id").join(filled, "submission_id", "left_anti")
    return _issue_rows(
        rows, sheet=F.lit(""), ac_no=F.lit(""), row_number=F.lit(0).cast("bigint"), rule=F.lit("empty-input"),
        message=F.lit("No records found in the input; check the sheet and its column headers."),
        reference=F.lit(f"{fmt.label} v{fmt.version} input workbook layout"), tag=F.lit(""), stage=F.lit(0),
        first_ord=F.lit(0).cast("bigint"))


def whole_file_issues(rows: DataFrame, fmt: Format, message: Column, severity: str = "error", bypassable: bool = False) -> DataFrame:
    """Findings of a reader about a file: ``rows`` holds submission_id and, where known, sheet and row_no."""
    return _issue_rows(
        rows, severity=F.lit(severity), bypassable=F.lit(bypassable), sheet=F.coalesce("sheet", F.lit("")), ac_no=F.lit(""),
        row_number=F.coalesce(F.col("row_no").cast("bigint"), F.lit(0).cast("bigint")), rule=F.lit("parse"), message=message,
        reference=F.lit(f"{fmt.label} v{fmt.version} input workbook layout"), tag=F.lit(""), stage=F.lit(0),
        first_ord=F.lit(0).cast("bigint"))
