"""Cell checks of the split-address input template, and surrounding blanks, as table checks on raw books."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import date_from_text
from ..functions.lookups import legend_code
from ..functions.text import BLANKS, clean
from .partitioning import attach, group_value

# Pattern each kind of cell must match.
PATTERNS = {
    "pan": "^[A-Z]{5}[0-9]{4}[A-Z]$",
    "pin": "^[1-9][0-9]{5}$",
    "mobile": "^[6-9][0-9]{9}$",
    "std": "^0[0-9]{2,4}$",
    "landline": "^[0-9]{6,8}$",
    "amount": r"^[0-9]+(\.[0-9]+)?$",
}
# Kind of every template input.
KINDS = {
    "borrowerName": "text", "pan": "pan", "classOfActivity": "text", "borrowerAddressLine1": "text",
    "borrowerAddressLine2": "text", "borrowerAddressLine3": "text", "borrowerCity": "city", "borrowerDistrict": "text",
    "borrowerPin": "pin", "borrowerMobile": "mobile", "borrowerStdCode": "std", "borrowerLandline": "landline",
    "accountNumber": "account", "sanctionDate": "date", "sanctionedAmount": "amount", "drawingPower": "amount",
    "currentBalance": "amount", "amountOverdue": "amount", "wilfulDefaultDate": "date", "relatedName": "text",
    "relatedDob": "date", "relatedPan": "pan", "relatedAddressLine1": "text", "relatedAddressLine2": "text",
    "relatedAddressLine3": "text", "relatedCity": "city", "relatedDistrict": "text", "relatedPin": "pin",
    "relatedMobile": "mobile", "relatedStdCode": "std", "relatedLandline": "landline", "securityValue": "amount",
    "legalConstitution": "list", "businessCategory": "list", "businessIndustryType": "list", "locationType": "list",
    "repaymentFrequency": "list", "assetClassification": "list", "accountStatus": "list", "relationshipType": "list",
    "securityType": "list", "securityClass": "list",
}
LISTS = dict(legalConstitution="constitution", businessCategory="category", businessIndustryType="industry",
             locationType="location", repaymentFrequency="repayment", assetClassification="asset",
             accountStatus="account_status", relationshipType="relationship", securityType="security_type",
             securityClass="security_class")
# Inputs the template requires.
REQUIRED = ("borrowerName", "pan", "legalConstitution", "businessCategory", "businessIndustryType", "borrowerAddressLine1",
            "borrowerCity", "borrowerState", "borrowerPin", "accountNumber", "sanctionDate", "sanctionedAmount",
            "creditType", "repaymentFrequency", "currentBalance", "assetClassification", "accountStatus")


def cell_fails(key: str, kind: str, v: Column) -> Column:
    if kind in PATTERNS:
        return ~v.rlike(PATTERNS[kind])
    if kind == "date":
        d = date_from_text(v)
        return d.isNull() | ~d.between("1900-01-01", "2100-12-31")
    if kind == "city":
        return v.contains("|") | v.contains(",") | v.rlike(r"^\S+\s+\S+\s+\S+\s+\S")
    if kind == "list":
        return legend_code(LISTS[key], v).isNull()
    return v.contains("|")


def intake_checks(book: DataFrame) -> DataFrame:
    """(submission_id, row_no, field_key, check, value) of every cell the template would have refused."""
    found = []
    for key in dict.fromkeys([*REQUIRED, *KINDS]):
        if key not in book.columns:
            continue
        v = clean(F.col(key).cast("string"))

        def hit(check: str, failed: Column) -> Column:
            return F.when(failed, F.struct(F.lit(key).alias("field_key"), F.lit(check).alias("check"), v.alias("value")))

        if key in REQUIRED:
            found.append(hit("required", v.isNull()))
        if key in KINDS:
            found.append(hit(KINDS[key], cell_fails(key, KINDS[key], v)))
    rows = book.select("submission_id", "row_no", F.explode(F.array_compact(F.array(*found))).alias("c"))
    return rows.select("submission_id", "row_no", "c.field_key", "c.check", "c.value")


def repeated_accounts(book: DataFrame) -> DataFrame:
    """Every row whose account number another row of the submission also carries."""
    rows = book.select("submission_id", "row_no", clean(F.col("accountNumber").cast("string")).alias("value")).filter(
        "value is not null")
    keys = ("submission_id", "value")
    groups = group_value(rows, keys).filter("_n > 1")
    return attach(rows, groups, keys, ("row_no",)).select(
        "submission_id", "row_no", F.lit("accountNumber").alias("field_key"), F.lit("unique").alias("check"), "value")


def missing_columns(book: DataFrame) -> list[str]:
    """Required inputs the sheet has no column for (known from the schema alone)."""
    return [k for k in REQUIRED if k not in book.columns]


def surrounding_blanks(book: DataFrame, keys: tuple[str, ...] = ("borrowerName", "pan", "consumerName", "address")) -> DataFrame:
    """Cells with leading or trailing blanks, judged on the untrimmed source."""
    present = [k for k in keys if k in book.columns]
    found = [F.when(F.col(k) != F.btrim(F.col(k), F.lit(BLANKS)), F.struct(
        F.lit(k).alias("field_key"), F.col(k).alias("value"))) for k in present]
    rows = book.select("submission_id", "row_no", F.explode(F.array_compact(F.array(*found))).alias("c"))
    return rows.select("submission_id", "row_no", "c.field_key", "c.value")
