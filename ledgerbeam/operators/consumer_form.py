"""Consumer form: one row to the seven segments of the tag-length-value stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.amounts import number_in, plain_number
from ..functions.dates import day_text, typed_date_text
from ..functions.text import clean, trimmed, words
from ..specs import consumer as C
from .partitioning import by_submission, small_enough
from .segments import input_text, note, notes, segment, some_present, spread

#: Characters of an address line.
LINE = 40


def explode_form(form: DataFrame, meta: DataFrame, keep_empty_email: bool = False) -> DataFrame:
    """Form rows to segment envelopes.  The member id and short name of the run parameters are stamped on the
    account record; a short name typed in the sheet's header reaches only the header record.

    Dates and amounts are coerced as in every typed field, and the third address slice fills the third line."""
    fmt = C.TUDF
    keys = [k for k in C.FORM_LETTERS.values() if k in form.columns]
    typed = {f.name: f.dataType for f in form.schema.fields}
    amounts = ("highCredit", "currentBalance", "amountOverdue", "rateOfInterest")
    # The cells, then what is read from them, then the segments: each a projection with a function over arrays in it, which Spark
    # compiles as many small methods.  One of plain expressions alone would become a single method, too large for the JVM to compile.
    written = {k for k in C.FORM_DATES if k in keys and isinstance(typed[k], T.StringType)}
    cells = [(trimmed(F.col(k)) if k in written else F.col(k) if k in C.FORM_DATES else input_text(form, k)).alias(k) for k in keys if k != "consumerName"]
    if "consumerName" in keys:
        cells.append(words(F.col("consumerName") if isinstance(typed["consumerName"], T.StringType) else input_text(form, "consumerName")).alias("_name"))
    rows = form.filter(some_present(keys)).select("submission_id", F.col("row_no").cast("bigint").alias("row_no"), *cells)
    read = {}
    for k in keys:
        if k in C.FORM_DATES:
            read[k] = day_text(F.col(k)) if k in written else typed_date_text(F.col(k), typed[k])
        elif k in amounts:
            read[f"_{k}"] = number_in(F.col(k))
    rows = rows.withColumns(read)
    who = meta.select("submission_id", clean(F.col("member_id")).alias("_member"),
                      clean(F.col("member_short_name")).alias("_short"))
    rows = by_submission(rows, who, small_enough(meta.select("submission_id")), ("row_no",), "left")

    def col(key: str) -> Column:
        if key not in rows.columns:
            return F.lit(None).cast("string")
        return plain_number(F.col(key), F.col(f"_{key}")) if key in amounts else F.col(key)

    name = F.col("_name") if "_name" in rows.columns else F.array().cast("array<string>")
    first, second = F.get(name, F.lit(0)), F.get(name, F.lit(1))
    rest = F.when(F.size(name) > 2, F.array_join(F.filter(name, lambda _, i: i >= 2), " "))
    line1, line2, line3 = (trimmed(F.substring(col("address"), 1 + i * LINE, LINE)) for i in range(3))
    pn = segment(fmt, "PN", {"name": first, "name2": second, "name3": rest, "dateOfBirth": col("dateOfBirth"),
                             "gender": col("gender")})
    id_ = F.when(col("pan").isNotNull(), segment(fmt, "ID", {"idType": F.lit("01"), "idNumber": col("pan")}))
    pt = F.when(col("mobile").isNotNull(), segment(fmt, "PT", {"phoneNumber": col("mobile"), "phoneType": F.lit("01")}))
    ec = segment(fmt, "EC", {"email": col("email")})
    if not keep_empty_email:
        ec = F.when(col("email").isNotNull(), ec)
    pa = segment(fmt, "PA", {
        "addressLine1": line1, "addressLine2": line2, "city": line3, "stateCode": col("stateCode"),
        "pinCode": col("pinCode"), "addressCategory": F.coalesce(col("addressCategory"), F.lit("01")),
        "residenceCode": col("residenceCode")})
    tl = segment(fmt, "TL", {
        "memberId": F.coalesce(F.col("_member"), col("memberCode")),
        "memberShortName": F.coalesce(F.col("_short"), col("memberShortName")), "accountNumber": col("accountNumber"),
        "accountType": col("accountType"), "ownershipIndicator": F.coalesce(col("ownershipIndicator"), F.lit("1")),
        "dateOpened": col("dateOpened"), "dateLastPayment": col("dateLastPayment"), "dateReported": col("dateReported"),
        "highCreditAmount": col("highCredit"), "currentBalance": col("currentBalance"),
        "amountOverdue": F.when(col("amountOverdue") != "0", col("amountOverdue")), "suitFiledStatus": col("suitFiled"),
        "assetClassification": F.coalesce(col("assetClassification"), F.lit("01")),
        "rateOfInterest": col("rateOfInterest"), "repaymentTenure": col("repaymentTenure"),
    }, found=notes(
        note("suitFiled", F.when(col("suitFiled").isNull(), F.lit(
            'Suit Filed / Wilful Default (column AZ): a code must be given, 00 if there is no suit.'))),
        note("rateOfInterest", F.when(col("rateOfInterest").isNull(), F.lit(
            'Rate of Interest (column BG): the sanctioned rate must be given.')))))
    es = segment(fmt, "ES", {})
    return spread(rows, F.array(pn, id_, pt, ec, pa, tl, es))
