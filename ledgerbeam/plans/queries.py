"""Registered queries: every operator over the whole driver tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import addresses as A
from ..functions import dates as D
from ..functions import lookups as L
from ..functions import text as X
from ..functions.amounts import number_text, whole_rupees
from ..operators import assemble, cross_rows, encode, gate, guarantors, intake_checks, reconcile, rollup
from ..operators.consumer_form import explode_form
from ..operators.master_sheet import explode_book
from ..operators.partitioning import cut, numbered
from ..operators.rules import BORROWER, FILE, ROW, Rule
from ..operators.segments import ORDER, as_columns, flat_records, segment_sheet, stack_sheets, union_sheets, value
from ..sinks.reports import borrower_index, preview
from ..sources import sheets
from ..specs import commercial, consumer, microfinance
from ..specs.model import Format
from ..specs.registry import get_format
from . import sample_book as B
from .convert import all_issues, checked_segments, convert_batch

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
TEMPLATE = commercial.TEMPLATE_V310


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _segment_sheets(spark: SparkSession, sf: str) -> list[DataFrame]:
    """The three commercial segment sheets."""
    return [segment_sheet(B.borrower_sheet(spark, sf), TEMPLATE, "BS"), segment_sheet(B.address_sheet(spark, sf), TEMPLATE, "AS"),
            segment_sheet(B.facility_sheet(spark, sf), TEMPLATE, "CR")]


def _sheets(spark: SparkSession, sf: str) -> DataFrame:
    """The three commercial segment sheets as one envelope."""
    return union_sheets(*_segment_sheets(spark, sf))


def _mfi(spark: SparkSession, sf: str) -> DataFrame:
    fmt = microfinance.CDF
    m, a, c = B.mfi_sheets(spark, sf)
    return union_sheets(segment_sheet(m, fmt, "CNSCRD"), segment_sheet(a, fmt, "ADRCRD"), segment_sheet(c, fmt, "ACTCRD"))


def _flat(spark: SparkSession, sf: str) -> DataFrame:
    form = B.consumer_form(spark, sf).withColumnRenamed("address", "addressLine1")
    return flat_records(form.drop("email", "repaymentTenure", "dateLastPayment"), consumer.FLAT)


def _tudf(spark: SparkSession, sf: str) -> DataFrame:
    return explode_form(B.consumer_form(spark, sf), B.submissions(spark, sf))


def _issues_of(segments: DataFrame, fmt, spark: SparkSession, sf: str) -> DataFrame:
    """Issue table of an envelope; checked rows and issues are each written once, as in a conversion."""
    checked = cut(checked_segments(segments, fmt), "checked")
    return cut(all_issues(checked, B.submissions(spark, sf), fmt), "issues")


def _issues(spark: SparkSession, sf: str) -> DataFrame:
    return _issues_of(_sheets(spark, sf), TEMPLATE, spark, sf)


def _records(spark: SparkSession, sf: str) -> DataFrame:
    return convert_batch(_sheets(spark, sf), B.submissions(spark, sf), TEMPLATE, emit_with_errors=True).records


def _rule(df: DataFrame, rule: str) -> DataFrame:
    return df.filter(F.col("rule") == rule).select("submission_id", "tag", "ac_no", "row_number", "field_key", "severity", "value")


def _mapped(book: DataFrame, format_id: str = "commercial-ucrf-flat-v310") -> DataFrame:
    """Mapped Master-Sheet rows, written once: filters on top of the mapping would make the optimizer derive
    constraints from its large expressions."""
    return cut(explode_book(book, get_format(format_id)), "mapped")


# ---- whole conversions -------------------------------------------------------------------------------------


@query
def flagship_records(spark, sf):
    return _records(spark, sf).select("submission_id", "band", "ac_no", "flag", "tag", "record")


@query
def master_sheet_records(spark, sf):
    fmt = get_format("commercial-ucrf-flat-v310")
    seg = checked_segments(explode_book(B.master_book(spark, sf), fmt), fmt)
    return seg.select("submission_id", "row_no", "tag", "seq", "record", F.size("issues").alias("findings"))


@query
def master_sheet_v39_records(spark, sf):
    fmt = get_format("commercial-ucrf-flat")
    seg = _mapped(B.loans(spark, sf), fmt.id).filter("tag in ('CR', 'SS')")
    return seg.select("submission_id", "row_no", "tag", encode.encode_rows(fmt, F.col("values")).alias("record"))


@query
def tag_length_value_records(spark, sf):
    seg = _tudf(spark, sf)
    return seg.select("submission_id", "row_no", "tag", encode.encode_rows(consumer.TUDF, F.col("values")).alias("record"))


@query
def flat_consumer_records(spark, sf):
    done = convert_batch(_flat(spark, sf), B.submissions(spark, sf), consumer.FLAT, emit_with_errors=True)
    return done.records.select("submission_id", F.col("first_ord").alias("row_no"), "record")


@query
def microfinance_records(spark, sf):
    seg = _mfi(spark, sf)
    return seg.select("submission_id", "ac_no", "tag", "row_no", encode.encode_rows(microfinance.CDF, F.col("values")).alias("record"))


@query
def one_line_blocks(spark, sf):
    """One-line file text in blocks of 100 consecutive records; the blocks in order are the file's body."""
    seg = _mfi(spark, sf).withColumn("record", encode.encode_rows(microfinance.CDF, F.col("values")))
    rows = numbered(seg.select("submission_id", *ORDER, "record"), ORDER, "n")
    blocks = rows.groupBy("submission_id", F.expr("(n - 1) div 100").alias("block")).agg(
        F.array_sort(F.collect_list(F.struct("n", "record"))).alias("r"))
    return blocks.select("submission_id", "block", F.array_join(F.transform("r", lambda x: x["record"]), "").alias("text"))


# ---- counts, order, gate -----------------------------------------------------------------------------------


@query
def file_counts(spark, sf):
    return assemble.file_counts(stack_sheets(*_segment_sheets(spark, sf)), TEMPLATE)


@query
def borrower_tag_counts(spark, sf):
    return cross_rows.tag_counts(stack_sheets(*_segment_sheets(spark, sf)))


@query
def borrower_order(spark, sf):
    seg = _sheets(spark, sf)
    return seg.select("submission_id", "ac_no", "tag", "row_no", F.expr("first_ord % (1L << 40)").alias("first_seen"))


@query
def borrower_positions(spark, sf):
    return borrower_index(_sheets(spark, sf))


@query
def upload_positions(spark, sf):
    """Position of every body record inside its submission."""
    seg = _sheets(spark, sf)
    return numbered(seg, ORDER, "n").select("submission_id", "ac_no", "tag", "row_no", "n")


@query
def header_trailer(spark, sf):
    meta, counts = B.submissions(spark, sf), assemble.file_counts(stack_sheets(*_segment_sheets(spark, sf)), TEMPLATE)
    fmt = get_format("commercial-ucrf-flat-v310")
    return assemble.header_records(meta, fmt).unionByName(assemble.trailer_records(meta, counts, fmt)).select(
        "submission_id", "band", "tag", "record")


@query
def fixed_width_headers(spark, sf):
    meta = B.submissions(spark, sf)
    out = None
    for name, fmt in (("mfi", microfinance.CDF), ("tudf", consumer.TUDF), ("flat", consumer.FLAT)):
        h = assemble.header_records(meta, fmt).select("submission_id", F.lit(name).alias("layout"), "record")
        out = h if out is None else out.unionByName(h)
    fees = B.loans(spark, sf).groupBy("submission_id").agg(F.count(F.lit(1)).alias("loans"))
    return out.join(fees, "submission_id")


@query
def submission_names(spark, sf):
    meta = B.submissions(spark, sf).join(B.loans(spark, sf).groupBy("submission_id").agg(
        F.max("row_no").alias("last_row")), "submission_id")
    return meta.select("submission_id", "last_row", assemble.submission_name(get_format("commercial-ucrf-flat-v310"), "101112").alias("file_name"),
                       assemble.submission_name(microfinance.CDF, "101112").alias("other_name"),
                       assemble.side_file_name("issues").alias("issues_name"))


@query
def gate_decisions(spark, sf):
    return gate.gate(B.submissions(spark, sf), _issues(spark, sf), emit_with_errors=True)


@query
def run_outcomes(spark, sf):
    issues = _issues(spark, sf)
    return gate.run_outcome(gate.gate(B.submissions(spark, sf), issues, emit_with_errors=True), issues)


@query
def record_preview(spark, sf):
    return preview(_records(spark, sf), 5, 40)


# ---- validation --------------------------------------------------------------------------------------------


@query
def mandatory_blank(spark, sf):
    return _rule(_issues(spark, sf), "mandatory")


@query
def enum_violations(spark, sf):
    fmt = microfinance.CDF
    out = _rule(_issues(spark, sf), "enum")
    return out.unionByName(_rule(_issues_of(_mfi(spark, sf), fmt, spark, sf), "enum"))


@query
def date_violations(spark, sf):
    return _rule(_issues(spark, sf), "date")


@query
def identifier_formats(spark, sf):
    issues = _issues(spark, sf).filter("rule = 'format' and bypassable")
    return issues.select("submission_id", "tag", "ac_no", "row_number", "field_key", "value")


@query
def separator_in_values(spark, sf):
    issues = _issues(spark, sf).filter("rule = 'format' and not bypassable")
    return issues.select("submission_id", "tag", "ac_no", "row_number", "field_key", "value", "message")


@query
def conditional_mandatory(spark, sf):
    fmt = microfinance.CDF
    issues = _issues_of(_mfi(spark, sf), fmt, spark, sf)
    return _rule(issues.filter("tag = 'ACTCRD'"), "mandatory")


@query
def length_violations(spark, sf):
    fmt = consumer.TUDF
    form = B.consumer_form(spark, sf).withColumn("accountNumber", F.concat("accountNumber", F.lit("-"), "consumerName", F.lit("-2026")))
    return _rule(_issues_of(explode_form(form, B.submissions(spark, sf)), fmt, spark, sf), "length")


@query
def blank_form_cells(spark, sf):
    fmt = consumer.TUDF
    return _rule(_issues_of(_tudf(spark, sf), fmt, spark, sf), "lookup").drop("value")


@query
def cardinality_violations(spark, sf):
    fmt = consumer.TUDF
    out = _rule(_issues(spark, sf), "cardinality")
    return out.unionByName(_rule(_issues_of(_tudf(spark, sf), fmt, spark, sf), "cardinality"))


@query
def registered_office_missing(spark, sf):
    return _issues(spark, sf).filter("rule = 'portal-mandatory' and tag = 'AS'").select("submission_id", "ac_no", "row_number", "message")


@query
def wilful_date_missing(spark, sf):
    return _issues(spark, sf).filter("rule = 'portal-mandatory' and tag = 'CR'").select("submission_id", "ac_no", "row_number")


@query
def duplicate_accounts(spark, sf):
    return cross_rows.duplicate_accounts(_sheets(spark, sf), TEMPLATE).select("submission_id", "ac_no", "row_no", "account", "first_row")


#: Rules that a lender might add: one on a row, one across a borrower's segments, one on rows that share a day, one on a whole file.
OWN_RULES = (
    Rule("yen-account", ROW, {"CR": ("currencyCode", "accountNumber")}, lambda read: (read("CR.currencyCode") == "JPY") & F.startswith(read("CR.accountNumber"), F.lit("C")),
         lambda read: F.concat(F.lit("Account "), read("CR.accountNumber"), F.lit(" is in yen.")), field_key="accountNumber", severity="warning"),
    Rule("yen-without-phone", BORROWER, {"AS": ("mobileNumber",), "CR": ("currencyCode",)}, lambda read: (read("mobile") == "12") & (read("yen") > 0),
         lambda read: F.concat(F.lit("Phone "), read("mobile"), F.lit(" for "), read("yen").cast("string"), F.lit(" of "), read("loans").cast("string"), F.lit(" loans.")),
         totals={"mobile": lambda read: F.min(read("AS.mobileNumber")), "yen": lambda read: F.count_if(read("CR.currencyCode") == "JPY"), "loans": lambda read: F.count_if(read.rows("CR"))}),
    Rule("busy-day", FILE, {"CR": ("sanctionDate", "currencyCode")}, lambda read: (read("n") > 2) & (read("CR.currencyCode") == "JPY"),
         lambda read: F.concat(read("n").cast("string"), F.lit(" loans on one day.")), totals={"n": lambda read: F.count(F.lit(1))}, key=lambda read: read("CR.sanctionDate"),
         field_key="sanctionDate", bypassable=False),
    Rule("share-of-yen", FILE, {"CR": ("currencyCode",)}, lambda read: 100 * read("yen") > 11 * read("n"), lambda read: F.concat(read("yen").cast("string"), F.lit(" of "), read("n").cast("string")),
         totals={"yen": lambda read: F.count_if(read("CR.currencyCode") == "JPY"), "n": lambda read: F.count(F.lit(1))}),
)


def dated_defaults(fmt: Format) -> Format:
    """The layout with a condition of a lender's own: the date of a wilful default is mandatory where its status is 1."""
    cr = fmt.segment("CR").with_field("wilfulDefaultDate", required=True, when=lambda get: get("wilfulDefaultStatus") == "1")
    return replace(fmt, body=tuple(cr if s.tag == "CR" else s for s in fmt.body))


@query
def own_rules(spark, sf):
    """Findings of a lender's rules of each scope, and of a condition on a mandatory field, among those of a conversion."""
    done = convert_batch(_sheets(spark, sf), B.submissions(spark, sf), dated_defaults(TEMPLATE), emit_with_errors=True, own=OWN_RULES)
    wanted = done.issues.filter(F.col("rule").isin(*[r.name for r in OWN_RULES]) | ((F.col("rule") == "mandatory") & (F.col("field_key") == "wilfulDefaultDate")))
    return wanted.select("submission_id", "tag", "ac_no", "row_number", "field_key", "rule", "severity", "value", "bypassable", F.when(F.col("rule") != "mandatory", F.col("message")).alias("message"))


@query
def issue_listing(spark, sf):
    listing = rollup.issue_listing(_issues(spark, sf))
    return listing.select("submission_id", "n", "severity", "sheet", "row", "field", "message")


@query
def findings_rollup(spark, sf):
    r = rollup.findings_rollup(_issues(spark, sf))
    return r.select("submission_id", "rule", "field_key", "sheet", "severity", "cells", "bypassable", "where")


@query
def issues_by_sheet(spark, sf):
    return rollup.issues_by_sheet(_issues(spark, sf))


@query
def rule_citations(spark, sf):
    return _issues(spark, sf).groupBy("tag", "field_key", "rule", "reference").agg(F.count(F.lit(1)).alias("issues"))


@query
def intake_cell_checks(spark, sf):
    book = B.loans(spark, sf).withColumn("borrowerAddressLine1", F.col("address")).withColumn("borrowerMobile", F.col("contactNo"))
    return intake_checks.intake_checks(book.select(
        "submission_id", "row_no", "borrowerName", "pan", "legalConstitution", "borrowerMobile", "sanctionDate", "sanctionedAmount",
        "assetClassification"))


@query
def repeated_accounts(spark, sf):
    return intake_checks.repeated_accounts(B.loans(spark, sf)).select("submission_id", "row_no", "value")


@query
def surrounding_blanks(spark, sf):
    docs = B.table(spark, sf, "documents").selectExpr("source as submission_id", "doc_id as row_no", "concat(text, ' ') as borrowerName",
                                                      "text as address")
    return intake_checks.surrounding_blanks(docs).select("row_no", "field_key", F.length("value").alias("length"))


# ---- scalar functions --------------------------------------------------------------------------------------


@query
def separator_in_text(spark, sf):
    d = B.table(spark, sf, "documents")
    return d.filter(F.col("text").contains("|")).select("doc_id", F.length(F.regexp_replace("text", r"[^|]", "")).alias("separators"))


@query
def linebreak_fold(spark, sf):
    d = B.table(spark, sf, "documents")
    folded = X.fold_breaks(F.col("text"))
    return d.select("doc_id", F.md5(folded.cast("binary")).alias("folded_md5"), F.length(folded).alias("folded_length"))


@query
def header_normal_forms(spark, sf):
    d = B.table(spark, sf, "part")
    raw = F.expr("concat('  ', p_name, ' / ', upper(p_type), '\\t- “X” ')")
    return d.select("p_partkey", X.header_text(raw).alias("header"), X.label_text(raw).alias("label"), X.header_fold(raw).alias("fold"))


@query
def legend_lookup(spark, sf):
    b = B.loans(spark, sf)
    code = L.legend_code
    return b.select("row_no", code("constitution", F.col("legalConstitution")).alias("constitution"),
                    code("category", F.col("businessCategory")).alias("category"),
                    code("industry", F.col("businessIndustryType")).alias("industry"),
                    code("repayment", F.col("repaymentFrequency")).alias("repayment"),
                    code("asset", F.col("assetClassification")).alias("asset"),
                    code("account_status", F.col("accountStatus")).alias("status"),
                    code("location", F.col("locationType")).alias("location"),
                    code("relationship", F.col("relationshipType")).alias("relationship"))


@query
def credit_type_lookup(spark, sf):
    return B.loans(spark, sf).select("row_no", L.credit_type(F.col("creditType")).alias("credit_code"))


@query
def pan_holder_type(spark, sf):
    c = B.customers(spark, sf).withColumn("code", L.legend_code("constitution", F.col("legalConstitution")))
    letter, what = L.pan_holder(F.col("code"))
    bad = F.upper("pan").rlike("^[A-Z]{5}[0-9]{4}[A-Z]$") & (F.substring(F.upper("pan"), 4, 1) != letter)
    return c.filter(bad).select("k", letter.alias("expected"), what.alias("holder"))


@query
def gender_codes(spark, sf):
    c = B.customers(spark, sf).withColumn("code", L.gender_code(F.col("relatedGender")))
    return c.select("k", "code", L.gender_prefix(F.col("code"), True).alias("prefix"))


@query
def wilful_codes(spark, sf):
    return B.loans(spark, sf).select("row_no", L.wilful_code(F.col("wilfulDefault")).alias("code"))


@query
def state_from_text(spark, sf):
    return B.customers(spark, sf).select("k", A.state_in_text(F.col("address")).alias("state_code"))


@query
def state_fuzzy(spark, sf):
    s = B.customers(spark, sf).withColumn("a", A.split_address(F.col("address"))).filter("a.note is not null")
    return s.select("k", "a.state_code", "a.note")


@query
def pin_extract(spark, sf):
    return B.customers(spark, sf).select("k", X.last_pin(F.col("address")).alias("pin"))


@query
def pin_circle(spark, sf):
    e = B.table(spark, sf, "events").selectExpr("event_id", "lpad(cast(event_id * 7919 % 1000000 as string), 6, '0') as pin")
    return e.select("event_id", "pin", A.state_from_pin(F.col("pin")).alias("state_code"))


@query
def pin_state_conflict(spark, sf):
    e = B.customers(spark, sf).withColumn("pin", F.expr("lpad(cast(100000 + k * 577 % 750000 as string), 6, '0')"))
    e = e.withColumn("state", F.expr("lpad(cast(k % 38 as string), 2, '0')"))
    r = e.withColumn("r", A.resolve_address(line1=F.lit("Plot"), state=F.col("state"), pin=F.col("pin")))
    return r.filter(F.exists("r.notes", lambda n: n.startswith("PIN "))).select("k", "pin", "state")


@query
def named_states(spark, sf):
    typed = F.expr("element_at(array('Gujarat', 'delhi', '7', '36', 'Narnia', 'NA', 'gujrat', '77'), cast(k % 8 + 1 as int))")
    return B.customers(spark, sf).select("k", A.named_state(typed).alias("state_code"))


@query
def address_split(spark, sf):
    a = B.customers(spark, sf).withColumn("a", A.split_address(F.col("address")))
    return a.select("k", "a.line1", "a.city", "a.state_code", "a.pin")


@query
def city_sanity(spark, sf):
    typed = F.expr("element_at(array('Gujarat', 'Hyderebad', 'Hitech City Madhapur Hyderabad', 'Pune', 'Sector 5', 'Nagpurr', 'Kotta'), cast(k % 7 + 1 as int))")
    c = B.customers(spark, sf).select("k", F.explode(A.city_notes(typed)).alias("note"))
    return c


@query
def phone_quality(spark, sf):
    c = B.customers(spark, sf).select("k", A.phone_note(F.lit("Borrower"), F.col("contactNo")).alias("note"))
    return c.filter("note is not null")


@query
def date_parse(spark, sf):
    b = B.loans(spark, sf)
    return b.select("row_no", D.sheet_date_text(F.col("sanctionDate")).alias("ddmmyyyy"))


@query
def serial_date(spark, sf):
    e = B.table(spark, sf, "events").selectExpr("event_id", """case when event_id % 3 = 0 then cast(20000 + event_id % 40000 as double)
        when event_id % 3 = 1 then cast((1 + event_id % 31) * 1000000 + (1 + event_id % 12) * 10000 + 2000 + event_id % 30 as double)
        else cast(30000 + event_id % 1000 + 0.75 as double) end as n""")
    return e.select("event_id", D.ddmmyyyy(D.date_from_number(F.col("n"))).alias("ddmmyyyy"))


@query
def cycle_codes(spark, sf):
    o = B.table(spark, sf, "orders").withColumn("d", F.to_date("o_orderdate"))
    code = D.cycle_code(F.col("d"))
    return o.select("o_orderkey", code.alias("cycle"), D.cycle_date(F.year("d"), F.month("d"), code).cast("string").alias("cycle_day"))


@query
def date_forms(spark, sf):
    o = B.table(spark, sf, "orders").select("o_orderkey", F.date_format("o_orderdate", "d/M/yyyy").alias("t"))
    return o.select("o_orderkey", D.dmy_to_ddmmyyyy(F.col("t")).alias("plain"), D.dmy_to_iso(F.col("t")).alias("iso"),
                    D.iso_to_dmy(D.dmy_to_iso(F.col("t"))).alias("back"))


@query
def rupee_round(spark, sf):
    raw = F.expr("case when o_orderkey % 9 = 0 then '-' when o_orderkey % 9 = 1 then 'abc' else format_number(o_totalprice - 250000, 2) end")
    o = B.table(spark, sf, "orders")
    return o.select("o_orderkey", whole_rupees(raw).alias("rupees"))


@query
def number_texts(spark, sf):
    o = B.table(spark, sf, "orders")
    raw = F.expr("case when o_orderkey % 3 = 0 then concat('00', o_orderkey) when o_orderkey % 3 = 1 then concat(o_orderkey, '.2500') else concat(o_orderkey, ' kg') end")
    return o.select("o_orderkey", number_text(raw).alias("text"))


@query
def name_split(spark, sf):
    f = B.consumer_form(spark, sf).withColumn("n", X.name_parts(F.col("consumerName")))
    return f.select("row_no", "n.first", "n.second", "n.rest")


@query
def address_chunk(spark, sf):
    f = B.consumer_form(spark, sf).withColumn("c", X.address_chunks(F.col("address")))
    return f.select("row_no", *[F.get("c", F.lit(i)).alias(f"line{i + 1}") for i in range(3)])


@query
def printable_text(spark, sf):
    d = B.table(spark, sf, "documents")
    return d.select("doc_id", F.md5(X.printable(F.col("text")).cast("binary")).alias("shown"),
                    F.md5(X.ellipsis(X.unix_lines(F.col("text"))).cast("binary")).alias("brief"))


# ---- mapping -----------------------------------------------------------------------------------------------


@query
def dual_emission(spark, sf):
    fmt = get_format("commercial-ucrf-flat-v310")
    seg = _mapped(B.loans(spark, sf).drop("address")).filter("tag = 'AS'")
    return seg.select("row_no", "seq", value(fmt.segment("AS"), "officeLocationType").alias("location"))


@query
def facility_fields(spark, sf):
    fmt = get_format("commercial-ucrf-flat-v310")
    cr = as_columns(_mapped(B.loans(spark, sf)), fmt.segment("CR"))
    return cr.select("submission_id", "row_no", "accountNumber", "sanctionDate", "sanctionedAmount", "creditType", "repaymentFrequency",
                     "drawingPower", "currentBalance", "assetClassification", "amountOverdue", "accountStatus",
                     "wilfulDefaultStatus", "wilfulDefaultDate", "suitFiledStatus")


@query
def related_person_fields(spark, sf):
    fmt = get_format("commercial-ucrf-flat-v310")
    rs = as_columns(_mapped(B.dealt_customers(spark, sf).withColumnRenamed("k", "row_no")), fmt.segment("RS"))
    return rs.select("row_no", "relatedType", "relationship", "namePrefix", "fullName", "gender", "dateOfBirth", "rsPan", "rsAddressLine1")


@query
def guarantor_fields(spark, sf):
    fmt = get_format("commercial-ucrf-flat-v310")
    gs = as_columns(_mapped(B.master_book(spark, sf)), fmt.segment("GS"))
    return gs.select("row_no", "gsFullName", "gsRelatedType", "gsNamePrefix", "gsGender", "gsDateOfBirth", "gsPan", "gsAddressLine1")


@query
def same_person_conflict(spark, sf):
    seg = _mapped(B.master_book(spark, sf)).filter("tag = 'GS'")
    n = seg.select("row_no", "seq", F.explode("notes").alias("n")).filter(
        "n.field_key = 'relatedDob' or n.message like '%two addresses differ%'")
    return n.select("row_no", "seq", F.col("n.field_key").alias("field_key"))


@query
def guarantor_unpivot(spark, sf):
    """Cell rows of repeated column groups to one row per guarantor block."""
    li = B.table(spark, sf, "lineitem").join(B.table(spark, sf, "supplier"), F.expr("l_suppkey = s_suppkey"))
    g = li.groupBy("l_orderkey", "l_linenumber").agg(F.max(F.struct("l_suppkey", "s_name")).alias("s"))
    cells = g.selectExpr("l_orderkey as row_no", "l_linenumber", """inline(array(
        struct(l_linenumber * 4 + 1 as col_no, 'Guarantor Type 1. Entity' as header, cast(s.l_suppkey % 4 + 1 as string) as value),
        struct(l_linenumber * 4 + 2 as col_no, 'Guarantor Entity Name (if company)' as header, s.s_name as value),
        struct(l_linenumber * 4 + 3 as col_no, 'Pan No' as header, concat('P', s.l_suppkey) as value),
        struct(l_linenumber * 4 + 4 as col_no, 'Address Full address with pin code' as header, concat('Shop ', s.l_suppkey) as value)))""")
    blocks = guarantors.unpivot_guarantors(cells.withColumn("submission_id", F.lit("S")))
    return blocks.select("row_no", "block", "type", "entityName", "pan", "address")


@query
def guarantor_arrays(spark, sf):
    """The same regrouping inside one row, from an array of raw cells."""
    g = B.guarantor_columns(spark, sf)
    cells = F.expr("""flatten(transform(lines, (g, i) -> array(
        struct(2 * i + 5 as col, 'Guarantor Type' as header, case when g.l_linenumber % 2 = 1 then '2' else '1' end as value),
        struct(2 * i + 6 as col, case when g.l_linenumber % 2 = 1 then 'Full Name' else 'Guarantor entity name' end as header, g.s_name as value))))""")
    b = g.select("row_no", F.posexplode(guarantors.guarantor_blocks(cells)).alias("block", "b"))
    return b.select("row_no", "block", "b.type", "b.fullName", "b.entityName")


# ---- encoders ----------------------------------------------------------------------------------------------


@query
def encode_delimited(spark, sf):
    seg = segment_sheet(B.borrower_sheet(spark, sf), TEMPLATE, "BS")
    return seg.select("submission_id", "row_no", encode.delimited(TEMPLATE.segment("BS"), F.col("values")).alias("record"))


@query
def encode_fixed(spark, sf):
    s = B.table(spark, sf, "supplier").selectExpr(
        "array('HDR', 'HMMFI', '1.9', concat('MF', s_suppkey), s_name, '', '31072026', '05082026', 'S01', 'secret', 'INHOUSE', 'INHOUSE', '') as values", "s_suppkey")
    c = B.table(spark, sf, "customer").selectExpr("c_custkey as s_suppkey", "array('HDR', 'HMMFI', '1.9', concat('C', c_custkey), concat(c_name, ' and a very long trailing name'), '', '31072026', '05082026', 'S02', '', '', '', '') as values")
    return s.select("s_suppkey", "values").unionByName(c).select("s_suppkey", encode.fixed_width(microfinance.HDR, F.col("values")).alias("record"))


@query
def encode_tlv(spark, sf):
    c = B.customers(spark, sf).selectExpr("k", "array(borrowerName, relatedName, cast(null as string), '05061980', case when k % 2 = 0 then '1' end) as v")
    v = F.transform("v", lambda x: F.coalesce(x, F.lit("")))
    return c.select("k", encode.tag_length_value(consumer.PN, v).alias("record"))


@query
def encode_concatenated(spark, sf):
    return _flat(spark, sf).select("submission_id", "row_no", encode.concatenated(consumer.REC, F.col("values")).alias("record"))


# ---- reconciliation ----------------------------------------------------------------------------------------


def _two_files(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Documents cut into lines as the generated file of their source, and an edited copy as the filed one."""
    o = B.table(spark, sf, "orders").selectExpr(
        "concat('S', o_custkey % 5) as submission_id", "o_orderkey as ord", "concat('CR|', o_orderkey, '|', cast(round(o_totalprice * 100) as bigint), '|INR') as line")
    filed = o.withColumn("line", F.expr("case when ord % 50 = 0 then concat(substr(line, 1, length(line) - 3), 'USD') when ord % 77 = 0 then concat(line, '|') else line end"))
    crlf = F.lit("\r\n")
    return reconcile.placed_lines(o.withColumn("eol", crlf), ("ord",)), reconcile.placed_lines(filed.withColumn("eol", crlf), ("ord",))


@query
def compare_lines(spark, sf):
    g, f = _two_files(spark, sf)
    return reconcile.compare_lines(g, f).select("submission_id", "line_no", "offset", "expected", "actual")


@query
def compare_bytes(spark, sf):
    g, f = _two_files(spark, sf)
    d = reconcile.compare_bytes(reconcile.compare_lines(g, f))
    return d.select("submission_id", "offset", "line_no", "col_no", F.col("expected").cast("int").alias("expected"),
                    F.col("actual").cast("int").alias("actual"), "expected_context", "actual_context")


@query
def first_differences(spark, sf):
    g, f = _two_files(spark, sf)
    d = reconcile.first_differences(reconcile.compare_bytes(reconcile.compare_lines(g, f)), 10)
    return d.select("submission_id", "n", "line_no", "col_no")


@query
def comparison_summary(spark, sf):
    g, f = _two_files(spark, sf)
    d = reconcile.line_differences(reconcile.compare_lines(g, f))
    return reconcile.comparison_summary(reconcile.file_lengths(g), reconcile.file_lengths(f), d)


@query
def comparison_line_ends(spark, sf):
    """Files against copies: S0 with bare line feeds, S1 without its last line end, S2 without its first line, the others alike."""
    o = B.table(spark, sf, "orders").selectExpr("concat('S', o_custkey % 5) as submission_id", "o_orderkey as ord", "concat('CR|', o_orderkey) as line", "'\\r\\n' as eol")
    edges = o.groupBy("submission_id").agg(F.min("ord").alias("low"), F.max("ord").alias("high"))
    filed = o.join(edges, "submission_id").where("not (submission_id = 'S2' and ord = low)").withColumn("eol", F.expr(
        "case when submission_id = 'S0' then '\\n' when submission_id = 'S1' and ord = high then '' else eol end"))
    sides = [(g, f) for g, f in ((o, filed), (reconcile.even_line_ends(o), reconcile.even_line_ends(filed)))]
    strict, loose = (reconcile.comparison_summary(
        reconcile.file_lengths(o), reconcile.file_lengths(filed),
        reconcile.line_differences(reconcile.compare_lines(reconcile.placed_lines(g, ("ord",)), reconcile.placed_lines(f, ("ord",)))), ignore_eol=k == 1)
        for k, (g, f) in enumerate(sides))
    return strict.select("submission_id", "match", "generated_length", "reference_length", "diff_count").join(
        loose.select("submission_id", F.col("match").alias("loose_match")), "submission_id")


# ---- sheets ------------------------------------------------------------------------------------------------


def _cells(spark: SparkSession, sf: str) -> DataFrame:
    """One workbook per nation from its customers: a notes sheet, and a data sheet whose header row shifts."""
    c = B.table(spark, sf, "customer").selectExpr("concat('W', c_nationkey) as submission_id", "c_custkey as k", "c_name", "c_nationkey as n", "c_mktsegment")
    data = c.selectExpr("submission_id", "'Data' as sheet", "1 as sheet_ord", "cast(n % 5 + 2 + k as bigint) as row_no", """inline(array(
        struct(1 as col_no, c_name as value), struct(2 as col_no, concat('ACC', k) as value), struct(3 as col_no, 'x' as value),
        struct(cast(4 + n % 3 as int) as col_no, c_mktsegment as value)))""")
    heads = c.select("submission_id", "n").distinct().selectExpr("submission_id", "'Data' as sheet", "1 as sheet_ord", "cast(n % 5 + 1 as bigint) as row_no", """inline(array(
        struct(1 as col_no, "Borrower's  Name" as value), struct(2 as col_no, "BORROWER'S ACCOUNT NUMBER" as value), struct(3 as col_no, 'Business Category' as value),
        struct(cast(4 + n % 3 as int) as col_no, 'Business Category 3. Micro 4. Small' as value), struct(9 as col_no, 'Business / Industry Type' as value)))""")
    notes = c.selectExpr("submission_id", "'Notes' as sheet", "0 as sheet_ord", "cast(k + 1 as bigint) as row_no", "1 as col_no", "concat('note ', k) as value")
    out = data.unionByName(heads).unionByName(notes)
    return out.withColumn("kind", F.lit("s")).withColumn("raw_n", F.lit(None).cast("double")).withColumn("raw_s", F.col("value"))


_SPEC = commercial.MASTER_V310.flat_sheet


@query
def header_rows(spark, sf):
    return sheets.header_rows(_cells(spark, sf), _SPEC)


@query
def header_scores(spark, sf):
    return sheets.header_scores(_cells(spark, sf), _SPEC).select("submission_id", "sheet", "row_no", "score")


@query
def column_bindings(spark, sf):
    b = sheets.bind_columns(_cells(spark, sf), _SPEC)
    return b.filter(F.col("key").isin("borrowerName", "accountNumber", "businessCategory", "businessIndustryType")).select(
        "submission_id", "sheet", "header_row", "col_no", "key")


@query
def sheet_rows(spark, sf):
    return sheets.data_rows(_cells(spark, sf), _SPEC).select("submission_id", "row_no", "borrowerName", "accountNumber", "businessCategory")


@query
def lineage_cells(spark, sf):
    return sheets.field_places(_cells(spark, sf), _SPEC).select("submission_id", F.col("field_key").alias("field"), F.col("column").alias("letter"))
