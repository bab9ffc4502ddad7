"""The Master Sheet is mapped over rows, a party each, so that Spark compiles the steps an address is read in (F2, F3, F4)."""

import pytest
from pyspark.sql import functions as F

from ledgerbeam.functions import addresses as A
from ledgerbeam.functions.lookups import legend_code
from ledgerbeam.functions.text import known, known_text, one_line, fold_breaks
from ledgerbeam.operators.master_sheet import explode_book
from ledgerbeam.specs.commercial import GUARANTOR_KEYS
from ledgerbeam.specs.registry import get_format

FMT = get_format("commercial-ucrf-flat-v310")
INPUTS = ("borrowerName", "address", "locationType", "relatedName", "relatedPan", "relatedDob", "relatedAddress")


def book(spark, *rows):
    """Rows of given inputs; ``guarantors`` is a list of given inputs or None."""
    blocks = "array<struct<" + ",".join(f"{k}:string" for k in GUARANTOR_KEYS) + ">>"
    cells = [("S", n, *[r.get(k) for k in INPUTS], r.get("guarantors") and [tuple(g.get(k) for k in GUARANTOR_KEYS) for g in r["guarantors"]]) for n, r in enumerate(rows, 11)]
    return spark.createDataFrame(cells, "submission_id string, row_no int, " + ", ".join(f"{k} string" for k in INPUTS) + f", guarantors {blocks}")


def segments(spark, *rows):
    out = {}
    for r in explode_book(book(spark, *rows), FMT).collect():
        assert (r.row_no, r.tag, r.seq) not in out
        out[r.row_no, r.tag, r.seq] = r
    return out


def field(r, key):
    return r["values"][FMT.segment(r.tag).index(key)]


def test_steps_of_an_address_are_not_interpreted(spark):
    spark.conf.set("spark.sql.debug.maxToStringFields", 10000)
    try:
        plan = explode_book(book(spark, {"borrowerName": "A"}), FMT)._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.debug.maxToStringFields")
    assert "zip_with(" not in plan and "regexp_extract_all(lambda" not in plan and "regexp_extract_all(_p_lower#" in plan


def test_every_party_has_its_segment_and_place(spark):
    plot = "Plot 1, Pune, Maharashtra 411001"
    got = segments(spark, {"borrowerName": "A", "address": plot, "locationType": "02", "relatedName": "P", "relatedPan": "AAAPA0001A", "relatedDob": "1/1/1970", "relatedAddress": plot, "guarantors": [
        {"fullName": "G", "type": "Individual", "pan": "aaapa0001a", "address": "Shop 2, Surat, Gujarath 395003"}, {"fullName": "n/a", "address": plot},
        {"entityName": " E ", "pan": "AAAPA0001A", "dob": "02-01-1970", "address": f" {plot.replace(',', ' ,')} "}]},
        {"borrowerName": "B", "relatedName": "NA", "relatedPan": "AAAPA0001A", "guarantors": [{"fullName": "H", "pan": "AAAPA0001A", "address": "Nowhere"}]}, {"borrowerName": "C"})
    assert {k[1:] for k in got if k[0] == 11} == {("BS", 0), ("AS", 0), ("AS", 1), ("RS", 0), ("CR", 0), ("GS", 0), ("GS", 1)}
    assert {k[1:] for k in got if k[0] == 12} == {("BS", 0), ("AS", 0), ("CR", 0), ("GS", 0)} and {k[1:] for k in got if k[0] == 13} == {("BS", 0), ("AS", 0), ("CR", 0)}
    assert {k: r.borrower_tags for k, r in got.items() if r.borrower_tags} == {(11, "BS", 0): ["BS", "AS", "AS", "RS", "CR", "GS", "GS"], (12, "BS", 0): ["BS", "AS", "CR", "GS"], (13, "BS", 0): ["BS", "AS", "CR"]}
    first, second, alone = got[11, "GS", 0], got[11, "GS", 1], got[12, "GS", 0]
    assert (field(first, "gsFullName"), field(first, "gsCity"), field(first, "gsStateCode")) == ("G", "Surat", field(first, "gsStateCode")) and field(first, "gsStateCode")
    assert field(second, "gsFullName") == "E" and field(second, "gsDateOfBirth") == "02011970"
    told = {k: [n.message for n in r.notes] for k, r in got.items()}
    assert any("two addresses differ" in m for m in told[11, "GS", 0]) and any("looks misspelt" in m for m in told[11, "GS", 0])
    assert not any("two addresses differ" in m for m in told[11, "GS", 1] + told[12, "GS", 0]) and any("Two birth dates" in m for m in told[11, "GS", 1])
    assert any('No state found in the guarantor address "Nowhere"' in m for m in told[12, "GS", 0]) and alone.first_ord == 12


def test_a_party_row_is_resolved_as_an_array_of_parties_is(spark):
    texts = ["Plot 1, Pune, Maharashtra 411001", "x\ty,\r\nKochi Keralaa 682001", " NA ", None, "", "12 Road, Hyderabad - 500001. INDIA", "Unit 7, Unknown Place", "West,Bengal & goa.x",
             "Goa", "goats, Patna-800001", "a\x01b Delhi 110001", ",", "Jammu  and Kashmir ", "andhra pradesh", "Andhra 5", "Surat, 395003, Gujarat, India", "x , \u0085Bihar"]
    rows = spark.createDataFrame([(i, t, c) for i, t in enumerate(texts) for c in (None, "Nagpurr", "delhi", "N/A")], "i int, raw string, city string")
    arrays = rows.select("i", "city", A.resolve_address(raw=F.col("raw"), city=F.col("city")).alias("party"))
    plain = A.resolve_rows(rows.withColumn("given", F.col("city")), ("i", "given"), who=F.lit("Party"), raw=F.col("raw"), city=F.col("city")).selectExpr("i", "given as city", "party")
    as_text = [{(r.i, r.city): r.party for r in df.select("i", "city", F.to_json("party").alias("party")).collect()} for df in (arrays, plain)]
    assert as_text[0] == as_text[1] and len(as_text[0]) == 4 * len(texts)


@pytest.mark.parametrize("text", ["na", "N.A", "n/a", "N./A", "nA ", "-", "-" * 9, "-a", " null ", " nil", "none", "nones", "", None, "\u0085", "n.a.", "nan", "a\tb", "a \r\n\t b"])
def test_compiled_texts_equal_interpreted_ones(spark, text):
    r = spark.createDataFrame([(text,)], "t string").select(known("t").alias("a"), known_text(F.col("t")).alias("b"), fold_breaks(F.col("t")).alias("c"), one_line(F.col("t")).alias("d")).first()
    assert r.a == r.b and r.c == r.d


def test_codes_with_and_without_numbers(spark):
    given = ["11", "11. Self Help Group", "7", "Private limited", "Pvt  Ltd", " 12 ", "x", "7x", "5 - Trust", "", None]
    rows = spark.createDataFrame([(t,) for t in given], "t string").select(legend_code("constitution", F.col("t")).alias("code")).collect()
    assert [r.code for r in rows][:2] == ["11", rows[1].code] and rows[3].code == rows[4].code == "11" and rows[6].code is None and rows[9].code is None and rows[10].code is None
