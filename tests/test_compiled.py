"""Row-local work stays in methods that the JVM compiles: over 8,000 bytes it interprets them, at many times the cost."""

import datetime
import re

import pytest
from pyspark.sql import functions as F

from ledgerbeam.functions.dates import date_from_text, day_text, ddmmyyyy
from ledgerbeam.operators.consumer_form import explode_form
from ledgerbeam.operators.encode import encode_rows
from ledgerbeam.operators.segments import cell_text
from ledgerbeam.specs import consumer

KEYS = list(consumer.FORM_LETTERS.values())


@pytest.fixture
def plain_plans(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.enabled", "true")


@pytest.fixture(scope="module")
def meta(spark):
    return spark.createDataFrame([("S1", " MBR1 ", None)], "submission_id string, member_id string, member_short_name string")


def form(spark, *rows):
    cells = [("S1", n, *[given.get(k) for k in KEYS]) for n, given in enumerate(rows, 11)]
    return spark.createDataFrame(cells, "submission_id string, row_no int, " + ", ".join(f"{k} string" for k in KEYS))


def records(spark, meta, *rows):
    done = explode_form(form(spark, *rows), meta)
    out = done.select("row_no", "tag", encode_rows(consumer.TUDF, F.col("values")).alias("record"), F.size("notes").alias("notes")).collect()
    return {(r.row_no, r.tag): (r.record, r.notes) for r in out}


def test_methods_of_the_form_are_small_enough_to_be_compiled(spark, meta, plain_plans, capsys):
    seg = explode_form(form(spark, {"consumerName": "A"}), meta)
    seg.select("row_no", "tag", encode_rows(consumer.TUDF, F.col("values")).alias("record")).explain("codegen")
    text = capsys.readouterr().out
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", text)]
    assert sizes and max(sizes) < 8000, sizes
    assert "filter(array(regexp_replace" not in text  # no cell is cleaned by an interpreted function over arrays


def test_form_cells_of_odd_shapes(spark, meta):
    name = " Asha \t Rao\n Devi  K﻿"
    got = records(spark, meta, {"consumerName": name, "dateOfBirth": " 5/6/1980 ", "pan": " \t ", "email": "a\r\n b", "highCredit": " 1e3 ", "currentBalance": "12.500",
                                "amountOverdue": "0.0", "rateOfInterest": "n/a", "suitFiled": "00", "address": "x" * 39 + "  " + "y" * 45, "dateOpened": "31022020"},
                  {"consumerName": "  ", "gender": "2"}, {"consumerName": " ", "pan": "\n"})
    assert got[(11, "PN")][0] == "PN03N010104Asha0203Rao0306Devi K070805061980"
    assert (11, "ID") not in got and got[(11, "EC")][0].endswith("a b")
    tl, pa = got[(11, "TL")], got[(11, "PA")][0]
    assert "1000" in tl[0] and "12.5" in tl[0] and "n/a" in tl[0] and "31022020" in tl[0] and "12.50" not in tl[0] and tl[1] == 0
    assert "39" + "x" * 39 in pa and "39" + "y" * 39 in pa and "06" + "y" * 6 in pa
    assert got[(12, "PN")][0] == "PN03N0108012" and got[(12, "TL")][1] == 2
    assert got[(11, "ES")][0] == got[(12, "ES")][0] and not any(n == 13 for n, _ in got)


def test_cell_text(spark):
    cells = spark.createDataFrame([("﻿ a \t\n b\r\nc ",), (" \u000b ",), (None,), ("a  b",), ("",)], "c string")
    assert [r[0] for r in cells.select(cell_text("c")).collect()] == ["a b c", None, None, "a  b", None]


def test_eight_digits_are_not_parsed_to_be_written_again(spark, capsys):
    given = ["05061980", "31022020", "00000000", "01010000", "29022000", "29021900", "5/6/1980", "31-2-2020", "1.1.0001", "1/1/0000", "4 June 2025", "123", "", None]
    dates = spark.createDataFrame([(t,) for t in given], "t string")
    both = dates.select(day_text(F.col("t")).alias("now"), F.coalesce(ddmmyyyy(date_from_text(F.col("t"))), F.col("t")).alias("parsed")).collect()
    assert [r.now for r in both] == [r.parsed for r in both] and both[6].now == "05061980"
    dates.select(day_text(F.col("t"))).explain("extended")
    assert "ddMMyyyy, TimestampType" not in capsys.readouterr().out
