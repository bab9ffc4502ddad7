import datetime

from pyspark.sql import functions as F

from ledgerbeam.functions import addresses as A
from ledgerbeam.functions.amounts import number_text, whole_rupees
from ledgerbeam.functions.dates import cycle_code, sheet_date_text
from ledgerbeam.functions.lookups import legend_code
from ledgerbeam.functions.text import last_pin, name_parts, printable


def apply(spark, fn, values, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("v"))).collect()]


def test_dates(spark):
    texts = ["15012026", "1/2/2020", "04th June 2025", "June 4, 2025", "4-6-25", "4/6/75", "99999999", "NA", "junk"]
    assert apply(spark, sheet_date_text, texts) == [
        "15012026", "01022020", "04062025", "04062025", "04062025", "04061975", "99999999", None, "junk"]


def test_cycle_codes(spark):
    days = [(2026, 7, 9), (2026, 7, 16), (2026, 7, 23), (2026, 7, 31), (2026, 2, 28), (2024, 2, 29), (2026, 7, 5), (2026, 7, 20)]
    got = apply(spark, cycle_code, [datetime.date(*d) for d in days], "date")
    assert got == ["W1", "W2", "W3", "ME", "ME", "ME", "W1", "W3"]


def test_amounts(spark):
    assert apply(spark, whole_rupees, ["1,234.5", "-2.5", "0.4", "NA", "No"]) == ["1235", "-2", "0", None, None]
    assert apply(spark, number_text, ["007", "12.50", "12345678.25", "abc", "1e3"]) == ["7", "12.5", "12345678.25", "abc", "1000"]


def test_legends(spark):
    got = apply(spark, lambda c: legend_code("constitution", c), ["11", "11. Self Help Group", "7", "Private limited", "12", "x"])
    assert got == ["11", "85", "55", "11", "12", None]


def test_pins(spark):
    texts = ["Plot No-1577158, Vapi-396195", "Survey 396230, Plot 1234567", "Gujarat 3962301", "Gujarat-96195"]
    assert apply(spark, last_pin, texts) == ["396195", "396230", None, None]


def test_addresses(spark):
    texts = ["X, Vapi, dadra& nagar haveli-396230", "X, Sultanpur, Uttarpradesh-228001", "Shop 1, Goalpara, Assam-781001",
             "Unit 2, Worli, Mumbai - 400018. INDIA", "No 5 Hassan, Karanataka India 573201", "Gujarati Society, Mumbai 400001",
             "Unit 7, Unknown Place"]
    got = apply(spark, A.split_address, texts)
    assert [g.state_code for g in got] == ["08", "33", "04", "20", "16", "20", None]
    assert got[3].line1 == "Unit 2, Worli" and got[3].city == "Mumbai"
    assert got[4].note == 'State "Karanataka" in the address looks misspelt; read as Karnataka (16).'


def test_text_helpers(spark):
    assert tuple(apply(spark, name_parts, [" Asha  Rao Devi  K "])[0]) == ("Asha", "Rao", "Devi K")
    assert apply(spark, printable, ["a\x01b\tc\r\n"]) == ["a\\x01b\\tc\\r\\n"]


def test_the_place_of_a_state_does_not_compile_its_pattern_for_each_text(spark, capsys):
    texts = ["Plot 1, Pune, Maharashtra 411001", "A\x01B Road, Surat\x01, Gujarat\x01 near Kerala House, Kochi, Kerala\x01 682001", "x\x01y, Goa,\x01", None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(texts)], "i int, v string").select("i", A.split_address(F.col("v")).alias("a"))
    got = {r.i: (r.a.city, r.a.state_code) for r in df.collect()}
    assert got == {0: ("Pune", "20"), 1: ("Kochi", "17"), 2: ("x\x01y", "10"), 3: (None, None)}
    df.explain()
    assert "(?<![a-z0-9_])" in (plan := capsys.readouterr().out) and not [p for p in plan.split("split(")[1:] if "(?<![a-z0-9_])" in p.split("),")[0][:200]]
