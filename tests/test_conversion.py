import datetime
import glob

import pytest
from pyspark.sql import functions as F

from ledgerbeam.operators.master_sheet import explode_book
from ledgerbeam.operators.segments import NOTE_TYPE, segment_sheet, union_sheets
from ledgerbeam.operators.cross_rows import duplicate_accounts
from ledgerbeam.plans.convert import convert_batch
from ledgerbeam.plans.reconcile import reconcile
from ledgerbeam.sinks.files import write_submissions
from ledgerbeam.sources.bureau_files import decode_delimited, read_lines
from ledgerbeam.specs import commercial, consumer, microfinance
from ledgerbeam.specs.registry import formats, get_format

FMT = get_format("commercial-ucrf-flat-v310")
KEYS = commercial.GUARANTOR_KEYS
BOOK = ("submission_id string, row_no int, borrowerName string, pan string, legalConstitution string, address string, contactNo string, "
        "accountNumber string, sanctionDate string, sanctionedAmount string, creditType string, assetClassification string, "
        "relatedName string, relatedGender string, relatedPan string, relatedAddress string, guarantors array<struct<"
        + ",".join(f"{k}:string" for k in KEYS) + ">>")


def guarantor(**given):
    return tuple(given.get(k) for k in KEYS)


@pytest.fixture(scope="module")
def meta(spark):
    day = datetime.date
    return spark.createDataFrame(
        [(s, "MBR1", "Lender", None, day(2026, 7, 31), day(2026, 8, 5), None, {}) for s in ("S1", "S2", "S3")],
        "submission_id string, member_id string, member_name string, member_short_name string, reporting_date date, "
        "creation_date date, password string, extras map<string,string>")


@pytest.fixture(scope="module")
def done(spark, meta):
    g = guarantor(type="Individual", fullName="Asha Rao", pan="ABOPS9467L", gender="Female", address="Flat 4, Pune, Maharashtra 411001")
    rows = [
        ("S1", 11, "Acme Ltd", "AAACV6672N", "12", "B 90,\nSana nagar,\r\nHyderabad, Telangana India 500018", "9949035745", "A1",
         "01/01/2024", "5,00,000", "5000", "Standard", "Asha Rao", "02", "ABOPS9467L", "Flat 3, Bengaluru, Karnataka 560034", [g]),
        ("S2", 11, "Beta | Co", "BAD", "12", "Unit 7, Unknown Place", None, "A1", "01012024", "100", "Loan", "1", None, None, None, None, []),
        ("S2", 12, "Beta Co", "AAACV6672N", "12", "X, Pune, Maharashtra 411001", None, "A1", "01012024", "100", "0300", "1", None, None, None, None, None),
    ]
    book = spark.createDataFrame(rows, BOOK)
    return convert_batch(explode_book(book, FMT), meta, FMT, emit_with_errors=True)


def test_clean_row_becomes_exact_records(done):
    lines = [r.record for r in done.records.filter("submission_id = 'S1'").orderBy("band", "first_ord", "flag", "spec_ord", "seq").collect()]
    assert lines[0] == "HD|MBR1||05082026|31072026|ME|" and lines[-1] == "TS|1|1|"
    assert lines[1] == "BS|HO||Acme Ltd||||AAACV6672N|||||12|" + "|" * 14
    assert lines[2] == "AS|01||B 90, Sana nagar, Hyderabad, Telangana India 500018|||Hyderabad|Hyderabad|36|500018|079|9949035745||||||"
    assert [len(x.split("|")) for x in lines] == [7, 28, 18, 40, 45, 38, 4]
    assert lines[5].split("|")[2] == "2" and lines[5].split("|")[7] == "Asha Rao"


def test_gate_and_findings(done):
    g = {r.submission_id: r for r in done.gate.collect()}
    assert g["S1"].passes and g["S1"].errors == 1  # the related person has no relationship
    assert not g["S2"].passes and g["S2"].has_non_bypassable
    found = {(r.ac_no, r.field_key, r.rule, r.bypassable) for r in done.issues.filter("submission_id = 'S2'").collect()}
    assert {("r11", "borrowerName", "format", False), ("r11", "pan", "format", True), ("r11", "address", "parse", False),
            ("r11", "creditType", "lookup", False), ("r12", "accountNumber", "duplicate", True)} <= found
    assert done.issues.filter("submission_id = 'S3'").first().rule == "empty-input"
    same = done.issues.filter("submission_id = 'S1' and message like '%two addresses differ%'").collect()
    assert len(same) == 1 and same[0].severity == "warning"
    parse = done.issues.filter("rule = 'parse'").first()
    assert parse.reference == "Commercial UCRF V3.10 §8.5 State, p. 49"


def test_duplicates_survive_a_hot_account(spark, done):
    fmt = commercial.TEMPLATE_V310
    rows = [("S1", f"B{i}", i, "HOT" if i % 3 else f"U{i}", "01012024", "1") for i in range(60)]
    cr = segment_sheet(spark.createDataFrame(rows, "submission_id string, ac_no string, row_no int, accountNumber string, sanctionDate string, sanctionedAmount string"), fmt, "CR")
    got = duplicate_accounts(union_sheets(cr), fmt, hot_rows=5).collect()
    assert len(got) == 39 and {r.first_row for r in got} == {1} and {r.account for r in got} == {"HOT"}


def test_written_file_is_byte_exact_and_reads_back(spark, done, tmp_path):
    write_submissions(done.records, FMT, str(tmp_path / "out"))
    parts = sorted(glob.glob(str(tmp_path / "out/submission_id=S1/*")))
    data = b"".join(open(p, "rb").read() for p in parts)
    lines = [r.record for r in done.records.filter("submission_id = 'S1'").orderBy("band", "first_ord", "flag", "spec_ord", "seq").collect()]
    assert data == "".join(x + "\r\n" for x in lines).encode("latin-1")
    assert not glob.glob(str(tmp_path / "out/_staging*"))
    back = decode_delimited(read_lines(spark, str(tmp_path / "out/submission_id=S1")), FMT)
    assert sorted("|".join(r["values"]) for r in back.collect()) == sorted(lines[1:-1])


def test_a_rerun_replaces_the_submission_and_no_other(spark, done, tmp_path):
    def held(sid):
        return b"".join(open(p, "rb").read() for p in sorted(glob.glob(str(tmp_path / f"again/submission_id={sid}/*"))))

    path, before = str(tmp_path / "again"), spark.conf.get("spark.sql.shuffle.partitions")
    write_submissions(done.records, FMT, path)
    first = {s: held(s) for s in ("S1", "S2")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "2")
        write_submissions(done.records.where("submission_id = 'S1'"), FMT, path)
        write_submissions(done.records.where("submission_id = 'S1'"), FMT, path, mode="overwrite")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert first["S1"] and {s: held(s) for s in ("S1", "S2")} == first


def test_reconciliation_names_the_first_difference(spark, meta, done, tmp_path):
    write_submissions(done.records, FMT, str(tmp_path / "filed"))
    part = sorted(glob.glob(str(tmp_path / "filed/submission_id=S1/*")))[0]
    text = open(part, "rb").read().replace(b"Acme", b"Acne", 1)
    open(part, "wb").write(text)
    seg = done.segments.withColumn("notes", F.array().cast(NOTE_TYPE)).drop("issues", "record")
    r = reconcile(seg.filter("submission_id = 'S1'"), meta.filter("submission_id = 'S1'"), FMT, read_lines(spark, str(tmp_path / "filed")))
    v = r.verdicts.first()
    assert v.verdict == "MISMATCH" and v.diff_count == 1 and "(line 2, col 10)" in v.summary
    assert r.differences.first().expected == ord("m")


def test_one_line_layout_has_no_separators(spark, meta, tmp_path):
    fmt = microfinance.CDF
    member = spark.createDataFrame([("S1", "M1", 2, "MEM1")], "submission_id string, ac_no string, row_no int, memberIdentifier string")
    seg = union_sheets(segment_sheet(member, fmt, "CNSCRD"))
    out = convert_batch(seg, meta.filter("submission_id = 'S1'"), fmt, emit_with_errors=True)
    write_submissions(out.records, fmt, str(tmp_path / "cdf"))
    data = b"".join(open(p, "rb").read() for p in sorted(glob.glob(str(tmp_path / "cdf/submission_id=S1/*"))))
    assert data.count(b"\r\n") == 1 and data.endswith(b"\r\n") and data.startswith(b"HDRHMMFI1.9MBR1")
    assert data[171:].startswith(b"CNSCRD|MEM1|") and len(data) == 171 + len("CNSCRD|MEM1") + 54 + 41 + 2


def test_formats(spark):
    assert formats(spark).count() == 5
    assert get_format("consumer-ucrf12") is consumer.TUDF
    with pytest.raises(KeyError):
        get_format("commercial-ucrf")
    assert [len(s.fields) for s in commercial.TEMPLATE_V310.body] == [28, 18, 40, 45, 38, 8, 8]
    assert sum(f.width for f in microfinance.HDR.fields) == 171 and sum(f.width for f in consumer.TUDF_HEADER.fields) == 146
    assert sum(f.width for f in consumer.FLAT_HEADER.fields) == 155


def _bytes_of(folder):
    return b"".join(open(p, "rb").read() for p in sorted(glob.glob(f"{folder}/*")))


def test_reconciliation_counts_line_ends(spark, meta, done, tmp_path):
    write_submissions(done.records.where("submission_id = 'S1'"), FMT, str(tmp_path / "made"))
    made = _bytes_of(tmp_path / "made/submission_id=S1")
    seg = done.segments.withColumn("notes", F.array().cast(NOTE_TYPE)).drop("issues", "record").filter("submission_id = 'S1'")
    for name, data, strict, loose in (("same", made, True, True), ("lf", made.replace(b"\r\n", b"\n"), False, True), ("cut", made[:-2], False, False), ("none", b"", False, False)):
        folder = tmp_path / name / "submission_id=S1"
        folder.mkdir(parents=True)
        (folder / "part-0.txt").write_bytes(data)
        for ignore, want in ((False, strict), (True, loose)):
            v = reconcile(seg, meta.filter("submission_id = 'S1'"), FMT, read_lines(spark, str(tmp_path / name)), ignore_eol=ignore).verdicts.first()
            assert (v.verdict == "MATCH", v.generated_length, v.reference_length) == (want, len(made), len(data)), (name, ignore)


def test_one_line_file_matches_itself(spark, meta, tmp_path):
    fmt = microfinance.CDF
    rows = [("S1", f"M{k}", k, f"MEM{k}") for k in range(300)]
    seg = union_sheets(segment_sheet(spark.createDataFrame(rows, "submission_id string, ac_no string, row_no int, memberIdentifier string"), fmt, "CNSCRD"))
    one = meta.filter("submission_id = 'S1'")
    write_submissions(convert_batch(seg, one, fmt, emit_with_errors=True).records, fmt, str(tmp_path / "made"))
    made = _bytes_of(tmp_path / "made/submission_id=S1")
    for name, data, at in (("same", made, None), ("changed", made.replace(b"MEM250|", b"MEX250|") if b"MEM250|" in made else made.replace(b"MEM250", b"MEX250"), made.index(b"MEM250") + 2)):
        folder = tmp_path / name / "submission_id=S1"
        folder.mkdir(parents=True)
        (folder / "part-0.txt").write_bytes(data)
        for separator in ("\n", "CNSCRD|"):
            r = reconcile(seg, one, fmt, read_lines(spark, str(tmp_path / name), separator))
            v = r.verdicts.first()
            assert (v.verdict == "MATCH", v.generated_length, v.reference_length) == (at is None, len(made), len(data))
            assert at is None or (r.differences.first().offset, r.differences.first().line_no, r.differences.first().col_no) == (at, 1, at + 1)
