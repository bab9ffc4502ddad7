"""Folders of workbooks to records, gate and issues with their cells."""

import datetime

import pytest

from ledgerbeam.operators.rollup import issue_listing
from ledgerbeam.plans.intake import convert_workbooks
from ledgerbeam.sources import workbooks
from ledgerbeam.specs import commercial
from ledgerbeam.specs.registry import get_format
from test_workbooks import workbook

FMT = get_format("commercial-ucrf-flat-v310")
LABELS = ["Borrower's Name", "Borrower's PAN", "Borrower's Legal Constitution", "Borrower's Account Number", "Facility / Loan Activation / Sanction Date", "Business Category", "Sanctioned Amount/Notional Amount of Contract"]


def book(path, columns, rows, sheet="Sheet1"):
    """A workbook whose labels stand in the given columns, in row 10; extra sheets by a list of sheets."""
    workbook(path, {10: dict(zip(columns, LABELS)), **{11 + k: dict(zip(columns, r)) for k, r in enumerate(rows)}})


@pytest.fixture(scope="module")
def meta(spark):
    day = datetime.date
    names = ["left", "right", "damaged", "garbage", "empty"]
    return spark.createDataFrame([(s, "MBR1", "Lender", None, day(2026, 7, 31), day(2026, 8, 5), None, {}) for s in names],
                                 "submission_id string, member_id string, member_name string, member_short_name string, reporting_date date, creation_date date, password string, extras map<string,string>")


@pytest.fixture(scope="module")
def done(spark, meta, tmp_path_factory):
    folder = tmp_path_factory.mktemp("books")
    good = ["Acme Ltd", "AAACV6672N", "12", "A1", "01/01/2024", "Micro", "100"]
    bad = ["Beta", "BADPAN", "12", "A1", "soon", "Nothing like it", "100"]
    book(folder / "left.xlsx", "ABCDEFG", [good, bad])
    book(folder / "right.xlsx", ["C", "D", "E", "H", "I", "K", "AA"], [good, good[:3] + ["A2"] + good[4:], bad[:3] + ["A3"] + bad[4:]])
    workbook(folder / "garbage.xlsx", {1: {"A": "Foo", "B": "Bar"}, 2: {"A": 1, "B": 2}})
    workbook(folder / "empty.xlsx", {})
    (folder / "damaged.xlsx").write_bytes(b"this is no workbook")
    return convert_workbooks(spark, str(folder), meta, FMT, emit_with_errors=True)


def test_issues_stand_at_the_cells_of_their_own_workbook(done):
    found = {(r.submission_id, r.field, r.row): r.cell for r in issue_listing(done.issues).collect() if r.cell}
    cells = {k[0::2] + (v,) for k, v in found.items() if k[0] in ("left", "right")}
    pan = {(s, c) for (s, f, _), c in found.items() if "PAN" in f}
    assert {("left", "B12"), ("right", "D13")} <= pan
    assert ("left", 12, "E12") in cells and ("right", 13, "I13") in cells  # the date
    assert ("left", 12, "F12") in cells and ("right", 13, "K13") in cells  # a category without legend entry
    assert ("left", 12, "D12") in cells  # the account that repeats
    assert all(r.column is None for r in done.issues.filter("row_number = 0").collect())


def test_readers_findings_reach_the_gate_by_themselves(done):
    passes = {r.submission_id: r.passes for r in done.gate.collect()}
    assert passes == {"left": True, "right": True, "damaged": False, "garbage": False, "empty": False}
    filed = {r.submission_id for r in done.records.select("submission_id").distinct().collect()}
    assert filed == {"left", "right"}
    messages = {r.submission_id: r.message for r in done.issues.filter("rule = 'parse' and row_number = 0").collect()}
    assert set(messages) == {"damaged", "garbage", "empty"}
    assert '"Sheet1"' in messages["garbage"] and "Master Sheet" in messages["garbage"] and "damaged" in messages["damaged"]


def test_each_sheet_is_a_task(spark, tmp_path):
    import zipfile

    ns, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    names = {"BS": [["Borrower Name"], ["Acme"], ["Beta"]], "CR": [["A/C No.", "Account Number"], ["b1", "77"]]}
    with zipfile.ZipFile(tmp_path / "two.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{ns}" xmlns:r="{rel}"><sheets>' + "".join(f'<sheet name="{n}" sheetId="{k}" r:id="r{k}"/>' for k, n in enumerate(names)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="r{k}" Target="worksheets/s{k}.xml"/>' for k in range(2)) + "</Relationships>")
        texts = [c for rows in names.values() for r in rows for c in r]
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{ns}">' + "".join(f"<si><t>{t}</t></si>" for t in texts) + "</sst>")
        at = iter(range(len(texts)))
        for k, rows in enumerate(names.values()):
            body = "".join(f'<row r="{r + 1}">' + "".join(f'<c r="{"ABC"[c]}{r + 1}" t="s"><v>{next(at)}</v></c>' for c in range(len(row))) + "</row>" for r, row in enumerate(rows))
            z.writestr(f"xl/worksheets/s{k}.xml", f'<worksheet xmlns="{ns}"><sheetData>{body}</sheetData></worksheet>')
    spark.dataSource.register(workbooks.WorkbookCells)
    raw = spark.read.format("workbook_cells").option("path", str(tmp_path)).load()
    assert raw.rdd.getNumPartitions() == 2
    cells = workbooks.read_workbook_cells(spark, str(tmp_path))
    assert sorted((r.sheet, r.row_no, r.raw_s) for r in cells.filter("kind = 's'").collect()) == sorted((n, r + 1, c) for n, rows in names.items() for r, row in enumerate(rows) for c in row)
    from ledgerbeam.sources.sheets import normal_cells, segment_table

    values = normal_cells(cells)
    borrowers = segment_table(values, commercial.TEMPLATE_V310.segment("BS")).select("ac_no").collect()
    accounts = segment_table(values, commercial.TEMPLATE_V310.segment("CR")).select("ac_no", "accountNumber").collect()
    assert sorted(r.ac_no for r in borrowers) == ["row2", "row3"] and [tuple(r) for r in accounts] == [("b1", "77")]
