import zipfile

from ledgerbeam.sources.sheets import header_overrides, master_book, normal_cells
from ledgerbeam.operators.gate import gate
from ledgerbeam.sources.workbooks import odd_cell_issues, read_workbook_cells, unreadable_issues
from ledgerbeam.specs.registry import get_format

FMT = get_format("commercial-ucrf-flat-v310")


def workbook(path, rows):
    """A minimal workbook with inline strings and numbers."""
    body = ""
    for r, cells in rows.items():
        body += f'<row r="{r}">'
        for ref, v in cells.items():
            body += f'<c r="{ref}{r}"><v>{v}</v></c>' if isinstance(v, (int, float)) else f'<c r="{ref}{r}" t="inlineStr"><is><t>{v}</t></is></c>'
        body += "</row>"
    ns = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{ns}" xmlns:r="{rel}"><sheets><sheet name="Sheet1" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{ns}"><sheetData>{body}</sheetData></worksheet>')


def test_shifted_sheet_is_found_bound_and_read(spark, tmp_path):
    workbook(tmp_path / "W1.xlsx", {
        3: {"A": "Borrower's Name", "B": "Borrower's Account Number", "C": "Facility / Loan Activation / Sanction Date",
            "D": "Business Category", "E": "Business Category 3. Micro", "F": "Guarantor Type", "G": "Full Name", "H": "Guarantor Type", "I": "Full Name"},
        4: {"A": " Acme ", "B": 1234567890123, "C": 45000, "E": "Micro", "F": "2", "G": "Asha", "I": "Ravi"},
        5: {"A": "Beta", "C": 15012026}})
    (tmp_path / "bad.xlsx").write_bytes(b"not a workbook")
    cells = normal_cells(read_workbook_cells(spark, str(tmp_path))).cache()
    rows = {r.row_no: r for r in master_book(cells, FMT.flat_sheet).collect()}
    assert rows[4].borrowerName == "Acme" and rows[4].accountNumber == "1234567890123"
    assert rows[4].sanctionDate == "15032023" and rows[5].sanctionDate == "15012026"
    assert rows[4].businessCategory == "Micro"
    assert [g.fullName for g in rows[4].guarantors] == ["Asha", "Ravi"]


def test_header_cells_need_their_label(spark, tmp_path):
    workbook(tmp_path / "W1.xlsx", {5: {"A": "Member ID", "B": "MBR9"}, 6: {"A": "Reporting", "B": "31/07/2026"}, 7: {"B": "no date"},
                                    10: {"A": "Borrower's Name"}, 11: {"A": "Acme"}})
    cells = normal_cells(read_workbook_cells(spark, str(tmp_path))).replace("Sheet1", "Master Sheet", ["sheet"])
    o = header_overrides(cells, FMT).first()
    assert o.member_id == "MBR9" and str(o.reporting_date) == "2026-07-31" and o.creation_date is None


def test_no_workbook_is_read_half_way(spark, tmp_path):
    rows = {r: {"A": f"Name {r}", "B": r} for r in range(1, 11)}
    workbook(tmp_path / "whole.xlsx", rows)
    workbook(tmp_path / "comma.xlsx", rows)
    workbook(tmp_path / "torn.xlsx", rows)
    workbook(tmp_path / "cut.xlsx", rows)
    for name, old, new in (("comma", "<v>6</v>", "<v>12,5</v>"), ("torn", '<row r="7">', '<row r="7"')):
        with zipfile.ZipFile(tmp_path / f"{name}.xlsx") as z:
            parts = {n: z.read(n).decode() for n in z.namelist()}
        with zipfile.ZipFile(tmp_path / f"{name}.xlsx", "w") as z:
            for n, text in parts.items():
                z.writestr(n, text.replace(old, new))
    data = (tmp_path / "cut.xlsx").read_bytes()
    (tmp_path / "cut.xlsx").write_bytes(data[: len(data) // 2])
    cells = read_workbook_cells(spark, str(tmp_path)).cache()
    held = {r[0]: r[1] for r in normal_cells(cells).groupBy("submission_id").count().collect()}
    assert held == {"whole": 20, "comma": 20}
    assert [r.value for r in normal_cells(cells).where("submission_id = 'comma' and row_no = 6 and col_no = 2").collect()] == ["12,5"]
    lost, odd = unreadable_issues(cells, FMT), odd_cell_issues(cells, FMT)
    assert sorted((r.submission_id, r.severity, r.bypassable) for r in lost.collect()) == [("cut", "error", False), ("torn", "error", False)]
    assert [(r.submission_id, r.severity, r.sheet, r.row_number) for r in odd.collect()] == [("comma", "warning", "Sheet1", 6)] and "B6" in odd.first().message
    passed = {r.submission_id: r.passes for r in gate(cells.select("submission_id").distinct(), lost.unionByName(odd), emit_with_errors=True).collect()}
    assert passed == {"whole": True, "comma": True, "torn": False, "cut": False}
