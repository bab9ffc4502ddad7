"""A folder of workbooks to filed records as one plan.

Whatever the reader has to say (damaged files, odd cells, missing sheets), the run parameters typed in the sheets and the sheet
columns of fields go the same way as the cells, so that none of them can be left out of the gate."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

from ..operators.consumer_form import explode_form
from ..operators.master_sheet import explode_book
from ..operators.partitioning import cut, deal_out
from ..operators.rules import Rule
from ..operators.segments import flat_records, segment_sheet, union_sheets
from ..operators.validate import Rules
from ..sources import sheets
from ..sources.tables import credit_type_lookup
from ..sources.workbooks import odd_cell_issues, read_workbook_cells, unreadable_issues
from ..specs.model import Format
from .convert import Conversion, convert_batch


class Intake(NamedTuple):
    segments: DataFrame
    issues: DataFrame
    places: DataFrame | None
    overrides: DataFrame | None


def _dealt(rows: DataFrame) -> DataFrame:
    """Data rows dealt over all tasks before they are mapped: adaptive execution makes the tasks of their joins few.

    The keys stand in another order than in those joins, as Spark leaves out a second shuffle by the same keys."""
    return deal_out(rows, "row_no", "submission_id")


def read_cells(cells: DataFrame, meta: DataFrame, fmt: Format, workbook_credit_types: bool = False) -> Intake:
    """The cell table of a reader (see sources.workbooks.CELL_SCHEMA, with submission_id for path) as what a conversion needs.

    ``workbook_credit_types``: credit types resolve through each workbook's own lookup sheet instead of the published catalogue."""
    # One task wrote and read most of the cells of a large sheet, whatever the number of tasks after it.
    values = cut(deal_out(sheets.normal_cells(cells), "submission_id", "sheet", "row_no"), "values")
    issues = unreadable_issues(cells, fmt).unionByName(odd_cell_issues(cells, fmt))
    spec = fmt.flat_sheet
    if spec is None:
        parts = [segment_sheet(sheets.segment_table(values, seg), fmt, seg.tag) for seg in fmt.body]
        return Intake(union_sheets(*parts), issues, None, None)
    issues = issues.unionByName(sheets.missing_sheet_issues(cells, values, fmt))
    if spec.match == "prefix":
        lookup = credit_type_lookup(values) if workbook_credit_types else None
        segments = explode_book(_dealt(sheets.master_book(values, spec)), fmt, lookup)
    elif spec.match == "letter":
        segments = explode_form(_dealt(sheets.data_rows(values, spec)), meta)
    else:
        segments = flat_records(_dealt(sheets.data_rows(values, spec)), fmt)
    return Intake(segments, issues, sheets.field_places(values, spec), sheets.header_overrides(values, fmt))


def convert_cells(cells: DataFrame, meta: DataFrame, fmt: Format, *, emit_with_errors: bool = False, rules: Rules = Rules(), own: Sequence[Rule] = (),
                  workbook_credit_types: bool = False) -> Conversion:
    taken = read_cells(cells, meta, fmt, workbook_credit_types)
    return convert_batch(taken.segments, meta, fmt, emit_with_errors=emit_with_errors, overrides=taken.overrides, places=taken.places,
                         reader_issues=taken.issues, rules=rules, own=own)


def convert_workbooks(spark: SparkSession, folder: str, meta: DataFrame, fmt: Format, **options) -> Conversion:
    """Issues with their cells, gate, counts and records of every workbook in a folder; ``options`` as in ``convert_cells``."""
    return convert_cells(read_workbook_cells(spark, folder), meta, fmt, **options)
