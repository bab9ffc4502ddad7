"""Batch conversion: map → check → gate → encode → order."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean
from ..operators.assemble import apply_overrides, assemble, file_counts
from ..operators.cross_rows import borrower_issues, duplicate_issues, empty_issues
from ..operators.encode import encode_rows
from ..operators.gate import gate
from ..operators.partitioning import by_submission, cut, small_enough
from ..operators.rules import Rule, own_issues
from ..operators.segments import ORDER
from ..operators.validate import Rules, field_issues, row_issues
from ..sources.sheets import located
from ..specs.model import Format


class Conversion(NamedTuple):
    issues: DataFrame
    gate: DataFrame
    counts: DataFrame
    records: DataFrame
    segments: DataFrame
    small: bool


def stamp_member(segments: DataFrame, meta: DataFrame, fmt: Format, small: bool) -> DataFrame:
    """The assigned member id replaces the one typed in the form, in the written record only."""
    if not fmt.member_field:
        return segments.withColumn("wire", F.col("values"))
    at = fmt.body[0].index(fmt.member_field)
    side = meta.select("submission_id", F.coalesce(clean(F.col("member_id")), F.lit("")).alias("_member"))
    rows = by_submission(segments, side, small, ORDER, "left")
    wire = F.transform(F.col("values"), lambda v, i: F.when(i == at, F.coalesce(F.col("_member"), v)).otherwise(v))
    return rows.withColumn("wire", wire).drop("_member")


def checked_segments(segments: DataFrame, fmt: Format, rules: Rules = Rules()) -> DataFrame:
    """Envelope plus ``issues`` and ``record``."""
    wire = F.col("wire") if "wire" in segments.columns else F.col("values")
    raw = segments.withColumns({"raw_issues": row_issues(fmt, rules), "record": encode_rows(fmt, wire)})
    # Several uses keep the checks a compiled projection of their own (see segments.spread).
    issues = F.when(F.size("raw_issues") > 0, F.array_compact("raw_issues")).otherwise(F.col("raw_issues"))
    return raw.withColumn("issues", issues).drop("wire", "notes", "raw_issues")


def all_issues(checked: DataFrame, meta: DataFrame, fmt: Format, own: Sequence[Rule] = ()) -> DataFrame:
    """Mapping and field findings, borrower findings, file findings, those of a lender's own rules and empty submissions, as one table."""
    known = checked.filter(F.col("tag").isin(*[s.tag for s in fmt.body]))
    out = field_issues(known).unionByName(borrower_issues(checked, fmt))
    if fmt.account_rule:
        out = out.unionByName(duplicate_issues(checked, fmt))
    if own:
        out = out.unionByName(own_issues(checked, fmt, own))
    return out.unionByName(empty_issues(meta, checked, fmt))


def convert_batch(segments: DataFrame, meta: DataFrame, fmt: Format, *, emit_with_errors: bool = False,
                  overrides: DataFrame | None = None, places: DataFrame | None = None,
                  reader_issues: DataFrame | None = None, rules: Rules = Rules(), own: Sequence[Rule] = (),
                  written_cut: bool = True) -> Conversion:
    """Convert every submission of a batch.

    ``segments`` is an envelope (see operators.segments) and ``meta`` holds one row per submission.  Batches from workbooks
    go through ``plans.intake``, which brings the findings of the reader, the header cells and the ``places`` of fields in the
    sheets; ``reader_issues`` and findings of ``own`` rules (see operators.rules) count in the gate as all others do.  The mapped, checked and encoded rows are written once to the shared folder; counts, issues, gate and records then read
    only the columns they need from it."""
    small = small_enough(meta.select("submission_id"))
    effective = apply_overrides(meta, overrides)
    checked = checked_segments(stamp_member(segments, effective, fmt, small), fmt, rules)
    if written_cut:
        checked = cut(checked, "checked")
    issues = all_issues(checked, meta, fmt, own)
    if places is not None:
        issues = located(issues, places)
    if reader_issues is not None:
        issues = issues.unionByName(reader_issues)
    if written_cut:
        issues = cut(issues, "issues")
    gated = gate(meta, issues, emit_with_errors)
    passing = gated.filter("passes").select("submission_id")
    counts = file_counts(checked, fmt)
    body = by_submission(checked, passing, small, ORDER, "left_semi")
    records = assemble(body, effective.join(passing, "submission_id", "left_semi"), counts, fmt, small)
    return Conversion(issues, gated, counts, records, checked, small)
