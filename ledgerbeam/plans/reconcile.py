"""Regenerate a batch with errors let through where they may be, and compare it with the filed files."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.assemble import RECORD_ORDER, physical_records
from ..operators.partitioning import cut
from ..operators.reconcile import (compare_bytes, compare_lines, comparison_summary, even_line_ends, file_lengths, first_differences,
                                   first_lines, line_differences, placed_blocks, placed_lines)
from ..sources.bureau_files import PIECE_ORDER
from ..specs.model import Format
from .convert import Conversion, convert_batch


class Reconciliation(NamedTuple):
    verdicts: DataFrame
    differences: DataFrame
    conversion: Conversion


def reconcile(segments: DataFrame, meta: DataFrame, fmt: Format, filed_lines: DataFrame, ignore_eol: bool = False, **options) -> Reconciliation:
    """``filed_lines`` comes from bureau_files.read_lines.  Gated submissions are reported as CANNOT COMPARE.

    Line ends and the end of the file count unless ``ignore_eol`` makes CRLF and LF alike.  A layout of one line is compared
    in blocks of bytes, and its differences are on line 1."""
    done = convert_batch(segments, meta, fmt, emit_with_errors=True, **options)
    end = F.regexp_extract("text", r"\r?\n$", 0)
    text = physical_records(done.records, fmt, done.small).withColumn("eol", end)
    gen = text.select("submission_id", *RECORD_ORDER, F.expr("left(text, length(text) - length(eol))").alias("line"), "eol")
    filed = filed_lines.select("submission_id", *PIECE_ORDER, "line", "eol")
    lengths = file_lengths(gen), file_lengths(filed)
    place = placed_blocks if fmt.one_physical_line else placed_lines
    sides = [(even_line_ends(side) if ignore_eol else side, order) for side, order in ((gen, RECORD_ORDER), (filed, PIECE_ORDER))]
    differing = cut(compare_lines(*[place(side, order) for side, order in sides]), "differing-lines")
    counts, shown = line_differences(differing), compare_bytes(first_lines(differing))
    if fmt.one_physical_line:
        counts = counts.withColumn("first", F.struct("first.offset", F.lit(1).alias("line_no"), (F.col("first.offset") + 1).alias("col_no")))
        shown = shown.withColumns({"line_no": F.lit(1), "col_no": F.col("offset") + 1})
    summary = comparison_summary(*lengths, counts, ignore_eol=ignore_eol)
    gated = done.gate.filter("not passes").select("submission_id")
    verdicts = done.gate.filter("passes").select("submission_id").join(summary, "submission_id", "left").withColumn(
        "verdict", F.when(F.col("match"), "MATCH").otherwise("MISMATCH")).unionByName(
        gated.withColumn("verdict", F.lit("CANNOT COMPARE")), allowMissingColumns=True)
    return Reconciliation(verdicts, first_differences(shown), done)
