"""Comparison of generated records with a filed file, line by line and then byte by byte."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import printable
from .partitioning import in_blocks, running

MAX_DIFFS, RADIUS = 50, 24
# Bytes of a block of a one-line file.
BLOCK = 4096


def placed_lines(lines: DataFrame, order: Sequence[str]) -> DataFrame:
    """1-based line numbers and 0-based byte offsets of lines with their real ends (``line``, ``eol``).

    One character is one byte in these files."""
    out = running(in_blocks(lines, order), order, line_no=F.lit(1), offset=F.length("line") + F.length("eol"))
    return out.select("submission_id", (F.col("line_no") + 1).alias("line_no"), "offset", "line", "eol")


def placed_blocks(pieces: DataFrame, order: Sequence[str], size: int = BLOCK) -> DataFrame:
    """The bytes of files that are one line, cut into blocks of ``size`` that stand in for lines.

    A piece is spread over the blocks it covers, so neither side's own cuts matter and no row grows with the file."""
    whole = pieces.withColumn("line", F.concat("line", "eol")).withColumn("eol", F.lit("")).filter("line <> ''")
    at = placed_lines(whole, order)
    first = F.floor(F.col("offset") / size)
    last = F.floor((F.col("offset") + F.length("line") - 1) / size)
    parts = at.select("submission_id", "offset", "line", F.explode(F.sequence(first, last)).alias("block"))
    start = F.greatest(F.col("block") * size - F.col("offset"), F.lit(0))
    stop = F.least((F.col("block") + 1) * size - F.col("offset"), F.length("line"))
    part = F.struct("offset", F.substring("line", (start + 1).cast("int"), (stop - start).cast("int")).alias("text"))
    blocks = parts.groupBy("submission_id", "block").agg(F.array_sort(F.collect_list(part)).alias("parts"))  # ``size`` bytes at most
    return blocks.select("submission_id", (F.col("block") + 1).alias("line_no"), (F.col("block") * size).alias("offset"),
                         F.array_join("parts.text", "").alias("line"), F.lit("").alias("eol"))


def compare_lines(generated: DataFrame, filed: DataFrame) -> DataFrame:
    """Lines that differ in text or line end, by position; a line missing on one side is NULL there.  An inserted line
    shifts all later ones, exactly as in a positional comparison."""
    g, f = (side.select("submission_id", "line_no", F.col("line").alias(name), F.col("eol").alias(f"{name}_eol"),
                        F.col("offset").alias(f"{name}_offset")) for side, name in ((generated, "expected"), (filed, "actual")))
    same = F.col("expected").eqNullSafe(F.col("actual")) & F.col("expected_eol").eqNullSafe(F.col("actual_eol"))
    both = g.join(f, ["submission_id", "line_no"], "full_outer").filter(~same)
    return both.select("submission_id", "line_no", F.coalesce("expected_offset", "actual_offset").alias("offset"), "expected", "actual",
                       "expected_eol", "actual_eol")


def _differing() -> Column:
    """(col_no, expected, actual) of the bytes that differ in a line.  Line ends are held against each other behind the longer text."""
    def chars(c: str) -> Column:
        text = F.coalesce(F.col(c), F.lit(""))
        return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, ""))

    def pairs(ending: str) -> Column:
        return F.zip_with(chars(f"expected{ending}"), chars(f"actual{ending}"), lambda e, a: F.struct(e.alias("e"), a.alias("a")))

    placed = F.transform(F.concat(pairs(""), pairs("_eol")), lambda p, i: F.struct(
        (i + 1).alias("col_no"), p["e"].alias("expected"), p["a"].alias("actual")))
    return F.filter(placed, lambda p: ~p["expected"].eqNullSafe(p["actual"]))


def line_differences(differing: DataFrame) -> DataFrame:
    """A row per differing line: how many of its bytes differ (``n``) and the place of the first."""
    found = differing.withColumn("bytes", _differing())
    first = F.get("bytes", F.lit(0))["col_no"]
    return found.select("submission_id", F.size("bytes").alias("n"), F.struct(
        (F.col("offset") + first - 1).alias("offset"), "line_no", first.alias("col_no")).alias("first"))


def compare_bytes(differing: DataFrame) -> DataFrame:
    """Every differing byte of the differing lines with a printable context."""
    rows = differing.select("submission_id", "line_no", "offset", "expected", "actual", F.explode(_differing()).alias("b"))
    rows = rows.withColumn("col_no", F.col("b.col_no"))

    def context(c: str):
        start = F.greatest(F.col("col_no") - RADIUS, F.lit(1))
        return printable(F.substring(F.coalesce(F.col(c), F.lit("")), start, F.col("col_no") + RADIUS - start))

    return rows.select("submission_id", (F.col("offset") + F.col("col_no") - 1).alias("offset"), "line_no", "col_no",
                       F.ascii("b.expected").alias("expected"), F.ascii("b.actual").alias("actual"),
                       context("expected").alias("expected_context"), context("actual").alias("actual_context"))


def first_lines(differing: DataFrame, limit: int = MAX_DIFFS) -> DataFrame:
    """As many differing lines of each submission as can hold its first ``limit`` differences."""
    w = Window.partitionBy("submission_id").orderBy("line_no")
    return differing.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= limit).drop("_n")


def first_differences(diffs: DataFrame, limit: int = MAX_DIFFS) -> DataFrame:
    """The first ``limit`` differences of each submission, the report's length; the summary counts them all."""
    w = Window.partitionBy("submission_id").orderBy("offset", "line_no", "col_no")
    return diffs.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= limit)


def file_lengths(lines: DataFrame) -> DataFrame:
    return lines.groupBy("submission_id").agg(F.sum(F.length("line") + F.length("eol")).cast("bigint").alias("bytes"))


def even_line_ends(lines: DataFrame) -> DataFrame:
    """Lines whose ends no longer tell CRLF from LF; a missing end stays missing."""
    return lines.withColumn("eol", F.when(F.col("eol") != "", "\n").otherwise(F.col("eol")))


def comparison_summary(generated: DataFrame, filed: DataFrame, diffs: DataFrame, limit: int = MAX_DIFFS,
                       ignore_eol: bool = False) -> DataFrame:
    """One verdict per submission from the two lengths (submission_id, bytes) and ``line_differences``."""
    found = diffs.groupBy("submission_id").agg(F.sum("n").alias("n"), F.min("first").alias("first"))
    g = generated.select("submission_id", F.col("bytes").alias("generated_length"))
    r = filed.select("submission_id", F.col("bytes").alias("reference_length"))
    out = g.join(r, "submission_id", "full_outer").join(found, "submission_id", "left")
    out = out.select("submission_id", *[F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in (
        "generated_length", "reference_length")], F.coalesce("n", F.lit(0).cast("bigint")).alias("n"), "first")
    same_size = F.lit(True) if ignore_eol else F.col("generated_length") == F.col("reference_length")
    match = (F.col("n") == 0) & same_size
    shown = F.when(F.col("n") > limit, F.lit(f"{limit}+")).otherwise(F.col("n").cast("string"))
    sizes = [F.col("generated_length").cast("string"), F.col("reference_length").cast("string")]
    text = (
        F.when(match & F.lit(ignore_eol), F.concat(F.lit("Content match apart from line ends ("), sizes[0], F.lit(" vs "),
                                                   sizes[1], F.lit(" bytes).")))
        .when(match, F.concat(F.lit("Byte-exact match, "), sizes[0], F.lit(" bytes.")))
        .when(F.col("n") == 0, F.concat(F.lit("Lengths differ (generated "), sizes[0], F.lit(", reference "), sizes[1],
                                        F.lit(" bytes).")))
        .otherwise(F.concat(F.lit("Files differ: "), shown, F.lit(" byte positions; first at offset "),
                            F.col("first.offset").cast("string"), F.lit(" (line "), F.col("first.line_no").cast("string"),
                            F.lit(", col "), F.col("first.col_no").cast("string"), F.lit(").")))
    )
    return out.select("submission_id", match.alias("match"), "generated_length", "reference_length",
                      F.least(F.col("n"), F.lit(limit)).cast("bigint").alias("diff_count"), (F.col("n") > limit).alias("truncated"),
                      text.alias("summary"))
