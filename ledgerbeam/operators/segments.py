"""The common record envelope: one row per segment, values as formatted text in layout order."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.amounts import number_text
from ..functions.dates import typed_date_text
from ..functions.text import clean
from ..specs.model import DATE, NUMBER, Format, Segment
from .partitioning import attach, cut, group_value

NOTE_TYPE = "array<struct<field_key:string,message:string,severity:string,rule:string,bypassable:boolean>>"
# Position of a segment inside its file, most significant first.
ORDER = ("first_ord", "flag", "spec_ord", "seq")
ENVELOPE = ("submission_id", "ac_no", "row_no", "first_ord", "tag", "sheet", "flag", "spec_ord", "seq", "values", "notes")
# Stride that keeps (sheet ordinal, row) comparable as one number.
SHEET_STRIDE = 1 << 40


def note(field_key: str, message: Column, severity: str = "error", rule: str = "lookup", bypassable: bool = True) -> Column:
    """A finding raised while mapping; NULL message means no finding."""
    return F.when(message.isNotNull(), F.struct(
        F.lit(field_key).alias("field_key"), message.alias("message"), F.lit(severity).alias("severity"),
        F.lit(rule).alias("rule"), F.lit(bypassable).alias("bypassable")))


def notes(*items: Column) -> Column:
    """Findings of one segment; NULL entries are dropped by ``spread``, so that building them stays compiled."""
    return F.array(*items).cast(NOTE_TYPE)


def values_of(seg: Segment, given: Mapping[str, Column]) -> Column:
    """Formatted values in layout order; blanks take the field's default."""
    unknown = set(given) - {f.key for f in seg.fields}
    if unknown:
        raise KeyError(f"{seg.tag} has no fields {sorted(unknown)}")
    constants = {d: F.lit(d) for d in {f.default for f in seg.fields}}
    return F.array(*[
        F.coalesce(given[f.key], constants[f.default]) if f.key in given else constants[f.default] for f in seg.fields
    ])


def segment(fmt: Format, tag: str, given: Mapping[str, Column], seq: int | Column = 0, found: Column | None = None) -> Column:
    """One segment as a struct, for row generators."""
    seg = fmt.segment(tag)
    return F.struct(
        F.lit(tag).alias("tag"), F.lit(seg.sheet or tag).alias("sheet"), F.lit(seg.flag).alias("flag"),
        F.lit(fmt.body.index(seg)).alias("spec_ord"),
        (seq.cast("bigint") if isinstance(seq, Column) else F.lit(seq).cast("bigint")).alias("seq"),
        values_of(seg, given).alias("values"),
        (found if found is not None else notes()).alias("notes"),
    )


def spread(rows: DataFrame, segments: Column) -> DataFrame:
    """Array of segment structs per source row to the envelope; the row is the borrower.

    Absent segments are NULL entries.  ``borrower_tags`` (on the first segment only) lets borrower-level rules run without a shuffle.  Every row has
    at least one segment; the outer form keeps the optimizer from pushing a size test on the whole mapping
    below the projections that build it."""
    present = F.array_compact("raw")
    return (
        rows.select("submission_id", F.concat(F.lit("r"), F.col("row_no")).alias("ac_no"),
                    F.col("row_no").cast("bigint").alias("row_no"), segments.alias("raw"))
        # Two uses of ``raw`` keep it a compiled projection of its own: functions over arrays interpret what they wrap.
        .select("submission_id", "ac_no", "row_no", present.alias("segs"),
                F.transform(present, lambda s: s["tag"]).alias("all_tags"))
        .select("submission_id", "ac_no", "row_no", "all_tags", F.posexplode_outer("segs").alias("pos", "s"))
        .select("submission_id", "ac_no", "row_no", F.col("row_no").alias("first_ord"), "s.tag", "s.sheet", "s.flag",
                "s.spec_ord", "s.seq", "s.values", F.array_compact("s.notes").alias("notes"),
                F.when(F.col("pos") == 0, F.col("all_tags")).alias("borrower_tags"))
    )


def envelope(parts: DataFrame, segments: Column, borrower_tags: Column) -> DataFrame:
    """Arrays of segment structs to the envelope, where the segments of a source row come from several rows; the row is the borrower.
    ``borrower_tags`` are the tags of all its segments, on the row that has its first segment first, elsewhere NULL."""
    return (
        parts.select("submission_id", "row_no", borrower_tags.alias("tags"), segments.alias("raw"))
        # Two uses of ``raw``, as in ``spread``.
        .select("submission_id", "row_no", F.array_compact("raw").alias("segs"), F.when(F.size("raw") > 0, F.col("tags")).alias("all_tags"))
        .select("submission_id", "row_no", "all_tags", F.posexplode_outer("segs").alias("pos", "s"))
        .select("submission_id", F.concat(F.lit("r"), F.col("row_no")).alias("ac_no"), "row_no", F.col("row_no").alias("first_ord"), "s.tag", "s.sheet", "s.flag",
                "s.spec_ord", "s.seq", "s.values", F.array_compact("s.notes").alias("notes"), F.when(F.col("pos") == 0, F.col("all_tags")).alias("borrower_tags"))
    )


def typed_value(c: Column, kind: str, dtype: T.DataType) -> Column:
    """A typed cell to the text the record carries."""
    if kind == DATE:
        return typed_date_text(c, dtype)
    if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return F.date_format(c, "ddMMyyyy")
    if kind == NUMBER or isinstance(dtype, T.NumericType):
        return number_text(c.cast("string"))
    return clean(c.cast("string"))


def cell_text(name: str) -> Column:
    """A named input column as trimmed one-line text, NULL when blank.

    Written as SQL text: intake has one of these per column, and text is far cheaper to build than expressions.  No function over
    arrays names the trimmed text, as it would be interpreted; compiled code works it out once."""
    trimmed = f"btrim(cast(`{name}` as string), '{SQL_BLANKS}')"
    broken = " or ".join(f"contains({trimmed}, '{mark}')" for mark in (r"\n", r"\r", r"\t"))
    return F.expr(f"case when {trimmed} = '' then null when {broken} then "
                  f"regexp_replace({trimmed}, '[ \\\\t]*[\\\\r\\\\n\\\\t]+[ \\\\t]*', ' ') else {trimmed} end")


SQL_BLANKS = r" \t\n\r\u000c\u000b\u00a0\ufeff"


def field_text(name: str, kind: str, dtype: T.DataType) -> Column:
    """``typed_value`` of a named column."""
    if kind not in (DATE, NUMBER) and isinstance(dtype, T.StringType):
        return F.expr(f"nullif(btrim(`{name}`, '{SQL_BLANKS}'), '')")
    return typed_value(F.col(name), kind, dtype)


def some_present(names: list[str]) -> Column:
    """Whether any of the named cells holds something."""
    return F.expr("coalesce(" + ", ".join(f"nullif(btrim(cast(`{n}` as string), '{SQL_BLANKS}'), '')" for n in names) + ") is not null")


def segment_sheet(df: DataFrame, fmt: Format, tag: str) -> DataFrame:
    """One input table per segment: columns named by field key, plus ``ac_no`` (or each row on its own),
    ``flag`` (or the layout's) and ``row_no``.  Rows whose bound cells are all blank are dropped."""
    seg = fmt.segment(tag)
    types = {f.name: f.dataType for f in df.schema.fields}
    bound = [f for f in seg.fields if f.key in types]
    given = {f.key: field_text(f.key, f.kind, types[f.key]) for f in bound}
    present = some_present([*[f.key for f in bound], *(["ac_no"] if "ac_no" in types else [])])
    flag = F.col("flag").try_cast("int") if "flag" in types else F.lit(None).cast("int")
    ac_no = F.coalesce(clean(F.col("ac_no").cast("string")), F.lit("")) if "ac_no" in types \
        else F.concat(F.lit("row"), F.col("row_no"))
    ord_ = fmt.body.index(seg)
    return df.filter(present).select(
        "submission_id", ac_no.alias("ac_no"), F.col("row_no").cast("bigint").alias("row_no"),
        F.lit(tag).alias("tag"), F.lit(seg.sheet or tag).alias("sheet"),
        F.coalesce(flag, F.lit(seg.flag)).alias("flag"), F.lit(ord_).alias("spec_ord"),
        (F.lit(ord_ * SHEET_STRIDE) + F.col("row_no").cast("bigint")).alias("seq"),
        values_of(seg, given).alias("values"), notes().alias("notes"))


def stack_sheets(*sheets: DataFrame) -> DataFrame:
    """All segment sheets of a batch, without the positions of borrowers: enough for counts, and nothing is shuffled."""
    rows = sheets[0]
    for s in sheets[1:]:
        rows = rows.unionByName(s)
    return rows


def union_sheets(*sheets: DataFrame) -> DataFrame:
    """All segment sheets of a batch, with each borrower's first-seen position as ``first_ord``.

    The sheets are read and mapped once, into a written cut; positions come from two of its columns."""
    rows = cut(stack_sheets(*sheets), "sheets")
    first = group_value(rows, ("submission_id", "ac_no"), F.min("seq").alias("first_ord"))
    return attach(rows, first, ("submission_id", "ac_no"), ("seq",)).select(*ENVELOPE)


def flat_records(df: DataFrame, fmt: Format) -> DataFrame:
    """Form input for a single-record layout: each row is one borrower and one record."""
    seg = fmt.body[0]
    types = {f.name: f.dataType for f in df.schema.fields}
    bound = [f for f in seg.fields if f.key in types]
    given = {f.key: field_text(f.key, f.kind, types[f.key]) for f in bound}
    rows = df.filter(some_present([f.key for f in bound]))
    return spread(rows, F.array(segment(fmt, seg.tag, given)))


def value(seg: Segment, key: str) -> Column:
    """A field of the envelope's ``values`` by key; NULL when blank."""
    return F.nullif(F.get(F.col("values"), F.lit(seg.index(key))), F.lit(""))


def as_columns(segments: DataFrame, seg: Segment) -> DataFrame:
    """Rows of one tag with every field as a named column."""
    return segments.filter(F.col("tag") == seg.tag).select(
        "submission_id", "ac_no", "row_no", *[F.get(F.col("values"), F.lit(i)).alias(f.key) for i, f in enumerate(seg.fields)])


def input_text(df: DataFrame, key: str) -> Column:
    """An input cell as trimmed one-line text; NULL when the sheet has no such column."""
    if key not in df.columns:
        return F.lit(None).cast("string")
    dtype = df.schema[key].dataType
    if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return F.date_format(F.col(key), "ddMMyyyy")
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return number_text(F.col(key).cast("string"))
    return cell_text(key)
