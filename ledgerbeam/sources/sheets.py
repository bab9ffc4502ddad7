"""Finding the data inside a cell table: sheets, header rows and column bindings, for many workbooks at once.

Every step is keyed by workbook (and sheet, row or column), so a batch of workbooks spreads over the cluster;
label lists come from the layout and are fixed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.amounts import number_text
from ..functions.dates import date_from_number, date_from_text, ddmmyyyy
from ..functions.text import BLANKS, clean, column_letter, header_fold, header_text, letter_column
from ..operators.cross_rows import whole_file_issues
from ..operators.guarantors import unpivot_guarantors
from ..operators.partitioning import SUBMISSION_SALTS, small_enough
from ..specs.consumer import FORM_HEADER_LABELS
from ..specs.model import FlatSheet, Format, Segment

# Control columns of segment sheets.
ACCOUNT_HEADERS = ("a/c no.", "a/c no", "acno", "a/c number", "borrower id", "borrower key")
FLAG_HEADERS = ("flag",)
HEADER_SCAN, FORM_SCAN, BLOCK_SCAN = 25, 200, 50


def normal_cells(cells: DataFrame) -> DataFrame:
    """Adds ``value``: trimmed text, numbers without exponent, dates as DDMMYYYY; blank cells and the marks of
    unreadable workbooks are dropped."""
    text = F.when(F.col("kind") == "d", ddmmyyyy(date_from_number(F.col("raw_n")))).when(
        F.col("kind") == "n", number_text(F.col("raw_s"))).otherwise(F.btrim("raw_s", F.lit(BLANKS)))
    return cells.withColumn("value", text).filter("value <> '' and kind not in ('unreadable', 'sheet')")


def _labels(spark: SparkSession, spec: FlatSheet) -> DataFrame:
    """(label, key, ord): what header cells are compared with."""
    fold = header_fold if spec.match == "prefix" else header_text
    rows = [(h, k, i) for i, (h, k) in enumerate(spec.headers.items())]
    df = spark.createDataFrame(rows, "header string, key string, ord int")
    return df.select(fold(F.col("header")).alias("label"), "key", "ord")


def _matches(spec: FlatSheet, header: Column, label: Column) -> Column:
    return header.startswith(label) if spec.match == "prefix" else header == label


def header_scores(cells: DataFrame, spec: FlatSheet, scan: int | None = None) -> DataFrame:
    """Distinct labels matched by each of the top rows of each sheet."""
    limit = scan or (HEADER_SCAN if spec.match == "prefix" else FORM_SCAN)
    fold = header_fold if spec.match == "prefix" else header_text
    top = cells.filter(F.col("row_no") <= limit).select(
        "submission_id", "sheet", "sheet_ord", "row_no", fold(F.col("value")).alias("header"))
    labels = F.broadcast(_labels(cells.sparkSession, spec))  # fixed by the layout, under a hundred rows
    counted = F.col("label") if spec.match == "prefix" else F.col("key")
    hits = top.join(labels, _matches(spec, F.col("header"), F.col("label")))
    return hits.groupBy("submission_id", "sheet", "sheet_ord", "row_no").agg(F.count_distinct(counted).alias("score"))


def resolve_sheets(cells: DataFrame, spec: FlatSheet) -> DataFrame:
    """The data sheet of each workbook: by name, else by content (header match of at least three labels), else
    for layouts without header text the first sheet that holds cells.  Unresolved workbooks are absent."""
    sheets = cells.groupBy("submission_id", "sheet", "sheet_ord").agg(F.count(F.lit(1)).alias("cells"))
    named = F.lower("sheet") == spec.sheet.lower()
    if spec.match == "prefix":
        best = header_scores(cells, spec).groupBy("submission_id", "sheet").agg(F.max("score").alias("score"))
        sheets = sheets.join(best, ["submission_id", "sheet"], "left")
        fits = named | (F.coalesce("score", F.lit(0)) >= min(3, len(spec.headers)))
    else:
        sheets, fits = sheets.withColumn("score", F.lit(0)), F.lit(True)
    rank = F.struct(named.cast("int").alias("named"), F.coalesce("score", F.lit(0)).alias("score"), (-F.col("sheet_ord")).alias("o"))
    return sheets.filter(fits).groupBy("submission_id").agg(F.max_by("sheet", rank).alias("sheet"))


def header_rows(cells: DataFrame, spec: FlatSheet) -> DataFrame:
    """Header row of each workbook's data sheet: best score, the configured row on ties, then the first."""
    sheets = resolve_sheets(cells, spec)
    if spec.match == "letter":
        return sheets.withColumn("header_row", F.lit(spec.header_row).cast("bigint"))
    scores = header_scores(cells, spec).join(sheets, ["submission_id", "sheet"])
    rank = F.struct("score", (F.col("row_no") == spec.header_row).cast("int").alias("p"), (-F.col("row_no")).alias("first"))
    best = scores.groupBy("submission_id", "sheet").agg(F.max_by("row_no", rank).alias("header_row"))
    return sheets.join(best, ["submission_id", "sheet"], "left").withColumn(
        "header_row", F.coalesce("header_row", F.lit(spec.header_row)).cast("bigint"))


def bind_columns(cells: DataFrame, spec: FlatSheet) -> DataFrame:
    """(submission_id, sheet, header_row, col_no, key): which input each column feeds.

    Prefix layouts take the longest header that starts with the label, leftmost on ties; a later label wins a
    contested column or input.  Letters bind only inputs no header can name."""
    spark = cells.sparkSession
    heads = header_rows(cells, spec)
    at = ["submission_id", "sheet", "header_row"]
    letters = [(letter_column(a), k) for a, k in spec.letters.items() if k not in set(spec.headers.values())]
    fixed = spark.createDataFrame(letters, "col_no int, key string") if letters else None
    out = heads.crossJoin(F.broadcast(fixed)) if fixed is not None else None  # one row per layout column
    if spec.match != "letter":
        fold = header_fold if spec.match == "prefix" else header_text
        row = cells.join(heads, ["submission_id", "sheet"]).filter("row_no = header_row").select(
            *at, "col_no", fold(F.col("value")).alias("header"))
        hits = row.join(F.broadcast(_labels(spark, spec)), _matches(spec, F.col("header"), F.col("label")))
        rank = F.struct(F.length("header").alias("l"), (-F.col("col_no")).alias("c"))
        bound = hits.groupBy(*at, "label", "key", "ord").agg(F.max_by("col_no", rank).alias("col_no"))
        bound = bound.groupBy(*at, "col_no").agg(F.max_by("key", "ord").alias("key")) if spec.match == "prefix" \
            else bound.groupBy(*at, "col_no").agg(F.min_by("key", "ord").alias("key"))
        bound = bound.select(*at, "col_no", "key")
        out = bound if out is None else bound.unionByName(out.select(*bound.columns))
    return out.select(*at, "col_no", "key")


def data_rows(cells: DataFrame, spec: FlatSheet) -> DataFrame:
    """One row per data row with a text column per input; rows without any bound value do not appear.

    Numbers under date inputs are read as serials or typed digits."""
    bound = bind_columns(cells, spec)
    joined = cells.join(bound, ["submission_id", "sheet", "col_no"]).filter("row_no > header_row")
    dated = F.col("key").isin(*spec.date_keys) & (F.col("kind") == "n")
    value = F.when(dated, ddmmyyyy(date_from_number(F.col("raw_n")))).otherwise(F.col("value"))
    keys = sorted(set(spec.headers.values()) | set(spec.letters.values()))
    return joined.withColumn("value", value).groupBy("submission_id", "row_no").agg(
        *[F.max(F.when(F.col("key") == k, F.col("value"))).alias(k) for k in keys])


def guarantor_rows(cells: DataFrame, spec: FlatSheet) -> DataFrame:
    """array of guarantor blocks per data row, from the repeated column groups right of the first
    'Guarantor Type' header."""
    heads = header_rows(cells, spec)
    placed = cells.join(heads, ["submission_id", "sheet"])
    header = placed.filter("row_no = header_row").select("submission_id", "col_no", F.col("value").alias("header"))
    values = placed.filter("row_no > header_row").select("submission_id", "row_no", "col_no", "value")
    # A blank type cell still starts its block, so start columns are added to every row.
    starts = header.filter(header_text(F.col("header")).startswith("guarantor type"))
    rows = values.select("submission_id", "row_no").distinct()
    blank = rows.join(starts, "submission_id").join(
        values.select("submission_id", "row_no", "col_no"), ["submission_id", "row_no", "col_no"], "left_anti")
    cells_ = values.join(header, ["submission_id", "col_no"]).unionByName(
        blank.withColumn("value", F.lit(None).cast("string")))
    blocks = unpivot_guarantors(cells_)
    names = [c for c in blocks.columns if c not in ("submission_id", "row_no", "block")]
    return blocks.groupBy("submission_id", "row_no").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("block", *names))),  # bounded by the columns of one row
                    lambda b: F.struct(*[b[n].alias(n) for n in names])).alias("guarantors"))


def master_book(cells: DataFrame, spec: FlatSheet) -> DataFrame:
    return data_rows(cells, spec).join(guarantor_rows(cells, spec), ["submission_id", "row_no"], "left")


def header_overrides(cells: DataFrame, fmt: Format) -> DataFrame:
    """Run parameters typed in the sheet's top rows.  A member id counts only beside a 'member' label; dates only
    if they parse.  Single-record forms also find their header block by its labels."""
    spec = fmt.flat_sheet
    sheets = resolve_sheets(cells, spec) if spec.match == "exact" else \
        cells.filter(F.lower("sheet") == spec.sheet.lower()).select("submission_id", "sheet").distinct()
    top = cells.join(sheets, ["submission_id", "sheet"]).filter(F.col("row_no") <= BLOCK_SCAN)

    def as_date(c: Column, kind: Column, number: Column) -> Column:
        return F.when(kind == "n", date_from_number(number)).otherwise(date_from_text(c))

    picks, label_rows = [], {}
    for address, name in spec.header_cells.items():
        letters, row = address.rstrip("0123456789"), int(address.lstrip("ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
        hit = (F.col("row_no") == row) & (F.col("col_no") == letter_column(letters))
        value = as_date(F.col("value"), F.col("kind"), F.col("raw_n")) if name.endswith("_date") else clean(F.col("value"))
        picks.append(F.max(F.when(hit, value)).alias(name))
        if name == "member_id":
            label_rows[name] = row
    labels = [F.max(F.when((F.col("row_no") == r) & (F.col("col_no") == 1), F.col("value"))).alias("_label") for r in label_rows.values()]
    out = top.groupBy("submission_id").agg(*picks, *labels)
    if label_rows:
        out = out.withColumn("member_id", F.when(F.col("_label").rlike("(?i)member"), F.col("member_id"))).drop("_label")
    if spec.match == "exact":
        block = _labelled_block(top, as_date)
        side = block.select("submission_id", *[F.col(c).alias(f"_b_{c}") for c in block.columns[1:]])
        out = out.join(side, "submission_id", "left").select("submission_id", *[
            F.coalesce(c, f"_b_{c}").alias(c) for c in out.columns if c != "submission_id"])
    return out


def _labelled_block(top: DataFrame, as_date) -> DataFrame:
    """Header values found under their labels, wherever the block stands in the top rows."""
    labelled = top.withColumn("label", header_text(F.col("value"))).filter(F.col("label").isin(*FORM_HEADER_LABELS))
    rank = F.struct("score", (-F.col("row_no")).alias("first"))
    best = labelled.groupBy("submission_id", "row_no").agg(F.count_distinct("label").alias("score")).groupBy("submission_id").agg(
        F.max_by("row_no", rank).alias("label_row"))
    placed = labelled.join(best, "submission_id").filter("row_no = label_row").select("submission_id", "col_no", "label", "label_row")
    values = top.select("submission_id", F.col("row_no").alias("v_row"), "col_no", "value", "kind", "raw_n")
    found = placed.join(values, ["submission_id", "col_no"]).filter("v_row = label_row + 1")
    return found.groupBy("submission_id").agg(*[
        F.max(F.when(F.col("label") == label, as_date(F.col("value"), F.col("kind"), F.col("raw_n"))
                     if name.endswith("_date") else F.col("value"))).alias(name)
        for label, name in FORM_HEADER_LABELS.items()])


def segment_table(cells: DataFrame, seg: Segment) -> DataFrame:
    """One sheet per segment: row 1 holds labels, control columns give account key and order."""
    spark = cells.sparkSession
    names = [(n, f.key, i) for i, f in enumerate(seg.fields) for n in (f.label, f.key, *f.aliases)]
    names += [(n, "ac_no", -2) for n in ACCOUNT_HEADERS] + [(n, "flag", -1) for n in FLAG_HEADERS]
    labels = spark.createDataFrame(names, "header string, key string, ord int").select(
        header_text(F.col("header")).alias("header"), "key", "ord")
    labels = labels.groupBy("header").agg(F.min_by("key", "ord").alias("key"))  # the first field with a label wins
    sheet = cells.filter(F.lower("sheet") == (seg.sheet or seg.tag).lower())
    heads = sheet.filter("row_no = 1").select("submission_id", "col_no", header_text(F.col("value")).alias("header"))
    bound = heads.join(F.broadcast(labels), "header").select("submission_id", "col_no", "key")
    keyed = bound.groupBy("submission_id").agg(F.bool_or(F.col("key") == "ac_no").alias("_keyed"))
    rows = sheet.filter("row_no > 1").join(bound.join(keyed, "submission_id"), ["submission_id", "col_no"])
    dates = [f.key for f in seg.fields if f.kind == "date"]
    value = F.when(F.col("key").isin(*dates) & (F.col("kind") == "n"), ddmmyyyy(date_from_number(F.col("raw_n")))).otherwise(
        F.col("value")) if dates else F.col("value")
    keys = ["ac_no", "flag", *[f.key for f in seg.fields if f.key != "_tag"]]
    out = rows.withColumn("value", value).groupBy("submission_id", "row_no").agg(
        F.bool_or("_keyed").alias("_keyed"), *[F.max(F.when(F.col("key") == k, F.col("value"))).alias(k) for k in keys])
    # each row of a workbook without the account column is a borrower of its own
    own = F.when(F.col("_keyed"), F.col("ac_no")).otherwise(F.concat(F.lit("row"), F.col("row_no")))
    return out.withColumn("ac_no", own).drop("_keyed")


def field_places(cells: DataFrame, spec: FlatSheet) -> DataFrame:
    """(submission_id, field_key, column): the letter of the column behind each input, and behind each derived field that of the
    first input it has; one row a field of a submission."""
    bound = bind_columns(cells, spec).select("submission_id", F.col("key").alias("field_key"), "col_no")
    if spec.sources:
        rows = [(wire, k, key) for wire, keys in spec.sources.items() for k, key in enumerate(keys)]
        wires = cells.sparkSession.createDataFrame(rows, "wire string, ord int, field_key string")
        derived = bound.join(F.broadcast(wires), "field_key").groupBy("submission_id", "wire").agg(F.min_by("col_no", "ord").alias("col_no"))
        derived = derived.select("submission_id", F.col("wire").alias("field_key"), "col_no")
        bound = bound.join(derived, ["submission_id", "field_key"], "left_anti").unionByName(derived)
    return bound.select("submission_id", "field_key", column_letter(F.col("col_no")).alias("column"))


def located(issues: DataFrame, places: DataFrame) -> DataFrame:
    """Issues with the sheet column of their field in their own workbook.  A field that a third of all issues is about is spread by
    salts; small relations are broadcast after a count."""
    named = places.withColumnRenamed("column", "_column")
    keys = ["submission_id", "field_key"]
    if small_enough(named):
        joined = issues.join(F.broadcast(named), keys, "left")
    else:
        salted = named.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SUBMISSION_SALTS - 1))))
        joined = issues.withColumn("_salt", F.pmod(F.xxhash64("row_number", "tag", "message"), F.lit(SUBMISSION_SALTS)).cast("int"))
        joined = joined.join(salted, [*keys, "_salt"], "left")
    on_row = F.when(F.col("row_number") > 0, F.col("_column"))
    return joined.withColumn("column", F.coalesce("column", on_row)).select(*issues.columns)


def sheets_seen(cells: DataFrame) -> DataFrame:
    """(submission_id, seen): the sheets of each workbook in their order, quoted; a name needs no cells to be seen."""
    names = cells.filter(F.col("sheet").isNotNull()).groupBy("submission_id", "sheet").agg(F.min("sheet_ord").alias("o"))
    listed = names.groupBy("submission_id").agg(F.array_sort(F.collect_list(F.struct("o", "sheet"))).alias("s"))  # sheets of one workbook
    return listed.select("submission_id", F.array_join(F.transform("s", lambda x: F.concat(F.lit('"'), x["sheet"], F.lit('"'))), ", ").alias("seen"))


def missing_sheet_issues(cells: DataFrame, values: DataFrame, fmt: Format) -> DataFrame:
    """One finding, which no one may let through, for each workbook without the layout's data sheet; it names the sheets seen.

    ``cells`` are a reader's, ``values`` the same after ``normal_cells``."""
    spec = fmt.flat_sheet
    found = resolve_sheets(values, spec).select("submission_id")
    lost = sheets_seen(cells).join(found, "submission_id", "left_anti")
    wanted = ", ".join(f'"{h}"' for h in list(spec.headers)[:3])
    hint = f" (such as {wanted})" if spec.match == "prefix" and wanted else ""
    text = F.concat(F.lit(f'No sheet is named "{spec.sheet}" or holds its columns{hint}; sheets seen: '), F.col("seen"), F.lit("."))
    return whole_file_issues(lost.withColumns({"sheet": F.lit(None).cast("string"), "row_no": F.lit(None).cast("long")}), fmt, text)
