"""A folder of workbooks to one long cell table.

Each sheet of each workbook is a partition of its own: its task opens the file, reads the shared texts if the sheet has any, and
streams the rows out once.  Everything after that is column work."""

from __future__ import annotations

import re
import zipfile
import zlib
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from xml.etree import ElementTree

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.text import column_letter
from ..operators.cross_rows import whole_file_issues
from ..operators.partitioning import cut, small_enough
from ..specs.model import Format
from ..storage import filesystem, shared_path

CELL_SCHEMA = ("path string, sheet string, sheet_ord int, row_no bigint, col_no int, kind string, raw_s string, "
               "raw_n double")
_ARROW = pa.schema([("path", pa.string()), ("sheet", pa.string()), ("sheet_ord", pa.int32()), ("row_no", pa.int64()), ("col_no", pa.int32()),
                    ("kind", pa.string()), ("raw_s", pa.string()), ("raw_n", pa.float64())])
_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_DATE_FORMATS = {14, 15, 16, 17, 22}
_BATCH = 20_000
UNREADABLE, NOT_A_NUMBER, SHEET = "unreadable", "x", "sheet"
#: Workbooks whose lists of sheets are read at a time.
LISTING_THREADS = 32


def _texts(node) -> str:
    return "".join(t.text or "" for t in node.iter(f"{_NS}t"))


def _date_styles(book: zipfile.ZipFile) -> list[bool]:
    """Whether each cell style shows dates."""
    if "xl/styles.xml" not in book.namelist():
        return []
    root = ElementTree.fromstring(book.read("xl/styles.xml"))
    custom = {int(n.get("numFmtId")): re.sub(r'"[^"]*"|\[[^\]]*\]', "", n.get("formatCode") or "")
              for n in root.iter(f"{_NS}numFmt")}
    styles = root.find(f"{_NS}cellXfs")
    ids = [int(x.get("numFmtId") or 0) for x in styles] if styles is not None else []
    return [i in _DATE_FORMATS or bool(re.search("[dy]", custom.get(i, ""), re.IGNORECASE)) for i in ids]


def _column(ref: str) -> int:
    n = 0
    for ch in ref:
        if not ch.isalpha():
            break
        n = n * 26 + ord(ch.upper()) - 64
    return n


def _open(path: str) -> zipfile.ZipFile:
    files, inner = filesystem(path)
    return zipfile.ZipFile(files.open_input_file(inner))


def sheet_list(book: zipfile.ZipFile) -> list[tuple[str, int, str]]:
    """(name, position, part) of the sheets of a workbook."""
    rels = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    out = []
    for ord_, sheet in enumerate(ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{_NS}sheet")):
        target = rels[sheet.get(f"{_REL}id")].lstrip("/")
        out.append((sheet.get("name"), ord_, target if target.startswith("xl/") else f"xl/{target}"))
    return out


def _shared_texts(book: zipfile.ZipFile) -> pa.Array:
    """The workbook's shared texts, read once and kept as one compact array."""
    texts: list[str] = []
    chunks = []
    if "xl/sharedStrings.xml" in book.namelist():
        with book.open("xl/sharedStrings.xml") as xml:
            parents = []
            for event, node in ElementTree.iterparse(xml, events=("start", "end")):
                if event == "start":
                    parents.append(node)
                    continue
                parents.pop()
                if node.tag == f"{_NS}si":
                    texts.append(_texts(node))
                    parents[-1].clear()
                    if len(texts) == _BATCH:
                        chunks.append(pa.array(texts, pa.large_string()))
                        texts = []
    return pa.concat_arrays([*chunks, pa.array(texts, pa.large_string())])


def sheet_cells(book: zipfile.ZipFile, part: str) -> Iterator[tuple]:
    """(row, column, kind, text, number) of every non-empty cell of a sheet; formulas give their cached result.
    kind: s text, n number, d date serial, b boolean, x text where a number should be."""
    dates, shared = _date_styles(book), None
    with book.open(part) as xml:
        parents = []
        for event, row in ElementTree.iterparse(xml, events=("start", "end")):
            if event == "start":
                parents.append(row)
                continue
            parents.pop()
            if row.tag != f"{_NS}row":
                continue
            for c in row.iter(f"{_NS}c"):
                kind, v, inline = c.get("t") or "n", c.find(f"{_NS}v"), c.find(f"{_NS}is")
                text = v.text if v is not None else None
                number = None
                if inline is not None:
                    kind, text = "s", _texts(inline)
                elif text is None:
                    continue
                elif kind == "s":
                    shared = _shared_texts(book) if shared is None else shared
                    text = shared[int(text)].as_py()
                elif kind == "b":
                    text = "true" if text == "1" else "false"
                elif kind == "n":
                    style = int(c.get("s") or 0)
                    try:
                        number, kind = float(text), "d" if style < len(dates) and dates[style] else "n"
                    except ValueError:
                        kind = NOT_A_NUMBER
                else:
                    kind = "s"
                yield int(row.get("r")), _column(c.get("r")), kind, text, number
            parents[-1].clear()


_DAMAGE = (zipfile.BadZipFile, zlib.error, EOFError, KeyError, TypeError, AttributeError, ElementTree.ParseError, ValueError, IndexError,
           NotImplementedError, RuntimeError, pa.ArrowInvalid)


@dataclass
class SheetPart(InputPartition):
    """One sheet of one workbook, or what is wrong with the workbook."""

    path: str
    sheet: str | None = None
    ord: int | None = None
    part: str | None = None
    fault: str | None = None


class WorkbookReader(DataSourceReader):
    def __init__(self, folder: str):
        self.folder = folder

    def partitions(self) -> list[SheetPart]:
        """A partition for each sheet of each workbook; only the lists of sheets are read here."""
        files, inner = filesystem(self.folder)
        found = files.get_file_info(fs.FileSelector(inner, recursive=True))
        prefix = self.folder.rstrip("/")
        paths = sorted(f"{prefix}{f.path[len(inner.rstrip('/')):]}" for f in found if f.is_file and f.path.endswith(".xlsx"))

        def parts(path: str) -> list[SheetPart]:
            try:
                with _open(path) as book:
                    listed = sheet_list(book)
                return [SheetPart(path, *s) for s in listed] or [SheetPart(path, fault="it has no sheets")]
            except _DAMAGE as e:
                return [SheetPart(path, fault=f"{type(e).__name__}: {e}")]

        with ThreadPoolExecutor(LISTING_THREADS) as pool:
            return [p for ps in pool.map(parts, paths) for p in ps]

    def read(self, partition: SheetPart) -> Iterator[pa.RecordBatch]:
        head = (partition.path, partition.sheet, partition.ord)

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)

        if partition.fault:
            yield batch([(*head, None, None, UNREADABLE, partition.fault, None)])
            return
        rows: list[tuple] = [(*head, None, None, SHEET, None, None)]
        try:
            with _open(partition.path) as book:
                for cell in sheet_cells(book, partition.part):
                    rows.append((*head, *cell))
                    if len(rows) == _BATCH:
                        yield batch(rows)
                        rows = []
        except _DAMAGE as e:
            rows = [(*head, None, None, UNREADABLE, f"{type(e).__name__}: {e}", None)]
        if rows:
            yield batch(rows)


class WorkbookCells(DataSource):
    @classmethod
    def name(cls) -> str:
        return "workbook_cells"

    def schema(self) -> str:
        return CELL_SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return WorkbookReader(self.options["path"])


def unreadable_issues(cells: DataFrame, fmt: Format) -> DataFrame:
    """One finding, which no one may let through, for each workbook that could not be read to its end.

    ``cells`` is the table of read_workbook_cells; none of the cells of such a workbook are in it."""
    text = F.concat(F.lit("The workbook is damaged and none of it was taken over ("), F.col("raw_s"), F.lit(")."))
    return whole_file_issues(cells.filter(F.col("kind") == UNREADABLE), fmt, text)


def odd_cell_issues(cells: DataFrame, fmt: Format) -> DataFrame:
    """A warning for each cell that says it is a number but does not hold one; it is read as text."""
    at = F.concat(column_letter(F.col("col_no")), F.col("row_no").cast("string"))
    text = F.concat(F.lit("Cell "), at, F.lit(' should hold a number, it holds "'), F.col("raw_s"), F.lit('"; taken as text.'))
    return whole_file_issues(cells.filter(F.col("kind") == NOT_A_NUMBER), fmt, text, "warning", True)


def read_workbook_cells(spark: SparkSession, folder: str) -> DataFrame:
    """Cells of every .xlsx in a folder, one task a sheet; the file name without extension is the submission.

    Each sheet has one row of kind ``sheet`` besides its cells.  A workbook of which any sheet cannot be read to its end gives one row
    of kind ``unreadable`` and no cell, see ``unreadable_issues``; for that, the cells are written once to the shared folder."""
    spark.dataSource.register(WorkbookCells)
    raw = cut(spark.read.format("workbook_cells").option("path", shared_path(spark, folder)).load(), "cells")
    damaged = raw.filter(F.col("kind") == UNREADABLE).groupBy("path").agg(F.min_by("raw_s", F.struct("sheet_ord", "raw_s")).alias("raw_s"))
    gone = damaged.select("path")
    sound = raw.join(F.broadcast(gone) if small_enough(gone) else gone, "path", "left_anti")
    lost = damaged.select("path", *[F.lit(None).cast(f.dataType).alias(f.name) for f in raw.schema[1:5]], F.lit(UNREADABLE).alias("kind"), "raw_s", F.lit(None).cast("double").alias("raw_n"))
    return sound.unionByName(lost).select(F.regexp_extract("path", r"([^/]+)\.xlsx$", 1).alias("submission_id"), "*").drop("path")
