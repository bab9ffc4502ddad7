"""Registered queries that go through files: written from the sample book to the shared folder, then read back."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import encode, rollup
from ..operators.consumer_form import explode_form
from ..operators.partitioning import shared_dir
from ..sinks.files import write_submissions
from ..sources.streams import read_stream
from ..specs import consumer
from ..specs.registry import get_format
from ..storage import qualified
from . import queries as Q
from . import sample_book as B
from .convert import convert_batch
from .intake import convert_cells

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _folder(spark: SparkSession, name: str) -> str:
    return qualified(spark, f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}")


@query
def stream_read_back(spark, sf):
    """Tag-length-value files of the whole form, written and read back; records encoded again from the values read."""
    fmt = consumer.TUDF
    done = convert_batch(explode_form(B.consumer_form(spark, sf), B.submissions(spark, sf)), B.submissions(spark, sf), fmt, emit_with_errors=True)
    folder = _folder(spark, "tudf")
    write_submissions(done.records, fmt, folder)
    back = read_stream(spark, folder, fmt).records.withColumn("record", encode.encode_rows(fmt, F.col("values")))
    return back.groupBy("submission_id", "tag", "record").agg(F.count(F.lit(1)).alias("records"))


def _book_meta(cells: DataFrame) -> DataFrame:
    return cells.select("submission_id").distinct().selectExpr(
        "submission_id", "concat('MBR', submission_id) as member_id", "'Lender' as member_name", "cast(null as string) as member_short_name", "date'2026-07-31' as reporting_date",
        "date'2026-08-05' as creation_date", "cast(null as string) as password", "cast(map() as map<string,string>) as extras")


def _converted_books(spark: SparkSession, sf: str):
    cells = Q._cells(spark, sf)
    return convert_cells(cells, _book_meta(cells), get_format("commercial-ucrf-flat-v310"), emit_with_errors=True)


@query
def workbook_issue_listing(spark, sf):
    """Findings of one workbook per nation, errors first, with the cells of columns that differ between workbooks."""
    listing = rollup.issue_listing(_converted_books(spark, sf).issues)
    return listing.select("submission_id", "n", "severity", "sheet", "row", "column", "cell", "field", "message")


@query
def workbook_records(spark, sf):
    """Filed records of the same workbooks, headers and trailers too."""
    return _converted_books(spark, sf).records.select("submission_id", "band", "ac_no", "tag", "record")
