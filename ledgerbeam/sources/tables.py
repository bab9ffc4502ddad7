"""Loan books already landed as tables."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import header_text


def read_tables(spark: SparkSession, path: str, fmt: str = "parquet", schema: str | None = None) -> DataFrame:
    """A landed table.  CSV needs its schema (no inference pass); all other columns are pruned by the readers."""
    reader = spark.read.format(fmt)
    if schema:
        reader = reader.schema(schema)
    if fmt == "csv":
        if not schema:
            raise ValueError("give the schema of CSV books; inferring it would read the data twice")
        reader = reader.option("header", True)
    return reader.load(path)


def rename_columns(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """Landed column names to input keys."""
    return df.select(*[F.col(c).alias(names.get(c, c)) for c in df.columns])


def credit_type_lookup(cells: DataFrame) -> DataFrame:
    """The lookup sheet of each workbook: column B digits are the code, column C the description; the last
    row wins for a repeated description."""
    sheet = cells.filter(F.lower("sheet") == "credit type code").filter("col_no in (2, 3)")
    rows = sheet.groupBy("submission_id", "row_no").agg(
        F.max(F.when(F.col("col_no") == 2, F.col("value"))).alias("code"),
        F.max(F.when(F.col("col_no") == 3, header_text(F.col("value")))).alias("description"))
    rows = rows.filter(F.col("code").rlike("^[0-9]+$") & (F.col("description") != ""))
    return rows.groupBy("submission_id", "description").agg(F.max_by("code", "row_no").alias("code"))
