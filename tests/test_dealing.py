"""Costly row-local work is dealt over all tasks, however few splits a small input file has."""

import pytest
from pyspark.sql import functions as F

from ledgerbeam.plans import intake
from ledgerbeam.plans import sample_book as B
from ledgerbeam.specs.registry import get_format


@pytest.fixture(scope="module")
def book(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("book"))
    spark.range(5).selectExpr("cast(id as int) as n_nationkey", "cast(id as int) as n_regionkey", "concat('N', id) as n_name").coalesce(1).write.parquet(f"{path}/nation.parquet")
    people = spark.range(0, 400, 1, 1).selectExpr("id as c_custkey", "concat('Customer ', id) as c_name", "cast(id % 5 as int) as c_nationkey", "'BUILDING' as c_mktsegment", "cast(id as double) as c_acctbal")
    people.write.parquet(f"{path}/customer.parquet")  # one file
    return path


@pytest.mark.parametrize("sheet", ["dealt_customers", "borrower_sheet", "address_sheet"])
def test_borrowers_are_dealt_over_all_tasks(spark, book, sheet):
    rows = getattr(B, sheet)(spark, book).select(F.spark_partition_id().alias("task")).groupBy("task").count().collect()
    assert B.customers(spark, book).select(F.spark_partition_id().alias("task")).distinct().count() == 1
    assert len(rows) == int(spark.conf.get("spark.sql.shuffle.partitions")) and max(r["count"] for r in rows) < 200


def test_dealt_borrowers_are_the_same_rows(spark, book):
    assert sorted(B.dealt_customers(spark, book).collect(), key=str) == sorted(B.customers(spark, book).collect(), key=str)


def test_cells_and_rows_of_one_large_sheet_are_dealt_over_all_tasks(spark, monkeypatch):
    """Cells as they are written, and rows as they are mapped, after a join by the keys of a row."""
    n, fmt = int(spark.conf.get("spark.sql.shuffle.partitions")), get_format("commercial-ucrf-flat-v310")
    heads = spark.range(1).selectExpr("1L as row_no", """inline(array(struct(1 as col_no, "Borrower's Name" as raw_s), struct(2 as col_no, "Borrower's Account Number" as raw_s),
        struct(3 as col_no, 'Business Category' as raw_s), struct(4 as col_no, 'Guarantor Type' as raw_s), struct(5 as col_no, 'Guarantor Entity Name' as raw_s)))""")
    data = spark.range(2, 402, 1, 1).selectExpr("id as row_no", "inline(array(struct(1 as col_no, concat('N', id) as raw_s), struct(2 as col_no, concat('A', id) as raw_s), struct(4 as col_no, '1' as raw_s), struct(5 as col_no, 'G' as raw_s)))")
    cells = heads.unionByName(data).coalesce(1).selectExpr("'W' as submission_id", "'Data' as sheet", "0 as sheet_ord", "row_no", "col_no", "'s' as kind", "raw_s", "cast(null as double) as raw_n")
    meta, seen, mapped = spark.createDataFrame([("W",)], "submission_id string"), [], []
    write, explode = intake.cut, intake.explode_book
    monkeypatch.setattr(intake, "cut", lambda df, name: seen.append(df) or write(df, name))
    monkeypatch.setattr(intake, "explode_book", lambda df, *more: mapped.append(df) or explode(df, *more))
    intake.read_cells(cells, meta, fmt)
    for df, total in ((seen[0], 1605), (mapped[0], 400)):
        tasks = [r["count"] for r in df.select(F.spark_partition_id().alias("task")).groupBy("task").count().collect()]
        assert len(tasks) == n and sum(tasks) == total and max(tasks) < total / 2
