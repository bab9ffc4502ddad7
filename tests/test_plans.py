"""Plans read what they need, once."""

from ledgerbeam.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


def scans(df):
    """Scans of the given tables, and of written cuts, in the plan."""
    lines = [line for line in df._jdf.queryExecution().optimizedPlan().collectLeaves().mkString("\n").split("\n") if "parquet" in line.lower()]
    return len(lines)


def test_counts_read_each_table_of_each_sheet_once(spark):
    assert scans(QUERIES["file_counts"](spark, SF)) <= 7


def test_repeated_accounts_come_from_written_columns(spark):
    assert scans(QUERIES["duplicate_accounts"](spark, SF)) <= 5  # of the accounts only
