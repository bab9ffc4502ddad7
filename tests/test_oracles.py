import pytest

import __spark_entry__ as entry
from check import compare

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["flagship_records", "address_split", "duplicate_accounts", "upload_positions", "compare_bytes"])
def test_query_matches_its_sql(spark, name):
    assert compare(spark, SF, name).startswith("ok")


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
