from collections import defaultdict

from pyspark.sql import functions as F

from ledgerbeam.operators.partitioning import attach, by_submission, group_value, numbered, running, in_blocks


def skewed(spark):
    """One key holds most of the rows."""
    return spark.range(600).selectExpr("id", "case when id % 3 > 0 then 'hot' else concat('k', id % 50) end as key",
                                       "case when id % 3 > 0 then 'S0' else concat('S', id % 7) end as submission_id")


def test_attach_equals_a_plain_join_when_a_key_is_hot(spark):
    df = skewed(spark)
    firsts = group_value(df, ("key",), F.min("id").alias("first"))
    salted = attach(df, firsts, ("key",), ("id",), hot_rows=20)
    plain = df.join(firsts.drop("_n"), "key")
    key = lambda rows: sorted((r.id, r.key, r.first) for r in rows)
    assert key(salted.collect()) == key(plain.collect())


def test_submission_join_is_the_same_salted_and_broadcast(spark):
    df = skewed(spark)
    side = df.select("submission_id").distinct().withColumn("v", F.length("submission_id"))
    a = by_submission(df, side, True, ("id",)).count()
    b = by_submission(df, side, False, ("id",)).count()
    semi = by_submission(df, side.filter("submission_id = 'S0'").drop("v"), False, ("id",), "left_semi").count()
    assert a == b == 600 and semi == df.filter("submission_id = 'S0'").count()


def test_numbers_and_running_totals_span_blocks(spark):
    df = skewed(spark)
    want, seen = {}, defaultdict(int)
    for r in sorted(df.collect(), key=lambda r: r.id):
        seen[r.submission_id] += 1
        want[r.id] = seen[r.submission_id]
    assert {r.id: r.n for r in numbered(df, ("id",), "n").collect()} == want
    blocks = in_blocks(df, ("id",))
    assert blocks.filter("submission_id = 'S0'").select("block").distinct().count() > 1
    totals = running(blocks, ("id",), before=F.lit(2))
    assert {r.id: r.before for r in totals.collect()} == {i: 2 * (n - 1) for i, n in want.items()}
