"""Keeping work spread out: written cuts, skew-safe joins and numbering without single-task windows."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# A key with more rows than this is spread over several join partitions.
HOT_ROWS = 1_000_000
# Sides joined by submission are broadcast only up to this many rows (counted first).
SMALL_SIDE_ROWS = 200_000
# Copies of a larger side, one per salt of the big side.
SUBMISSION_SALTS = 64
_cuts: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; a temporary one only in local mode when none is set."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if path:
        return path
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    path = tempfile.mkdtemp(prefix="ledgerbeam-")
    spark.sparkContext.setCheckpointDir(path)
    return path


def cut(df: DataFrame, name: str, group_bytes: int | None = None) -> DataFrame:
    """Write a table to the shared folder and read it back: the costly plan above runs once, later readers
    take only the columns they need, and lost executors never recompute it.

    ``group_bytes`` bounds the rows that a task holds when it writes or reads them, for tables of large values."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    writer = df.write.mode("errorifexists")
    (writer.option("parquet.block.size", group_bytes) if group_bytes else writer).parquet(path)
    _cuts.append(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_cuts(spark: SparkSession) -> None:
    """Deletes the tables that ``cut`` has written in this process. Call it when the results built on them are written."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    while _cuts:
        path = spark._jvm.org.apache.hadoop.fs.Path(_cuts.pop())
        path.getFileSystem(conf).delete(path, True)


def group_value(df: DataFrame, keys: Sequence[str], *aggs: Column) -> DataFrame:
    """One row per key with the aggregates and ``_n``, its row count (combined map-side)."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), *aggs)


def attach(df: DataFrame, groups: DataFrame, keys: Sequence[str], row_key: Sequence[str], how: str = "inner",
           hot_rows: int = HOT_ROWS) -> DataFrame:
    """Join per-key values from ``group_value`` back to the rows without piling a hot key on one task.

    A key with n rows gets ceil(n / hot_rows) salts; its value row is repeated per salt and its rows are
    dealt out by a hash of ``row_key``.  ``df`` is read three times (for its groups, their hot ones and the rows), so give a
    written cut where it costs more than a scan.  The broadcast list holds hot keys only, at most
    total_rows / hot_rows of them (200,000 for 100 TB of 500-byte rows)."""
    salts = F.ceil(F.col("_n") / F.lit(hot_rows)).cast("int")
    hot = groups.filter(F.col("_n") > hot_rows).select(*keys, salts.alias("_salts"))
    left = df.join(F.broadcast(hot), list(keys), "left").withColumn(
        "_salt", F.pmod(F.xxhash64(*row_key), F.coalesce(F.col("_salts"), F.lit(1))).cast("int")).drop("_salts")
    right = groups.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.greatest(salts, F.lit(1)) - 1))).drop("_n")
    return left.join(right, [*keys, "_salt"], how).drop("_salt")


def small_enough(df: DataFrame, limit: int = SMALL_SIDE_ROWS) -> bool:
    return df.limit(limit + 1).count() <= limit


def by_submission(df: DataFrame, side: DataFrame, small: bool, row_key: Sequence[str], how: str = "inner") -> DataFrame:
    """Join a side holding at most one row per submission.  ``small`` is the outcome of a size check on the
    submission table; past it both sides are salted, so one huge submission still spreads."""
    if small:
        return df.join(F.broadcast(side), "submission_id", how)
    salted = side.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SUBMISSION_SALTS - 1))))
    left = df.withColumn("_salt", F.pmod(F.xxhash64(*row_key), F.lit(SUBMISSION_SALTS)).cast("int"))
    return left.join(salted, ["submission_id", "_salt"], how).drop("_salt")


def deal_out(df: DataFrame, *keys: str) -> DataFrame:
    """Deal rows over the session's shuffle partitions before costly row-local work, at every input size alike:
    adaptive execution would join narrow rows into few tasks by their bytes, whatever the work on each."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def in_blocks(df: DataFrame, order: Sequence[str | Column]) -> DataFrame:
    """Range-partition by submission and order, and fix the partition number as column ``block``.

    Blocks follow the order; a large submission spans many of them.  The written cut makes the block
    numbers stable for every later reader."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    settled = cut(df, "unordered")  # choosing the ranges reads the rows once more than dealing them out
    ranged = settled.repartitionByRange(n, "submission_id", *order).withColumn("block", F.spark_partition_id())
    return cut(ranged, "blocks")


def running(blocks: DataFrame, order: Sequence[str | Column], **amounts: Column) -> DataFrame:
    """Exact running totals per submission, before the current row, for rows numbered by ``in_blocks``.

    A window covers one block of one submission; block totals are tiny and are summed across blocks."""
    for name, amount in amounts.items():
        blocks = blocks.withColumn(f"_{name}", amount.cast("bigint"))
    totals = blocks.groupBy("submission_id", "block").agg(*[F.sum(f"_{n}").alias(f"_t_{n}") for n in amounts])
    before = Window.partitionBy("submission_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("submission_id", "block", *[
        F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in amounts])
    inside = Window.partitionBy("submission_id", "block").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = blocks.join(offsets, ["submission_id", "block"])
    out = out.select("*", *[
        (F.col(f"_o_{n}") + F.coalesce(F.sum(f"_{n}").over(inside), F.lit(0))).alias(n) for n in amounts])
    return out.drop(*[f"_{n}" for n in amounts], *[f"_o_{n}" for n in amounts])


def numbered(df: DataFrame, order: Sequence[str | Column], name: str = "ord") -> DataFrame:
    """1-based position of every row within its submission; ``order`` must be unique per submission."""
    out = running(in_blocks(df, order), order, **{name: F.lit(1)})
    return out.withColumn(name, F.col(name) + 1).drop("block")
