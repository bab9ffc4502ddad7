"""Tables in the shared folder, bounded bundles of a broadcast, and connected components."""

from __future__ import annotations

import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Scratch:
    """A folder of its own below spark.checkpoint.dir. Cutting a plan by a table there survives lost executors; `drop` frees its disk."""

    def __init__(self, spark: SparkSession, name: str):
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            root = Path(tempfile.gettempdir(), "ledgerbeam-llm").as_uri()
        self.spark, self.root = spark, f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"

    def cut(self, df: DataFrame, name: str) -> DataFrame:
        """Writes the rows and reads them back."""
        df.write.mode("overwrite").parquet(f"{self.root}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def drop(self, *names: str) -> None:
        """Deletes tables that nothing reads any more."""
        for name in names:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def free_name(name: str, taken: list[str]) -> str:
    """The name, or with underscores behind it if a column is called so; columns differ by more than the case of letters."""
    while name.lower() in {c.lower() for c in taken}:
        name += "_"
    return name


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) of every node of the edges (a, b): the smallest node that links reach.

    Alternates stars to larger and to smaller neighbours until nothing changes; each round's edges are a table in the shared
    folder. A star's centre never gathers its neighbours in one row, so a component of any size is spread over tasks."""
    def star(pairs: DataFrame, larger: bool) -> DataFrame:
        """Joins each node's (larger, or not larger) neighbours to the least of its neighbours and itself."""
        both = pairs.select(F.col("a").alias("u"), F.col("b").alias("v"))
        if larger:
            both = both.union(pairs.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        linked = both.join(least, "u")
        if larger:
            new = linked.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        else:
            new = linked.select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
        return new.where("a <> b").distinct()

    def state(pairs: DataFrame) -> tuple:
        return tuple(pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    name = f"edges-{uuid.uuid4().hex}"
    now = scratch.cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), f"{name}-0")
    before, k = None, 0
    while (after := state(now)) != before:
        before, k = after, k + 1
        # from here a > b: large star keeps the larger neighbours of each node, small star the smaller ones and the node
        now = scratch.cut(star(star(now, True).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), False), f"{name}-{k}")
        scratch.drop(f"{name}-{k - 1}")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select(F.col("b"), F.col("b")).distinct())
