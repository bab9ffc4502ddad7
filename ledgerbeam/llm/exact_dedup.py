"""Exact dedup: rows whose texts are equal but for white space, and which row of each group stays.

Texts are combined in three stages, and each compares whole contents (its groups are a digest and the text without white space):
every task first combines its own rows, the partial side of the aggregate; what is left of a digest is merged under salts; winners
of the salts are combined globally. Only digests that hold more than one in `HOT_SHARE` of all rows get salts. There are fewer of
them than `HOT_SHARE`, so their list may be broadcast whatever the input, and every other digest is small enough for one place.
Whole texts are shuffled once, after the tasks have combined their own. Ids, sizes and digests of all rows then find their winner:
by digest where the stages found one content under it, else by digest and content.

The row with the most code points stays, then the one with the smallest id (a null id comes last), then the first row read. A null
text is an empty one; empty texts and those of white space only are equal. Texts of any length are whole values of one row. Repeated
rows are copies like others. An empty table gives an empty result. Only the id and the text are read; other columns, whatever their
names, are left out of `group_copies` and kept by `drop_copies`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import Scratch

#: The characters that don't count: a blank, and those from tab to carriage return.
WHITE = " \t\n\x0b\x0c\r"
#: A digest with more than one in so many of all rows is salted.
HOT_SHARE = 4096
SALTS = 64


def plain_text(text: str) -> Column:
    return F.translate(F.coalesce(F.col(text), F.lit("")), WHITE, "")


def _texts(docs: DataFrame, id_column: str, text: str, digest_bytes: int) -> DataFrame:
    """Id, code points, text without white space, its SHA-256 and the part of it that rows meet by."""
    read = docs.select(F.col(id_column).alias("id"), F.length(F.coalesce(F.col(text), F.lit(""))).alias("size"), plain_text(text).alias("plain"))
    return read.withColumn("sha", F.unhex(F.sha2("plain", 256))).withColumn("digest", F.substring("sha", 1, digest_bytes))


def _best() -> Column:
    """Least for the row that stays."""
    return F.struct((-F.col("size")).alias("less"), F.col("id").isNull().alias("none"), F.col("id").alias("id"))


def _is_best() -> Column:
    return (F.col("size") == -F.col("best.less")) & F.col("id").eqNullSafe(F.col("best.id"))


def _merge(texts: DataFrame, salt: Column, *more: str) -> DataFrame:
    """One row of each content under each salt; tasks combine their own rows before they shuffle any text."""
    return texts.withColumn("salt", salt).groupBy("digest", "salt", "plain", *more).agg(F.min(_best()).alias("best"), F.count("*").alias("n"))


def _combine(merged: DataFrame) -> DataFrame:
    """One row of each content from the winners of the salts."""
    return merged.groupBy("digest", "plain").agg(F.min("best").alias("best"), F.sum("n").alias("n"))


def group_copies(docs: DataFrame, id_column: str = "doc_id", text: str = "text", scratch: Scratch | None = None, digest_bytes: int = 32) -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256) of each row: which row of its group stays, how many rows the group has, whether
    this is the one, and the SHA-256 of the text without white space as hex."""
    scratch = scratch or Scratch(docs.sparkSession, "exact")
    texts = _texts(docs, id_column, text, digest_bytes)
    rows = scratch.cut(texts.select(F.monotonically_increasing_id().alias("row"), "id", "size", "sha", "digest"), "rows")
    total = rows.count()
    hot = scratch.cut(rows.groupBy("digest").agg(F.count("*").alias("c")).where(F.col("c") * HOT_SHARE > total).select("digest", F.lit(True).alias("hot")), "hot")

    spread = F.when(F.col("hot"), F.pmod(F.spark_partition_id(), F.lit(SALTS))).otherwise(F.lit(0))
    marked = texts.drop("sha").join(F.broadcast(hot), "digest", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
    merged = _merge(marked, spread, "hot").select("digest", "hot", F.when(F.col("hot"), F.col("plain")).alias("plain"), "best", "n")
    merged = scratch.cut(merged, "merged")
    cold = merged.where("not hot").groupBy("digest").agg(F.count("*").alias("contents"), F.min("best").alias("best"), F.sum("n").alias("n"))
    warm = _combine(merged.where("hot")).groupBy("digest").agg(F.count("*").alias("contents"), F.min("best").alias("best"), F.sum("n").alias("n"))
    warm = scratch.cut(warm, "warm")

    # a digest that isn't hot has few rows, and its join and its window share one shuffle of ids and digests
    few = rows.join(F.broadcast(hot.select("digest")), "digest", "left_anti").join(cold.where("contents = 1"), "digest")
    few = few.withColumn("first", F.min("row").over(Window.partitionBy("digest", "id", "size")))
    many = rows.join(F.broadcast(warm.where("contents = 1")), "digest")
    leaders = many.where(_is_best()).groupBy("digest").agg(F.min("row").alias("first"))
    many = many.join(F.broadcast(leaders), "digest")
    columns = [F.col("id").alias(id_column), F.col("best.id").alias("keep_id"), F.col("n").alias("group_size"), (_is_best() & (F.col("row") == F.col("first"))).alias("kept"),
               F.lower(F.hex("sha")).alias("text_sha256")]
    done = few.select(*columns).union(many.select(*columns))

    several = scratch.cut(cold.union(warm).where("contents > 1").select("digest"), "several")
    if not several.isEmpty():  # different contents under one digest: their rows meet by content
        part = scratch.cut(texts.join(several, "digest", "left_semi").withColumn("row", F.monotonically_increasing_id()), "part")
        groups = _combine(_merge(part, F.pmod(F.xxhash64("id"), F.lit(SALTS))))
        part = part.join(groups, ["digest", "plain"])
        leaders = part.where(_is_best()).groupBy("digest", "plain").agg(F.min("row").alias("first"))
        done = done.union(part.join(leaders, ["digest", "plain"]).select(*columns))
    return done


def drop_copies(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of `docs` that stay, with all their columns; the stages carry whole rows. Salts are given to all digests."""
    order = F.struct((-F.length(F.coalesce(F.col(text), F.lit("")))).alias("less"), F.col(id_column).isNull().alias("none"), F.col(id_column).alias("id"))
    plain = plain_text(text)
    held = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("kept"), order.alias("best"), F.sha2(plain, 256).alias("digest"), plain.alias("plain"))
    held = held.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(SALTS)))
    for keys in (["digest", "salt", "plain"], ["digest", "plain"]):
        held = held.groupBy(*keys).agg(F.min_by("kept", "best").alias("kept"), F.min("best").alias("best"))
    return held.select("kept.*")
