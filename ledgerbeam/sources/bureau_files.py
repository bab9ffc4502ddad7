"""Filed files read back.  The text reader keeps raw bytes, so decoding them as latin-1 afterwards is exact and the
files stay splittable; one-line layouts are split on their own segment markers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.partitioning import running, in_blocks
from ..operators.segments import SHEET_STRIDE
from ..specs.model import Format, Segment
from ..storage import file_paths


def _latin1(c: str) -> Column:
    return F.decode(F.col(c).cast("binary"), "ISO-8859-1")


def _submission(path: Column) -> Column:
    folder = F.regexp_extract(path, "submission_id=([^/]+)/", 1)
    return F.when(folder != "", folder).otherwise(F.regexp_extract(path, r"([^/]+?)(\.[A-Za-z]+)?$", 1))


def read_pieces(spark: SparkSession, path: str, separator: str) -> DataFrame:
    """(submission_id, file, block_start, piece_ord, piece) split at a separator; the order columns give file order."""
    raw = spark.read.option("lineSep", separator).option("recursiveFileLookup", True).text(file_paths(spark, path))
    return raw.select(
        _submission(F.col("_metadata.file_path")).alias("submission_id"), F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block_start"), F.monotonically_increasing_id().alias("piece_ord"),
        _latin1("value").alias("piece"), F.col("_metadata.file_size").alias("file_size"))


PIECE_ORDER = ("file", "block_start", "piece_ord")


def read_lines(spark: SparkSession, path: str, separator: str = "\n") -> DataFrame:
    """Lines of filed files with their order and real ends (``eol``): a CR before the line feed belongs to the end, and a
    file's last line has none if the file stops there.  Pass a marker as ``separator`` to read a huge one-line file in pieces.

    The reader gives the last piece alike with and without a separator behind it; the file's size tells which it was."""
    p = read_pieces(spark, path, separator)
    held = F.sum(F.length("piece") + len(separator))
    last = p.groupBy("file").agg(held.alias("held"), F.max("file_size").alias("size"), F.max(F.struct("block_start", "piece_ord")).alias("at"))
    open_ended = last.filter("held > size").select("file", "at.block_start", "at.piece_ord", F.lit(True).alias("open"))
    p = p.join(open_ended, list(PIECE_ORDER), "left").withColumn("open", F.coalesce("open", F.lit(False)))
    cr = F.col("piece").endswith("\r") & ~F.col("open") & F.lit(separator == "\n")
    return p.select("submission_id", *PIECE_ORDER, F.when(cr, F.expr("left(piece, length(piece) - 1)")).otherwise(F.col("piece")).alias("line"),
                    F.when(F.col("open"), "").when(cr, "\r\n").otherwise(separator).alias("eol"))


def decode_delimited(lines: DataFrame, fmt: Format) -> DataFrame:
    """Records of one-line-per-record files back to the envelope: token i is field i; each first body tag starts
    a borrower."""
    first = fmt.body[0].tag
    tokens = lines.withColumn("values", F.split("line", r"\|")).withColumn("tag", F.get("values", F.lit(0)))
    body = tokens.filter(F.col("tag").isin(*[s.tag for s in fmt.body]))
    ranked = running(in_blocks(body, PIECE_ORDER), PIECE_ORDER,
                     before=(F.col("tag") == first).cast("int"), line_no=F.lit(1))
    borrower = F.col("before") + F.when(F.col("tag") == first, 1).otherwise(0)
    spec = {s.tag: (s.flag, i) for i, s in enumerate(fmt.body)}
    flag = F.coalesce(*[F.when(F.col("tag") == t, F.lit(f)) for t, (f, _) in spec.items()])
    ord_ = F.coalesce(*[F.when(F.col("tag") == t, F.lit(o)) for t, (_, o) in spec.items()])
    return ranked.select(
        "submission_id", F.concat(F.lit("b"), borrower.cast("string")).alias("ac_no"), (F.col("line_no") + 1).alias("row_no"),
        borrower.alias("first_ord"), "tag", F.col("tag").alias("sheet"), flag.alias("flag"), ord_.alias("spec_ord"),
        (ord_.cast("bigint") * SHEET_STRIDE + F.col("line_no")).alias("seq"), "values")


def decode_one_line(spark: SparkSession, path: str, fmt: Format) -> DataFrame:
    """Borrowers of a one-line delimited file: the file is split at the first segment's marker, then each piece at
    the other markers.  Rows: (submission_id, order…, tag, values)."""
    tags = [s.tag for s in fmt.body]
    pieces = read_pieces(spark, path, f"{tags[0]}|").filter(~F.col("piece").startswith(fmt.header.tag))
    cut_ = fmt.trailer.fields[0].default + fmt.trailer.fields[1].default if fmt.trailer and len(fmt.trailer.fields) > 1 else None
    text = F.concat(F.lit(f"{tags[0]}|"), F.split("piece", cut_)[0] if cut_ else F.col("piece"))
    parts = F.split(text, "(?=" + "|".join(rf"{t}\|" for t in tags) + ")")
    rows = pieces.select("submission_id", *PIECE_ORDER, F.posexplode(parts).alias("part", "record")).filter("record <> ''")
    return rows.withColumn("values", F.split("record", r"\|")).withColumn("tag", F.get("values", F.lit(0)))


def decode_fixed(line: Column, seg: Segment) -> Column:
    """struct of a fixed-width record's fields, blanks trimmed."""
    at, cols = 1, []
    for f in seg.fields:
        cols.append(F.rtrim(F.substring(line, at, f.width)).alias(f.key))
        at += f.width
    return F.struct(*cols)
