"""Header, body and trailer records in file order."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean
from ..specs.model import Format
from .encode import encode
from .partitioning import by_submission
from .segments import ORDER, values_of

# Position of a record inside its submission: band 0 header, 1 body, 2 trailer.
RECORD_ORDER = ("band", *ORDER)
RECORD_COLUMNS = ("submission_id", *RECORD_ORDER, "ac_no", "tag", "record")


def account_tags(fmt: Format) -> list[str]:
    return [s.tag for s in fmt.body if re.search("account|credit|act", s.tag, re.IGNORECASE) or s.tag in ("CR", "ACTCRD", "TL")]


def file_counts(segments: DataFrame, fmt: Format) -> DataFrame:
    """Borrowers, accounts, addresses and segments per submission (unknown tags count as segments)."""
    return segments.groupBy("submission_id").agg(
        F.count_distinct("ac_no").alias("borrower_count"),
        F.count_if(F.col("tag").isin(*account_tags(fmt))).alias("account_count"),
        F.count_if(F.col("tag").isin("AS", "PA", "ADRCRD")).alias("address_count"),
        F.count(F.lit(1)).alias("segment_count"))


def meta_value(name: str) -> Column:
    """A run parameter; ``extras.x`` reads the open map.  Blank is NULL."""
    if name.startswith("extras."):
        return clean(F.try_element_at(F.col("extras"), F.lit(name[7:])))
    return F.col(name) if name.endswith("_date") else clean(F.col(name))


def apply_overrides(meta: DataFrame, overrides: DataFrame | None) -> DataFrame:
    """Header cells typed in the sheet win over the run parameters."""
    if overrides is None:
        return meta
    side = overrides.select("submission_id", *[F.col(c).alias(f"_o_{c}") for c in overrides.columns if c != "submission_id"])
    joined = meta.join(side, "submission_id", "left")
    for c in overrides.columns:
        if c in meta.columns and c != "submission_id":
            joined = joined.withColumn(c, F.coalesce(F.col(f"_o_{c}"), F.col(c)))
    if "cycle_id" in overrides.columns:
        joined = joined.withColumn("extras", F.when(F.col("_o_cycle_id").isNotNull(), F.map_concat(
            F.map_filter("extras", lambda k, v: k != "cycle_id"), F.create_map(F.lit("cycle_id"), F.col("_o_cycle_id")))
        ).otherwise(F.col("extras")))
    return joined.select(*meta.columns)


def _edge_record(band: int, tag: str, record: Column) -> list[Column]:
    zero = F.lit(0).cast("bigint")
    return [F.col("submission_id"), F.lit(band).alias("band"), zero.alias("first_ord"), F.lit(0).alias("flag"),
            F.lit(0).alias("spec_ord"), zero.alias("seq"), F.lit("").alias("ac_no"), F.lit(tag).alias("tag"), record.alias("record")]


def header_records(meta: DataFrame, fmt: Format) -> DataFrame:
    values = values_of(fmt.header, fmt.header_values(meta_value))
    return meta.select(*_edge_record(0, fmt.header.tag, encode(fmt.header, values)))


def trailer_records(meta: DataFrame, counts: DataFrame, fmt: Format) -> DataFrame:
    given = fmt.trailer_values(F.col, meta_value)
    return meta.join(counts, "submission_id").select(
        *_edge_record(2, fmt.trailer.tag, encode(fmt.trailer, values_of(fmt.trailer, given))))


def assemble(body: DataFrame, meta: DataFrame, counts: DataFrame, fmt: Format, small: bool) -> DataFrame:
    """All records of the passing submissions.  ``body`` carries the envelope order and ``record``."""
    rows = body.filter(F.col("record").isNotNull()).select(
        "submission_id", F.lit(1).alias("band"), *ORDER, "ac_no", "tag", "record")
    headers = header_records(meta, fmt)
    if fmt.glue_header:
        rows = glue_headers(rows, headers, small)
    else:
        rows = headers.unionByName(rows)
    if fmt.trailer is not None:
        rows = rows.unionByName(trailer_records(meta, counts, fmt))
    return rows


def glue_headers(rows: DataFrame, headers: DataFrame, small: bool) -> DataFrame:
    """Header text in front of each submission's first record, on the same line."""
    place = F.struct(*ORDER)
    first = rows.groupBy("submission_id").agg(F.min(place).alias("_first")).join(
        headers.select("submission_id", F.col("record").alias("_header")), "submission_id")
    glued = F.when(place == F.col("_first"), F.concat("_header", "record")).otherwise(F.col("record"))
    return by_submission(rows, first, small, ORDER, "left").withColumn("record", glued).select(*rows.columns)


def physical_text(fmt: Format, last: Column) -> Column:
    """A record with its line end: the concatenation over a submission is the file.  Line ends follow their
    record, so a file cut between any two records still consists of whole lines."""
    between = "" if fmt.one_physical_line else fmt.line_end
    final = fmt.line_end if fmt.one_physical_line or fmt.final_line_end else ""
    return F.concat(F.col("record"), F.when(last, F.lit(final)).otherwise(F.lit(between)))


def physical_records(records: DataFrame, fmt: Format, small: bool = True) -> DataFrame:
    """(submission_id, order…, text): text pieces whose concatenation in order is the file."""
    last = F.col("band") == 2
    if fmt.trailer is None:
        place = F.struct(*RECORD_ORDER)
        ends = records.groupBy("submission_id").agg(F.max(place).alias("_last"))
        records = by_submission(records, ends, small, ORDER, "left")
        last = place == F.col("_last")
    return records.select("submission_id", *RECORD_ORDER, physical_text(fmt, last).alias("text"))


def in_file_order(df: DataFrame) -> DataFrame:
    """Rows range-partitioned by submission and position and sorted inside each partition: partition order is
    file order, and a huge submission is spread over many partitions."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartitionByRange(n, "submission_id", *RECORD_ORDER).sortWithinPartitions("submission_id", *RECORD_ORDER)


def submission_name(fmt: Format, run_time: str) -> Column:
    """File name of a submission; ``run_time`` is HHMMSS, passed in so that a rerun gives the same name."""
    from ..functions.dates import cycle_code, ddmmyyyy
    plain = F.lit(f"submission{fmt.extension}")
    if not fmt.id.startswith("commercial"):
        return plain
    member, rep = clean(F.col("member_id")), F.col("reporting_date")
    name = F.concat(member, F.lit("_Commercial_"), ddmmyyyy(rep), F.lit("_"), ddmmyyyy(F.coalesce(F.col("creation_date"), rep)),
                    F.lit(f"_{run_time}_"), cycle_code(rep), F.lit(fmt.extension))
    return F.coalesce(name, plain)


def side_file_name(kind: str) -> Column:
    """Name of the issues or report export."""
    base = F.coalesce(F.nullif(F.col("member_id"), F.lit("")), F.lit("submission"))
    return F.concat(F.regexp_replace(base, "[^A-Za-z0-9_.-]+", "_"), F.lit(f"_{kind}"))
