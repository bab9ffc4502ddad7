"""Repeated guarantor column groups: identical headers told apart by position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import clean, label_text, let
from ..specs.commercial import GUARANTOR_KEYS

# Labels of the column groups and the inputs they feed.
BLOCK_START = {"guarantor type": "type"}
NAMES = {"guarantor entity name": "entityName", "full name": "fullName"}
PERSON = {"date of birth": "dob", "gender": "gender", "pan": "pan"}
ADDRESS_LINES = {"address line 1": "addressLine1", "address line 2": "addressLine2", "address line 3": "addressLine3"}
ADDRESS = {"address": "address"}
PLACE = {"city": "city", "district": "district", "state": "state", "pin": "pin"}
PHONES = {"mobile": "mobile", "std code": "stdCode", "landline": "landline"}
CONTACT = {"contact": "contact"}


def _longest(header: Column, labels: dict[str, str], at_start: bool = False) -> Column:
    """The input of the longest label that begins the header, or stands in it as whole words."""
    found = [F.when(header.startswith(label) if at_start else header.rlike(rf"\b{label}\b"), labels[label]) for label in sorted(labels, key=len, reverse=True)]
    return F.coalesce(*found)


def header_input(header: Column) -> Column:
    """What a column group's header feeds. A block starts with its type, and names begin their header; every other label may stand
    anywhere in it. A header that speaks of an address is one of its lines or the whole of it, with whatever it holds; only others are
    a place. A kind of phone goes before a contact in general."""
    return let(label_text(header), lambda h: F.coalesce(
        _longest(h, BLOCK_START | NAMES, True), *[_longest(h, labels) for labels in (PERSON, ADDRESS_LINES, ADDRESS, PLACE, PHONES, CONTACT)]))


def guarantor_blocks(raw_cells: Column) -> Column:
    """array<struct(col, header, value)> of one row to array<struct> of guarantor inputs, row-locally.

    A 'Guarantor Type' header starts a block that runs to the next one or to the end of the row; a header
    repeated inside a block takes its last cell."""
    def blocks(cells: Column) -> Column:
        starts = F.transform(F.filter(cells, lambda c: c["key"] == "type"), lambda c: c["col"])
        return let(starts, lambda at: F.transform(at, lambda start, i: let(
            F.filter(cells, lambda c: (c["col"] >= start) & F.coalesce(c["col"] < F.get(at, i + 1), F.lit(True))), _block)))

    return let(F.transform(F.array_sort(raw_cells), lambda c: F.struct(
        c["col"].alias("col"), header_input(c["header"]).alias("key"), clean(c["value"]).alias("value"))), blocks)


def _has_key(key: str):
    return lambda c: c["key"] == key


def _block(cells: Column) -> Column:
    return F.struct(*[
        F.try_element_at(F.filter(cells, _has_key(key)), F.lit(-1))["value"].alias(key)
        for key in GUARANTOR_KEYS])


def unpivot_guarantors(cells: DataFrame) -> DataFrame:
    """Long form for cell tables (submission_id, row_no, col_no, header, value): one row per block.

    Blocks are numbered by a running count of start headers over the cells of one row."""
    keyed = cells.withColumn("key", header_input(F.col("header")))
    row = Window.partitionBy("submission_id", "row_no").orderBy("col_no").rowsBetween(Window.unboundedPreceding, 0)
    placed = keyed.withColumn("block", F.sum(F.when(F.col("key") == "type", 1).otherwise(0)).over(row))
    return (
        placed.filter("block > 0 and key is not null")
        .groupBy("submission_id", "row_no", "block")
        .agg(*[F.max_by(F.when(F.col("key") == k, clean(F.col("value"))),
                        F.when(F.col("key") == k, F.col("col_no"))).alias(k) for k in GUARANTOR_KEYS])
    )
