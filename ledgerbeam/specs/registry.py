"""The formats a batch can be converted to."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import catalogues, commercial, consumer, microfinance
from .legends import LEGENDS
from .model import Format

# Registered formats, in listing order.
LISTED = (commercial.MASTER_V310, commercial.MASTER_V39, microfinance.CDF, consumer.TUDF, consumer.FLAT)
# Template layouts are reachable as objects only; looking them up by id is an error.
TEMPLATES = (commercial.TEMPLATE_V39, commercial.TEMPLATE_V310)

_BY_ID: dict[str, Format] = {fid: f for f in LISTED for fid in (f.id, *f.aliases)}


def get_format(format_id: str) -> Format:
    if format_id not in _BY_ID:
        raise KeyError(f"unknown format: {format_id}")
    return _BY_ID[format_id]


def formats(spark: SparkSession, hide_deprecated: bool = False) -> DataFrame:
    """Every registered id once per layout."""
    rows = [(fid, f.id, f.label, f.version, f.deprecated) for fid, f in _BY_ID.items()]
    df = spark.createDataFrame(rows, "lookup_id string, id string, label string, version string, deprecated boolean")
    if hide_deprecated:
        df = df.filter("not deprecated")
    return df.dropDuplicates(["id"]).select("id", "label", "version")


def field_specs(spark: SparkSession, fmt: Format) -> DataFrame:
    """The layout as a dimension: one row per field of every segment."""
    segments = [fmt.header, *fmt.body, *([fmt.trailer] if fmt.trailer else [])]
    rows = [
        (fmt.id, s.tag, so, fo, f.key, f.label, f.kind, f.required, f.when if isinstance(f.when, str | None) else "rule", f.severity, f.width, f.cap, f.default,
         f.tlv, s.encoding, s.flag, s.cardinality)
        for so, s in enumerate(segments) for fo, f in enumerate(s.fields)
    ]
    return spark.createDataFrame(rows, (
        "format_id string, tag string, spec_ord int, field_ord int, key string, label string, kind string, "
        "required boolean, condition string, severity string, width int, cap int, default_value string, tlv string, "
        "encoding string, flag int, cardinality string"))


def catalogue_dim(spark: SparkSession) -> DataFrame:
    rows = [(n, c, d) for n, t in catalogues.CATALOGUES.items() for c, d in t.items()]
    return spark.createDataFrame(rows, "catalogue string, code string, description string")


def legend_dim(spark: SparkSession) -> DataFrame:
    rows = [
        (leg.name, kind, key, code)
        for leg in LEGENDS.values()
        for kind, table in (("code", leg.by_code), ("label", leg.by_label), ("number", leg.by_num))
        for key, code in table.items()
    ]
    return spark.createDataFrame(rows, "legend string, key_kind string, key string, code string")


def state_dim(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        [(s, c, catalogues.COMMERCIAL_STATE[c], "state") for s, c in catalogues.state_needles()]
        + [(s, c, catalogues.COMMERCIAL_STATE[c], "city") for s, c in catalogues.city_codes().items()],
        "spelling string, code string, state_name string, kind string")


def pin_circle_dim(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(catalogues.pin_prefix_codes().items()), "prefix string, code string")
