"""Values to record text, one expression per layout, chosen while the plan is built."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..specs.model import Format, Segment


def fit(c: Column, width: int, left: bool, fill: str) -> Column:
    """Pad or cut to an exact width."""
    return (F.lpad if left else F.rpad)(c, width, fill)


def _value(values: Column, i: int) -> Column:
    return F.get(values, F.lit(i))


def delimited(seg: Segment, values: Column) -> Column:
    return F.array_join(values, "|")


def fixed_width(seg: Segment, values: Column) -> Column:
    return F.concat(*[
        fit(_value(values, i), f.width, *f.padding) if f.width else _value(values, i) for i, f in enumerate(seg.fields)
    ])


def tag_length_value(seg: Segment, values: Column) -> Column:
    """Prefix, then code + two-digit length + value for every present field.

    A segment without any value is its prefix.  Looking for a value goes over the array, which keeps Spark from compiling the
    fields of all segments into one method of a whole stage: the JVM would interpret a method of that size."""
    parts = [F.lit(seg.tlv_prefix)]
    for i, f in enumerate(seg.fields):
        if f.key.startswith("_"):
            continue
        v = _value(values, i)
        n = F.length(v)
        size = F.when(n < 10, F.concat(F.lit("0"), n.cast("string"))).otherwise(n.cast("string"))
        parts.append(F.when(v != "", F.concat(F.lit(f.tlv), size, v)).otherwise(""))
    return F.when(F.exists(values, lambda v: v != ""), F.concat(*parts)).otherwise(parts[0])


def concatenated(seg: Segment, values: Column) -> Column:
    return F.concat(*[
        fit(_value(values, i), f.width, *f.padding) if f.width else _value(values, i)
        for i, f in enumerate(seg.fields) if not f.key.startswith("_")
    ])


_ENCODERS = {"delimited": delimited, "fixed": fixed_width, "tlv": tag_length_value, "concatenated": concatenated}


def encode(seg: Segment, values: Column) -> Column:
    return _ENCODERS[seg.encoding](seg, values)


def encode_rows(fmt: Format, values: Column) -> Column:
    """Record text of an envelope row, by its tag; NULL for tags the layout does not know."""
    by_encoder: dict = {}
    for seg in fmt.body:
        key = seg.encoding if seg.encoding == "delimited" else seg.tag
        by_encoder.setdefault(key, []).append(seg)
    out = None
    for segs in by_encoder.values():
        hit = F.col("tag").isin(*[s.tag for s in segs])
        out = F.when(hit, encode(segs[0], values)) if out is None else out.when(hit, encode(segs[0], values))
    return out


def unmappable(c: Column) -> Column:
    """Characters that a one-byte encoding cannot carry."""
    return F.regexp_replace(c, r"[\x00-\xff]", "")
