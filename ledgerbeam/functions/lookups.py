"""Catalogue lookups as literal maps: no join and nothing broadcast that could grow."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..specs import catalogues
from ..specs.legends import GENDER_CODE, GENDER_PREFIX, LEGENDS, PAN_HOLDER
from .text import header_text, label_text, leading_key, trimmed


_ENTRY, _PAIR = "\x01", "\x02"


def literal_map(table: Mapping[str, str]) -> Column:
    """A constant map, written as one string so that plans stay small; Catalyst folds it once."""
    text = _ENTRY.join(f"{k}{_PAIR}{v}" for k, v in table.items())
    return F.str_to_map(F.lit(text), F.lit(_ENTRY), F.lit(_PAIR))


def literal_list(values: Iterable[str]) -> Column:
    return F.split(F.lit(_ENTRY.join(values)), _ENTRY)


def lookup(table: Mapping[str, str], key: Column) -> Column:
    return F.try_element_at(literal_map(table), key)


def lookup_list(table: Mapping[str, Iterable[str]], key: Column) -> Column:
    """Array of the texts filed under a key."""
    return F.split(lookup({k: "\x03".join(v) for k, v in table.items()}, key), "\x03")


def legend_code(name: str, c: Column) -> Column:
    """Wire code of a dropdown value given as code, label or number, in that order of precedence.

    A number followed by a known label ('11. Self Help Group') is read by its label.  Give a column or a short expression, as it is
    named several times to stay compiled."""
    legend, s = LEGENDS[name], trimmed(c)
    tail = F.regexp_extract(s, r"^[0-9]+[\s.):-]+(\S.*)$", 1)  # empty when there is none; no label is empty
    numbered = F.coalesce(lookup(legend.by_label, label_text(tail)), lookup(legend.by_code, leading_key(s)),
                          lookup(legend.by_label, label_text(s)), lookup(legend.by_num, leading_key(s)))
    # What is only digits or starts with none is its own key; labels are kept in the form that ``label_text`` gives.
    plain = F.coalesce(lookup(legend.by_code, s), lookup(legend.by_label, F.lower(s)), lookup(legend.by_label, label_text(s)), lookup(legend.by_num, s))
    return F.when(s.isNotNull(), F.when(s.rlike("^[0-9]+[^0-9]"), numbered).otherwise(plain))


def gender_code(c: Column) -> Column:
    return lookup(GENDER_CODE, F.lower(trimmed(c)))


def gender_prefix(code: Column, upper: bool) -> Column:
    return lookup({k: v.upper() if upper else v for k, v in GENDER_PREFIX.items()}, code)


def pan_holder(constitution: Column) -> tuple[Column, Column]:
    """(expected fourth PAN letter, holder description) for a legal constitution code."""
    return (lookup({k: v[0] for k, v in PAN_HOLDER.items()}, constitution),
            lookup({k: v[1] for k, v in PAN_HOLDER.items()}, constitution))


def credit_type(c: Column) -> Column:
    """Code of a credit-type description from the published catalogue; digits pass through."""
    by_text = {" ".join(d.split()).lower(): code for code, d in catalogues.CREDIT_TYPE.items()}
    s = trimmed(c)
    return F.when(s.rlike("^[0-9]+$"), s).otherwise(F.coalesce(lookup(by_text, F.lower(s)), lookup(by_text, header_text(s))))


def wilful_code(c: Column) -> Column:
    s = F.lower(trimmed(c))
    return F.when(s.isin("no", "n", "0"), "0").when(s.isin("yes", "y", "1"), "1").otherwise(s)
