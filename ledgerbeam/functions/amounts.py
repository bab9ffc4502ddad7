"""Rupee amounts and plain number text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import clean, known_text, let, trimmed

_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
_EXACT = float(2**52)


def number_in(s: Column) -> Column:
    """The number a whole text is, else NULL."""
    return F.when(s.rlike(_NUMBER), s.try_cast("double"))


def whole_rupees(c: Column) -> Column:
    """Whole-rupee text, halves rounded up; commas dropped; placeholders and non-numbers NULL."""
    digits = trimmed(F.replace(known_text(c), F.lit(","), F.lit("")))
    n = number_in(digits)
    return F.when(F.abs(n) < _EXACT, F.floor(n + 0.5).cast("string")).otherwise(n.try_cast("decimal(38,0)").cast("string"))


def plain_number(s: Column, n: Column) -> Column:
    """``number_text`` of a trimmed text and the number it holds (see ``number_in``), for callers that keep both as columns."""
    decimal = F.regexp_replace(s.try_cast("decimal(38,12)").cast("string"), r"0+$", "")
    return (F.when(n.isNull(), s)
            .when((n == F.floor(n)) & (F.abs(n) < _EXACT), F.floor(n).cast("string"))
            .when(n == F.floor(n), F.coalesce(n.try_cast("decimal(38,0)").cast("string"), s))
            .otherwise(decimal))


def number_text(c: Column) -> Column:
    """A numeric field's text without exponent or trailing zeros; text that is no number passes through."""
    return let(clean(c), lambda s: let(number_in(s), lambda n: plain_number(s, n)))
