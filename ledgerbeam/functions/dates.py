"""Dates as they are typed, and reporting cycles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .lookups import lookup
from .text import clean, known_text, let

# Month names by their first three letters.
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")


def ddmmyyyy(date: Column) -> Column:
    # Serials far out of range give years past 9999, which Spark writes with a plus sign.
    return F.translate(F.date_format(date, "ddMMyyyy"), "+", "")


def parse_ddmmyyyy(s: Column) -> Column:
    """Eight digits that are a real calendar day."""
    return F.when(s.rlike("^[0-9]{8}$"), F.try_to_date(s, "ddMMyyyy"))


def parse_dmy(s: Column) -> Column:
    """D/M/YYYY with slashes, dashes or dots."""
    shape = s.rlike(r"^[0-9]{1,2}[-/.][0-9]{1,2}[-/.][0-9]{4}$")
    return F.when(shape, F.try_to_date(F.translate(s, "/.", "--"), "d-M-yyyy"))


def date_from_text(s: Column) -> Column:
    return F.coalesce(parse_ddmmyyyy(s), parse_dmy(s))


def date_from_number(n: Column) -> Column:
    """Spreadsheet serial day; a million or more is read as DDMMYYYY digits first."""
    serial = F.date_add(F.lit("1899-12-30").cast("date"), F.floor(n).cast("int"))
    typed = parse_ddmmyyyy(F.lpad(n.cast("bigint").cast("string"), 8, "0"))
    digits = F.when(F.abs(n) < 1e8, typed)
    return F.when(n >= 1_000_000, F.coalesce(digits, serial)).otherwise(serial)


def loose_date_text(s: Column) -> Column:
    """Free-text dates to DDMMYYYY: '4th June 2025', 'June 4, 2025', '4/6/25' (pivot 50); else NULL.

    Days up to 31 are accepted for every month, as typed."""
    return let(clean(F.translate(F.regexp_replace(s, r"(?i)([0-9])(st|nd|rd|th)\b", "$1"), ",", " ")), _loose)


def _loose(text: Column) -> Column:
    def written(pattern: str, d: int, m: int, y: int) -> Column:
        day = F.regexp_extract(text, pattern, d)
        name = lookup({m: f"{i:02d}" for i, m in enumerate(MONTHS, 1)},
                      F.lower(F.substring(F.regexp_extract(text, pattern, m), 1, 3)))
        # A missing month makes the concatenation NULL.
        return F.when(text.rlike(pattern) & day.try_cast("int").between(1, 31),
                      F.concat(F.lpad(day, 2, "0"), name, F.regexp_extract(text, pattern, y)))

    numeric = r"^([0-9]{1,2})[-/]([0-9]{1,2})[-/]([0-9]{2,4})$"
    d, m = F.regexp_extract(text, numeric, 1), F.regexp_extract(text, numeric, 2)
    year = let(F.regexp_extract(text, numeric, 3).try_cast("int"), lambda y: F.when(y < 50, y + 2000).when(
        y < 100, y + 1900).otherwise(y).cast("string"))
    ok = text.rlike(numeric) & d.try_cast("int").between(1, 31) & m.try_cast("int").between(1, 12)
    return F.coalesce(
        written(r"(?i)^([0-9]{1,2})\s+([a-z]{3,})\s+([0-9]{4})$", 1, 2, 3),
        written(r"(?i)^([a-z]{3,})\s+([0-9]{1,2})\s+([0-9]{4})$", 2, 1, 3),
        F.when(ok, F.concat(F.lpad(d, 2, "0"), F.lpad(m, 2, "0"), year)),
    )


def sheet_date_text(c: Column, dtype: T.DataType | None = None) -> Column:
    """Any cell to DDMMYYYY text; text that is no date passes through for the validator to flag."""
    if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return ddmmyyyy(c)
    if isinstance(dtype, T.NumericType):
        return ddmmyyyy(date_from_number(c))
    s = known_text(c)
    return F.when(s.isNotNull(), F.coalesce(ddmmyyyy(date_from_text(s)), loose_date_text(s), s))


def typed_date_text(c: Column, dtype: T.DataType | None = None) -> Column:
    """Date field of a typed segment sheet: no free-text forms."""
    if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType, T.NumericType)):
        return sheet_date_text(c, dtype)
    return let(clean(c), day_text)


def day_text(s: Column) -> Column:
    """``typed_date_text`` of a trimmed text; eight digits stand as they are, be they a day or not, so they are not parsed."""
    return F.coalesce(ddmmyyyy(parse_dmy(s)), s)


def cycle_code(date: Column) -> Column:
    """Reporting cycle: W1 to the 9th, W2 to the 16th, W3 to the 23rd, ME after that and on month end."""
    day = F.dayofmonth(date)
    return (
        F.when(date.isNull(), None)
        .when(day == F.dayofmonth(F.last_day(date)), "ME")
        .when(day <= 9, "W1").when(day <= 16, "W2").when(day <= 23, "W3")
        .otherwise("ME")
    )


def cycle_date(year: Column, month: Column, code: Column) -> Column:
    first = F.make_date(year, month, F.lit(1))
    day = F.when(code == "W1", 9).when(code == "W2", 16).when(code == "W3", 23)
    return F.when(day.isNull(), F.last_day(first)).otherwise(F.date_add(first, day - 1))


_DMY = r"^([0-9]{1,2})/([0-9]{1,2})/([0-9]{4})$"
_ISO = r"^([0-9]{4})-([0-9]{2})-([0-9]{2})$"


def _reshaped(s: Column, pattern: str, build: Callable[[Column, Column, Column], Column]) -> Column:
    """Rebuild a text of the given shape from its three parts; other texts are NULL."""
    return let(clean(s), lambda t: F.when(t.rlike(pattern), build(*[F.regexp_extract(t, pattern, i) for i in (1, 2, 3)])))


def dmy_to_ddmmyyyy(s: Column) -> Column:
    return _reshaped(s, _DMY, lambda d, m, y: F.concat(F.lpad(d, 2, "0"), F.lpad(m, 2, "0"), y))


def dmy_to_iso(s: Column) -> Column:
    return _reshaped(s, _DMY, lambda d, m, y: F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0")))


def iso_to_dmy(s: Column) -> Column:
    return _reshaped(s, _ISO, lambda y, m, d: F.concat_ws("/", d, m, y))
