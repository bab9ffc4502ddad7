"""Text clean-up."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space as a spreadsheet author sees it, including the no-break space and the byte-order mark.
BLANKS = " \t\n\r\f\u000b\u00a0\ufeff"
QUOTES = "\u201c\u201d\u201e\u2018\u2019"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Name a value inside an expression.

    Column expressions that mention an argument twice repeat its whole tree, and chains of such functions grow
    exponentially; a one-element transform keeps one copy and evaluates it once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def clean(c: Column) -> Column:
    """Trim; blank becomes NULL."""
    return F.get(F.filter(F.array(F.btrim(c, F.lit(BLANKS))), lambda t: t != ""), F.lit(0))


def trimmed(c: Column) -> Column:
    """``clean`` without a function over arrays, so that it stays compiled; it names its argument twice, so give a column or a short expression."""
    t = F.btrim(c, F.lit(BLANKS))
    return F.when(t != "", t)


def known(c: Column) -> Column:
    """Trim; blanks and the usual placeholders (NA, N/A, nil, none, dashes) become NULL."""
    return F.get(F.filter(F.array(F.btrim(c, F.lit(BLANKS))), lambda t: ~t.rlike(
        r"(?i)^(na|n\.?/?a|null|nil|none|-+|)$")), F.lit(0))


def known_text(c: Column) -> Column:
    """``known`` without a function over arrays, so that it stays compiled (see ``trimmed``); only what may be a placeholder meets the pattern."""
    t = F.btrim(c, F.lit(BLANKS))
    short = (F.length(t) <= 5) | t.startswith("-")
    return F.when((t != "") & ~(short & t.rlike(r"(?i)^(na|n\.?/?a|null|nil|none|-+|)$")), t)


def one_line(c: Column) -> Column:
    """``fold_breaks`` of a text that seldom has any; it names its argument several times."""
    return F.when(c.contains("\n") | c.contains("\r") | c.contains("\t"), fold_breaks(c)).otherwise(c)


def squeeze(c: Column) -> Column:
    """Collapse white-space runs to one space and trim."""
    return F.btrim(F.regexp_replace(c, r"[\s\u00a0\ufeff]+", " "), F.lit(" "))


def header_text(c: Column) -> Column:
    """Header comparison form: collapsed, lower case, without curly quotes."""
    return F.translate(F.lower(squeeze(c)), QUOTES, "")


def label_text(c: Column) -> Column:
    """Label comparison form: header form with every dash written as a plain tight hyphen."""
    return F.regexp_replace(header_text(c), "\\s*[-\u2013\u2014]\\s*", "-")


def header_fold(c: Column) -> Column:
    """Header form in which a slash between words counts as a space."""
    return squeeze(F.regexp_replace(header_text(c), r"[\s/]*/[\s/]*", " "))


def leading_key(c: Column) -> Column:
    """The digits a value starts with, else the whole value."""
    return F.ltrim(F.regexp_extract(c, r"(?s)^(\s*[0-9]+|.*)", 1))


def fold_breaks(c: Column) -> Column:
    """Line breaks and tabs, with the blanks around them, become one space."""
    return F.regexp_replace(c, r"[ \t]*[\r\n\t]+[ \t]*", " ")


def alphanumeric(c: Column) -> Column:
    """Lower-case letters and digits only, for comparing texts that differ in punctuation."""
    return F.regexp_replace(F.lower(c), "[^a-z0-9]", "")


def padded_code(c: Column, width: int) -> Column:
    """Leading number padded with zeros; NULL when there is none."""
    k = leading_key(trimmed(c))
    return F.when(k.rlike("^[0-9]+$"), F.lpad(k, F.greatest(F.length(k), F.lit(width)), F.lit("0")))


def unpadded_code(c: Column) -> Column:
    """Numeric codes lose their leading zeros; others pass through."""
    return F.regexp_replace(c, "^0+(?=[0-9]+$)", "")


def last_pin(c: Column) -> Column:
    """The last run of exactly six digits, NULL when there is none."""
    return F.try_element_at(F.regexp_extract_all(c, F.lit("(?<![0-9])([0-9]{6})(?![0-9])"), F.lit(1)), F.lit(-1))


def words(c: Column) -> Column:
    """array of the words between white space."""
    return F.filter(F.split(c, r"[\s\u00a0\ufeff]+"), lambda w: w != "")


def name_parts(c: Column) -> Column:
    """struct(first word, second word, everything after)."""
    return let(F.split(squeeze(c), " "), lambda w: F.struct(
        F.nullif(F.get(w, F.lit(0)), F.lit("")).alias("first"), F.get(w, F.lit(1)).alias("second"),
        F.nullif(F.array_join(F.slice(w, F.lit(3), F.size(w)), " "), F.lit("")).alias("rest")))


def address_chunks(c: Column, width: int = 40, count: int = 3) -> Column:
    """array of fixed-size slices, each trimmed; blank slices are NULL."""
    return let(clean(c), lambda t: F.array(*[clean(F.substring(t, 1 + i * width, width)) for i in range(count)]))


# Control characters and how they are spelt out.
_ESCAPES = [("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"),
            *[(chr(n), f"\\x{n:02x}") for n in [*range(1, 9), 11, 12, *range(14, 32), 127]]]


def printable(c: Column) -> Column:
    """Control characters spelt out so a fragment fits on one line."""
    def spell(text: Column) -> Column:
        for char, name in _ESCAPES:
            text = F.replace(text, F.lit(char), F.lit(name))
        return text
    return let(c, lambda t: F.when(t.rlike("[\\x01-\\x1f\\x7f]"), spell(t)).otherwise(t))


def unix_lines(c: Column) -> Column:
    """CRLF and lone CR become LF."""
    return F.regexp_replace(c, "\r\n?", "\n")


def ellipsis(c: Column, limit: int = 160) -> Column:
    return let(c, lambda t: F.when(F.length(t) > limit, F.concat(F.substring(t, 1, limit - 1), F.lit("\u2026"))).otherwise(t))


def column_letter(n: Column) -> Column:
    """1 -> A, 26 -> Z, 27 -> AA, up to three letters."""
    zero = n - 1
    one = F.chr(F.lit(65) + zero % 26)
    tens = F.floor(zero / 26) - 1
    two = F.concat(F.chr(F.lit(65) + tens % 26), one)
    hundreds = F.floor(tens / 26) - 1
    return F.when(n <= 26, one).when(n <= 702, two).otherwise(F.concat(F.chr(F.lit(65) + hundreds % 26), two))


def letter_column(letters: str) -> int:
    """A -> 1, AA -> 27 (used while the plan is built)."""
    n = 0
    for ch in letters.upper():
        n = n * 26 + ord(ch) - 64
    return n
