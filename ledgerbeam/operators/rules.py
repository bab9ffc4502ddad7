"""Rules of a lender's own, as objects that declare what they read.

A rule names the fields it reads by segment, and its scope: a row, a borrower, or a submission (as a whole, or by a key such as an
account number). All rules of a scope share one plan, built from the union of the declared fields: row rules are checked in one pass,
borrower rules from one aggregate, and only the declared fields are taken out of the envelope. A rule that asks for a field which it has
not declared fails when the plan is built.

Blank fields read as NULL; a rule whose condition is NULL holds. A borrower or submission without a row of the declared segments has no
finding. Totals are aggregates, combined before the shuffle, so that no borrower or submission is gathered in one task; rows of a hot key
are joined with its totals under salts."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..specs.model import Format
from .cross_rows import _issue_rows
from .partitioning import HOT_ROWS, attach, cut, group_value
from .segments import ORDER, value

ROW, BORROWER, FILE = "row", "borrower", "file"
#: Findings of such rules come after those of the layout on the same row, borrower or file.
AFTER = 2_000_000


class Reader:
    """What a rule may read: ``read("CR.accountNumber")``, ``read("n")`` for its total n, ``read.rows("CR")`` for whether a row is a CR row."""

    def __init__(self, rule: str, columns: Mapping[str, Column]):
        self._rule, self._columns = rule, columns

    def __call__(self, name: str) -> Column:
        if name not in self._columns:
            raise KeyError(f"rule {self._rule} reads {name}, which it does not declare")
        return self._columns[name]

    def rows(self, tag: str) -> Column:
        return F.col("tag") == tag


Expression = Callable[[Reader], Column]


@dataclass(frozen=True)
class Rule:
    name: str
    scope: str
    reads: Mapping[str, Sequence[str]]  # segment tag -> field keys
    failed: Expression
    message: Expression
    totals: Mapping[str, Expression] = field(default_factory=dict)  # aggregates over the borrower, the key or the submission
    key: Expression | None = None  # scope file: rows with one key are held together, and each that fails is shown
    field_key: str = ""
    severity: str = "error"
    bypassable: bool = True

    def __post_init__(self):
        if self.scope not in (ROW, BORROWER, FILE):
            raise ValueError(f"rule {self.name}: scope {self.scope!r} is none of {ROW}, {BORROWER}, {FILE}")
        if not self.reads or ((self.scope == ROW or self.key) and len(self.reads) != 1):
            raise ValueError(f"rule {self.name}: rules on rows or keys read one segment, others one or more")
        if self.key and self.scope != FILE:
            raise ValueError(f"rule {self.name}: only rules of a file have keys")
        if (self.scope == ROW) == bool(self.totals):
            raise ValueError(f"rule {self.name}: rules of borrowers and files need totals, rules of rows have none")

    @property
    def fields(self) -> list[tuple[str, str]]:
        return [(tag, key) for tag, keys in self.reads.items() for key in keys]


def _narrow(segments: DataFrame, fmt: Format, rules: Sequence[Rule]) -> tuple[DataFrame, dict[tuple[str, str], str]]:
    """Rows of the declared segments, with one text column for each declared field."""
    fields = {f: f"v{i}" for i, f in enumerate(dict.fromkeys(f for r in rules for f in r.fields))}
    tags = list(dict.fromkeys(t for r in rules for t in r.reads))
    columns = [F.when(F.col("tag") == tag, value(fmt.segment(tag), key)).alias(name) for (tag, key), name in fields.items()]
    return segments.filter(F.col("tag").isin(*tags)).select("submission_id", "ac_no", "row_no", "tag", "sheet", *ORDER, *columns), fields


def _reader(rule: Rule, fields: Mapping[tuple[str, str], str], totals: Mapping[str, Column] | None = None) -> Reader:
    columns = {f"{tag}.{key}": F.col(fields[tag, key]) for tag, key in rule.fields} if totals is None or rule.key else {}
    return Reader(rule.name, {**columns, **(totals or {})})


def _finding(rule: Rule, fmt: Format, at: int, read: Reader, shown: Column) -> Column:
    tag = next(iter(rule.reads))
    label = next((f.label for f in fmt.segment(tag).fields if f.key == rule.field_key), None)
    return F.when(rule.failed(read), F.struct(
        F.lit(rule.severity).alias("severity"), F.lit(rule.field_key).alias("field_key"), F.lit(label).cast("string").alias("field_label"),
        F.lit(rule.name).alias("rule"), rule.message(read).alias("message"), F.lit(f"{fmt.label}, rule {rule.name}").alias("reference"),
        shown.cast("string").alias("value"), F.lit(rule.bypassable).alias("bypassable"), F.lit(tag).alias("tag"), F.lit(AFTER + at).alias("item")))


FINDING = ("severity", "field_key", "field_label", "rule", "message", "reference", "value", "bypassable", "tag", "item")


def _shown(rows: DataFrame, findings: Sequence[Column], **places: Column) -> DataFrame:
    """Issue rows of the findings that are there."""
    kept = [c for c in ("submission_id", "ac_no", "sheet", "first_ord", "flag", "spec_ord", "seq") if c in rows.columns and c not in places]
    out = rows.withColumn("i", F.explode(F.array_compact(F.array(*findings)))).select(
        *kept, F.col("row_no").cast("bigint").alias("row_number"), "i", *[c.alias(n) for n, c in places.items()])
    found = {n: F.col(f"i.{n}") for n in FINDING}
    return _issue_rows(out, **found, **{c: F.col(c) for c in ("flag", "spec_ord", "seq", "phase") if c in out.columns})


def _own(rule: Rule, fields: Mapping[tuple[str, str], str]) -> Column:
    """The value of the field that a finding on a row points to."""
    name = fields.get((next(iter(rule.reads)), rule.field_key))
    return F.col(name) if name else F.lit(None)


def _row_issues(segments: DataFrame, fmt: Format, rules: Sequence[tuple[int, Rule]]) -> DataFrame:
    rows, fields = _narrow(segments, fmt, [r for _, r in rules])
    found = [F.when(F.col("tag") == next(iter(r.reads)), _finding(r, fmt, at, _reader(r, fields), _own(r, fields))) for at, r in rules]
    return _shown(rows, found, stage=F.lit(0), phase=F.lit(0))


def _grouped(segments: DataFrame, fmt: Format, rules: Sequence[tuple[int, Rule]], keys: Sequence[str], **places: Column) -> DataFrame:
    """Rules over all rows of a borrower or of a submission: one aggregate for all of them."""
    rows, fields = _narrow(segments, fmt, [r for _, r in rules])
    totals = {(at, n): f"t{at}_{k}" for at, r in rules for k, n in enumerate(r.totals)}
    aggregates = [r.totals[n](_reader(r, fields)).alias(totals[at, n]) for at, r in rules for n in r.totals]
    own = [F.max(F.col("tag").isin(*r.reads)).alias(f"own{at}") for at, r in rules]  # rows of this rule, not only of the others
    first = F.struct(*ORDER)
    groups = rows.groupBy(*keys).agg(F.min("first_ord").alias("first_ord"), F.min_by("sheet", first).alias("sheet"), F.min_by("row_no", first).alias("row_no"), *own, *aggregates)
    found = [F.when(F.col(f"own{at}"), _finding(r, fmt, at, _reader(r, {}, {n: F.col(totals[at, n]) for n in r.totals}), F.lit(None))) for at, r in rules]
    return _shown(groups, found, **places)


def _key_issues(segments: DataFrame, fmt: Format, at: int, rule: Rule, hot_rows: int) -> DataFrame:
    """A rule over the rows of a submission that share a key; the finding stands on each row that fails."""
    rows, fields = _narrow(segments, fmt, [rule])
    read = _reader(rule, fields)
    rows = cut(rows.withColumn("key", rule.key(read)).filter("key is not null"), f"rule-{at}")  # read three times below
    names = {n: f"t{k}" for k, n in enumerate(rule.totals)}
    groups = group_value(rows, ("submission_id", "key"), *[rule.totals[n](read).alias(c) for n, c in names.items()])
    joined = attach(rows, groups, ("submission_id", "key"), ORDER, hot_rows=hot_rows)
    return _shown(joined, [_finding(rule, fmt, at, _reader(rule, fields, {n: F.col(c) for n, c in names.items()}), _own(rule, fields))], stage=F.lit(0), phase=F.lit(1))


def own_issues(segments: DataFrame, fmt: Format, rules: Sequence[Rule], hot_rows: int = HOT_ROWS) -> DataFrame | None:
    """The findings of ``rules`` on an envelope as an issue table; None without rules."""
    numbered = list(enumerate(rules))
    of = {scope: [(at, r) for at, r in numbered if r.scope == scope] for scope in (ROW, BORROWER, FILE)}
    parts = [_row_issues(segments, fmt, of[ROW])] if of[ROW] else []
    if of[BORROWER]:
        parts.append(_grouped(segments, fmt, of[BORROWER], ("submission_id", "ac_no"), stage=F.lit(2), phase=F.lit(0)))
    whole = [(at, r) for at, r in of[FILE] if not r.key]
    if whole:
        parts.append(_grouped(segments, fmt, whole, ("submission_id",), stage=F.lit(0), phase=F.lit(1), ac_no=F.lit("")))
    parts += [_key_issues(segments, fmt, at, r, hot_rows) for at, r in of[FILE] if r.key]
    out = None
    for part in parts:
        out = part if out is None else out.unionByName(part)
    return out
