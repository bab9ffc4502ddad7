"""Field, segment and format descriptions, and the small text notation they are written in.

A layout is a table of text lines, ``key | label | marks``.  Marks: ``req`` (blank is an error),
``warn`` (blank is a warning), ``date``, ``number``, ``codes:NAME``, ``default:TEXT``, ``width:N``,
``cap:N``, ``tlv:NN``, ``left``/``right`` (padding side), ``zero`` (pad with 0), ``when:NAME``
(required only when the named condition holds), ``alias:TEXT``, ``section:N`` (of the catalogue in the
format document that lists the field's codes).
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field, replace

TEXT, NUMBER, DATE = "text", "number", "date"


@dataclass(frozen=True)
class Field:
    key: str
    label: str
    kind: str = TEXT
    required: bool = False
    when: str | Callable | None = None  # a named condition, or (reader of the row's fields by key) -> Column
    severity: str = "error"
    codes: tuple[str, ...] | None = None
    default: str = ""
    width: int | None = None
    cap: int | None = None
    tlv: str = ""
    pad_left: bool | None = None
    pad_char: str | None = None
    aliases: tuple[str, ...] = ()
    section: str = ""

    @property
    def padding(self) -> tuple[bool, str]:
        """(pad on the left?, fill character): numbers default to left/0, the rest to right/space."""
        number = self.kind == NUMBER
        left = number if self.pad_left is None else self.pad_left
        return left, self.pad_char or ("0" if number else " ")


@dataclass(frozen=True)
class Segment:
    tag: str
    fields: tuple[Field, ...]
    encoding: str = "delimited"  # delimited | fixed | tlv | concatenated
    flag: int = 0
    cardinality: str = "many"  # one | optional | many | header | trailer
    tlv_prefix: str = ""
    sheet: str | None = None

    def index(self, key: str) -> int:
        for i, f in enumerate(self.fields):
            if f.key == key:
                return i
        raise KeyError(f"{self.tag} has no field {key}")

    def has(self, key: str) -> bool:
        return any(f.key == key for f in self.fields)

    def with_field(self, key: str, **changes) -> "Segment":
        return replace(self, fields=tuple(replace(f, **changes) if f.key == key else f for f in self.fields))


@dataclass(frozen=True)
class Format:
    id: str
    label: str
    version: str
    extension: str
    header: Segment
    body: tuple[Segment, ...]
    trailer: Segment | None
    header_values: Callable  # (meta column resolver) -> {field key: Column}
    trailer_values: Callable | None = None
    one_physical_line: bool = False
    line_end: str = "\r\n"
    final_line_end: bool = False
    glue_header: bool = False
    charset: str = "ISO-8859-1"
    borrower_rules: bool = False
    account_rule: bool = False
    member_field: str | None = None
    flat_sheet: "FlatSheet | None" = None
    aliases: tuple[str, ...] = ()
    deprecated: bool = False

    def segment(self, tag: str) -> Segment:
        for s in self.body:
            if s.tag == tag:
                return s
        raise KeyError(tag)


@dataclass(frozen=True)
class FlatSheet:
    """How one-row-per-borrower input sheets are located and bound."""

    sheet: str
    header_row: int
    headers: Mapping[str, str] = field(default_factory=dict)  # header text -> input key
    letters: Mapping[str, str] = field(default_factory=dict)  # column letter -> input key
    header_cells: Mapping[str, str] = field(default_factory=dict)  # cell address -> meta key
    sources: Mapping[str, tuple[str, ...]] = field(default_factory=dict)  # wire key -> input keys
    date_keys: tuple[str, ...] = ()
    match: str = "prefix"  # prefix | exact | letter


def layout(text: str, catalogues: Mapping[str, Mapping[str, str]] | None = None, tag: str | None = None) -> tuple[Field, ...]:
    """Read a layout table; with ``tag`` the record marker becomes field 0."""
    fields = [Field("_tag", "Segment Identifier", required=True, default=tag)] if tag else []
    for line in text.strip().splitlines():
        parts = [p.strip() for p in line.split("|")]
        key, label = parts[0], parts[1]
        props: dict = {}
        for mark in parts[2].split() if len(parts) > 2 and parts[2] else []:
            name, _, arg = mark.partition(":")
            if name == "req":
                props["required"] = True
            elif name == "warn":
                props.update(required=True, severity="warning")
            elif name in (DATE, NUMBER):
                props["kind"] = name
            elif name == "codes":
                props["codes"] = tuple((catalogues or {})[arg])
            elif name == "default":
                props["default"] = arg
            elif name == "width":
                props["width"] = int(arg)
            elif name == "cap":
                props["cap"] = int(arg)
            elif name == "tlv":
                props["tlv"] = arg
            elif name == "left":
                props["pad_left"] = True
            elif name == "right":
                props.update(pad_left=False, pad_char=" ")
            elif name in ("when", "section"):
                props[name] = arg
            elif name == "alias":
                props["aliases"] = (*props.get("aliases", ()), arg.replace("_", " "))
            else:
                raise ValueError(f"unknown mark {mark!r} in {line!r}")
        fields.append(Field(key, label, **props))
    return tuple(fields)


def code_table(text: str) -> dict[str, str]:
    """``code description`` per line."""
    out = {}
    for line in text.strip().splitlines():
        code, _, name = line.strip().partition(" ")
        out[code] = name.strip()
    return out
