"""States, PIN circles, free-text addresses and phones.

An address is read in steps, each of which names fields of a party that earlier steps have made.  ``Parties`` takes the steps over an
array column, for callers that have one expression to give; Spark interprets functions over arrays, so ``PartyRows`` takes the same
steps over rows, a party each, whose fields are plain columns that are compiled.  No step names a long expression twice.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..specs import catalogues
from .lookups import literal_map, lookup, lookup_list
from .text import clean, fold_breaks, known, known_text, last_pin, let, one_line, squeeze, trimmed

STATE_NAMES = catalogues.COMMERCIAL_STATE
_NEEDLES = catalogues.state_needles()
_WORDS = [[w for w in re.split(r"[^a-z0-9]+", n) if w] for n, _ in _NEEDLES]
# Words of a state may be joined by blanks, '&', '.', ',', '-' or nothing; the name must start a word
# and must not run on into further letters (digits may follow: 'Gujarat396191').
# Names are filed by their first letter, in the order they have: a word that begins with no state's letter is passed over at once.
_BY_LETTER: dict[str, list[str]] = {}
for _name in dict.fromkeys(r"[\s&.,-]*".join(ws) for ws in _WORDS):
    _BY_LETTER.setdefault(_name[0], []).append(_name[1:])
_STATE_PATTERN = r"(?<![a-z0-9_])(?:" + "|".join(f"{letter}(?:{'|'.join(rest)})" for letter, rest in _BY_LETTER.items()) + r")(?![a-z])"
_STATE_BY_SQUASHED = {"".join(ws): code for ws, (_, code) in zip(_WORDS, _NEEDLES)}
_STATE_BY_NAME = {n: code for n, code in reversed(_NEEDLES)}
_CITIES = catalogues.city_codes()
# Towns in one word that no check finds fault with.
_SOUND_CITIES = [c for c in _CITIES if c.isalpha() and c.isascii() and c not in _STATE_BY_NAME]
_MARK = "\x01"
_INDIA = r"(?i)[.,\s]*india\.?\s*$"
PARTY_INPUTS = ("raw", "line1", "line2", "line3", "city", "district", "state", "pin",
                "mobile", "contact", "std", "landline")


def typo_budget(length: int) -> int:
    """Edits tolerated for a name of this many letters."""
    return 0 if length < 6 else 1 if length < 9 else 2


def state_name(code: Column) -> Column:
    return lookup(STATE_NAMES, code)


def state_from_pin(pin: Column) -> Column:
    """State code of a PIN's postal circle; three-digit prefixes first."""
    circles = literal_map(catalogues.pin_prefix_codes())
    return F.when(pin.rlike("^[0-9]{6}$"), F.coalesce(
        F.try_element_at(circles, F.substring(pin, 1, 3)), F.try_element_at(circles, F.substring(pin, 1, 2))))


def named_state(c: Column) -> Column:
    """State typed in its own column, as a name or a code."""
    def resolve(s: Column) -> Column:
        padded = F.lpad(s, F.greatest(F.length(s), F.lit(2)), F.lit("0"))
        return F.coalesce(lookup(_STATE_BY_NAME, F.lower(s)), F.when(state_name(padded).isNotNull(), padded))
    return let(known(c), resolve)


def state_hits(lower: Column) -> Column:
    return F.regexp_extract_all(lower, F.lit(_STATE_PATTERN), F.lit(0))


def state_in_text(c: Column) -> Column:
    """Code of the last state named in a text; a longer name beats one it contains."""
    hit = F.try_element_at(state_hits(F.lower(c)), F.lit(-1))
    return lookup(_STATE_BY_SQUASHED, F.regexp_replace(hit, r"[\s&.,-]", ""))


def _budget(name: Column) -> Column:
    return F.when(F.length(name) < 9, 1).otherwise(2)


def _within_budget(word: Column, names: Column) -> Column:
    """First of the names (six letters or more) within its typo budget of a word."""
    near = F.filter(names, lambda n: (F.abs(F.length(n) - F.length(word)) <= _budget(n))
                    & (F.call_function("levenshtein", word, n, _budget(n)) >= 0))
    return F.get(near, F.lit(0))


def _by_length(names: list[str]) -> dict[str, list[str]]:
    """Word length to the names that can lie within their typo budget of such a word."""
    longest = max(len(n) for n in names) + 2
    near = {str(m): [n for n in names if abs(len(n) - m) <= typo_budget(len(n))] for m in range(4, longest + 1)}
    return {m: ns for m, ns in near.items() if ns}


_LONG_STATES = [n for n, _ in _NEEDLES if typo_budget(len(n)) > 0]
_STATES_BY_LENGTH = _by_length(_LONG_STATES)
_STATES_BY_CODE = {code: [n for n, c in _NEEDLES if c == code and n in set(_LONG_STATES)] for code in STATE_NAMES}
_CITIES_BY_LENGTH = _by_length([n for n in _CITIES if typo_budget(len(n)) > 0])


def _pieces(name: str) -> list[str]:
    """The name in one piece more than its typo budget: a text within the budget holds one of them unchanged."""
    parts = typo_budget(len(name)) + 1
    cuts = [len(name) * i // parts for i in range(parts + 1)]
    return [name[a:b] for a, b in zip(cuts, cuts[1:])]


# What must stand in a text for any near miss of one of a state's spellings.
_PIECES_BY_CODE = {code: sorted({p for n in names for p in _pieces(n)}) for code, names in _STATES_BY_CODE.items() if names}


def _may_misspell(words: Column, circle: Column) -> Column:
    """Whether the words, a blank between each, hold a piece of a spelling of the circle's state: a few searches for plain text decide
    most addresses, before any run of words is built or measured."""
    return let(F.array_join(words, " "), lambda text: F.exists(lookup_list(_PIECES_BY_CODE, circle), lambda p: F.contains(text, p)))


def _runs(words: Column, names: Callable[[Column], Column], since: Column) -> Column:
    """Runs of one to three words that nearly spell one of the names offered for them, by where they end, from the word ``since`` on;
    structs (last, first, name) of word ordinals, the earliest start of a run with the same end only."""
    def ending(words: Column) -> Callable[[Column], Column]:
        def at(last: Column) -> Column:
            def one(n: int) -> Column:
                run = F.array_join(F.slice(words, last - n + 1, n), " ")
                name = F.when(last >= n, let(run, lambda r: _within_budget(r, names(r))))
                return F.struct(last.alias("last"), (last - n + 1).alias("first"), name.alias("name"))
            return F.get(F.filter(F.array(one(3), one(2), one(1)), lambda r: r["name"].isNotNull()), F.lit(0))
        return at

    def search(words: Column) -> Column:
        ends = F.sequence(since, F.greatest(F.size(words), F.lit(1)))
        return F.filter(F.transform(ends, ending(words)), lambda r: r.isNotNull())

    return search(words)


def fuzzy_state(lower: Column, circle: Column) -> Column:
    """A misspelt state confirmed by the PIN's circle: struct(last, first, code), word ordinals.

    The last near miss in the text decides.  The few spellings of the circle's own state are tried first; only if one of them fits
    are all spellings searched, from there on."""
    def search(words: Column) -> Column:
        own = let(lookup_list(_STATES_BY_CODE, circle), lambda names: F.try_element_at(_runs(words, lambda r: names, F.lit(1)), F.lit(-1)))
        near = F.when(F.coalesce(_may_misspell(words, circle), F.lit(False)), own)
        # a later near miss of any state ends where the last one of the own state does, or after it
        last = let(near, lambda o: F.when(o.isNotNull(), F.try_element_at(
            _runs(words, lambda r: lookup_list(_STATES_BY_LENGTH, F.length(r).cast("string")), o["last"]), F.lit(-1))))
        return let(last, lambda r: F.when(r.isNotNull(), F.struct(r["last"].alias("last"), r["first"].alias("first"), lookup(_STATE_BY_NAME, r["name"]).alias("code"))))

    return let(F.regexp_extract_all(lower, F.lit("[a-z]+"), F.lit(0)), search)


def _word_offset(lower: Column, ordinal: Column) -> Column:
    """Characters before the given word of a text."""
    words = F.regexp_extract_all(lower, F.lit("[a-z]+"), F.lit(0))
    gaps = F.split(lower, "[a-z]+")
    return (F.length(F.array_join(F.slice(gaps, F.lit(1), ordinal), ""))
            + F.length(F.array_join(F.slice(words, F.lit(1), ordinal - 1), "")))


def clean_city(c: Column) -> Column:
    """City token without country word, trailing PIN and trailing punctuation."""
    t = F.regexp_replace(c, _INDIA, "")
    t = F.regexp_replace(t, r"[\s-]*[0-9]{6}\s*$", "")
    return clean(F.regexp_replace(t, r"[\s,-]+$", ""))


def city_notes(city: Column) -> Column:
    """Findings about a city value, as an array of messages."""
    none = F.array().cast("array<string>")

    def near(w: Column) -> Column:
        unknown = (F.length(w) >= 6) & lookup(_CITIES, w).isNull()
        return F.when(unknown, _within_budget(w, lookup_list(_CITIES_BY_LENGTH, F.length(w).cast("string"))))

    def typo(w: Column) -> Column:
        return F.concat(F.lit('Town "'), city, F.lit('": is "'), F.upper(w), F.lit('" meant to be "'),
                        F.initcap(near(w)), F.lit('"?'))

    def check(lower: Column) -> Column:
        as_state = state_name(lookup(_STATE_BY_NAME, lower))
        locality = F.when(lower.rlike("[0-9]|^[^ ]+ [^ ]+ "), F.concat(F.lit('Town "'), city, F.lit('" seems to hold more than the name of a town.')))
        return F.when(as_state.isNotNull(), F.array(F.concat(
            F.lit('Town "'), city, F.lit('" names a state ('), as_state, F.lit(").")))
        ).otherwise(F.array_compact(F.concat(F.array(locality), F.transform(F.split(lower, " "), typo))))

    sound = city.isNull() | F.lower(city).isin(_SOUND_CITIES)
    return F.when(sound, none).otherwise(F.coalesce(let(F.lower(squeeze(city)), check), none))


def phone_note(who: Column, mobile: Column) -> Column:
    def check(digits: Column) -> Column:
        bad = ~digits.rlike("^(?:91|0)?[6-9][0-9]{9}$")
        return F.when(bad & digits.rlike("^0[1-5]"), F.concat(
            who, F.lit(': "'), mobile, F.lit('" begins like a landline and stands in the mobile column.'))
        ).when(bad, F.concat(who, F.lit(': "'), mobile, F.lit('" cannot be an Indian mobile number.')))
    # a number written plainly is not looked at twice
    return F.when(~mobile.rlike("^(?:91|0)?[6-9][0-9]{9}$"), let(F.translate(mobile, " \t\n\r-+", ""), check))


class Parties:
    """An array of party structs, extended step by step; fields are dropped as soon as nothing needs them,
    because every step copies what it carries."""

    def __init__(self, column: Column, fields: tuple[str, ...]):
        self.column, self.fields = column, fields

    def add(self, drop: tuple[str, ...] = (), **steps: Callable[[Column], Column]) -> "Parties":
        kept = tuple(f for f in self.fields if f not in drop)
        col = F.transform(self.column, lambda p: F.struct(
            *[p[f].alias(f) for f in kept], *[make(p).alias(n) for n, make in steps.items()]))
        return Parties(col, (*kept, *steps))


class _Fields:
    """The fields of the party that a row is, as columns."""

    def __getitem__(self, name: str) -> Column:
        return F.col(f"_p_{name}")


class PartyRows:
    """Parties as rows, a field a column, extended step by step as ``Parties`` are; ``carried`` columns go along, the first of them a
    key without meaning to the optimizer.  Each step is a compiled projection of its own: one function over an array keeps it out of
    the stage's single method, which the JVM would interpret."""

    def __init__(self, df: DataFrame, carried: tuple[str, ...], fields: tuple[str, ...]):
        self.df, self.carried, self.fields = df, carried, fields

    @classmethod
    def of(cls, df: DataFrame, carried: tuple[str, ...], **fields: Column) -> "PartyRows":
        return cls(df, carried, ()).add(**{n: (lambda p, c=c: c) for n, c in fields.items()})

    def add(self, drop: tuple[str, ...] = (), **steps: Callable[[_Fields], Column]) -> "PartyRows":
        kept, at = tuple(f for f in self.fields if f not in drop), _Fields()
        df = self.df.select(let(F.col(self.carried[0]), lambda k: k).alias(self.carried[0]), *self.carried[1:],
                            *[F.col(f"_p_{f}") for f in kept], *[make(at).alias(f"_p_{n}") for n, make in steps.items()])
        return PartyRows(df, self.carried, (*kept, *steps))


def _start_of_state(p: Column) -> Column:
    # Splitting by the pattern would compile it for each text, replacing keeps it. The mark stands nowhere else in the text then,
    # and no pattern tells it from what takes its place.
    unmarked = F.when(p["lower"].contains(_MARK), F.translate(p["lower"], _MARK, "\x02")).otherwise(p["lower"])
    marked = F.regexp_replace(unmarked, _STATE_PATTERN, _MARK)
    exact = F.length(p["full"]) - F.length(F.substring_index(marked, _MARK, -1)) - F.length(p["hit"])
    return F.when(p["hit"].isNotNull(), exact).when(p["fuzzy"].isNotNull(), _word_offset(p["lower"], p["fuzzy"]["first"]))


def _typed_state(p: Column) -> Column:
    last = p["fuzzy"]["last"]
    words = F.regexp_extract_all(p["lower"], F.lit("[a-z]+"), F.lit(0))
    end = _word_offset(p["lower"], last) + F.length(F.element_at(words, last))
    return F.substring(p["full"], p["start"] + 1, end - p["start"])


PARSED = ("full", "t_pin", "t_circle", "spelling", "t_line1", "t_city", "p_state")


def split_free_text(raws: Column) -> Parties:
    """Read line 1, city, state and PIN out of an array of free-text addresses.

    With a state in the text the whole text is line 1 and the city stands before the state; otherwise
    the text is street, city, PIN and the state follows from the city or the PIN."""
    return _read(Parties(F.transform(raws, lambda r: F.struct(known(fold_breaks(r)).alias("full"))), ("full",)))


def _read(p: Parties | PartyRows) -> Parties | PartyRows:
    """Parties with the field ``full``, a free text, and what is read in it (``PARSED``)."""
    p = p.add(lower=lambda p: F.lower(p["full"]), t_pin=lambda p: last_pin(p["full"]))
    p = p.add(hit=lambda p: F.try_element_at(state_hits(p["lower"]), F.lit(-1)), t_circle=lambda p: state_from_pin(p["t_pin"]))
    # A near miss may be an ordinary word, so it counts only when the PIN's circle agrees.
    p = p.add(fuzzy=lambda p: F.when(p["hit"].isNull() & p["t_circle"].isNotNull(), let(
        fuzzy_state(p["lower"], p["t_circle"]), lambda n: F.when(n["code"] == p["t_circle"], n))))
    p = p.add(start=_start_of_state, t_state=lambda p: F.coalesce(
        lookup(_STATE_BY_SQUASHED, F.regexp_replace(p["hit"], r"[\s&.,-]", "")), p["fuzzy"]["code"]))
    p = p.add(
        drop=("lower", "hit", "fuzzy"),
        before=lambda p: F.regexp_replace(F.substring(p["full"], F.lit(1), p["start"]), r"[\s,-]+$", ""),
        tail=lambda p: F.when(p["start"].isNull(), F.coalesce(clean(F.regexp_replace(p["full"], _INDIA, "")), F.lit(""))),
        spelling=lambda p: F.when(p["fuzzy"].isNotNull(), F.concat(
            F.lit('State "'), _typed_state(p), F.lit('" in the address looks misspelt; read as '),
            state_name(p["fuzzy"]["code"]), F.lit(" ("), p["fuzzy"]["code"], F.lit(")."))),
    )
    p = p.add(street=lambda p: F.when(p["start"].isNull() & p["t_pin"].isNotNull(), F.regexp_extract(
        p["tail"], r"(?s)^(.*)(?<![0-9])[0-9]{6}(?![0-9])", 1)))
    p = p.add(
        drop=("before", "tail", "street"),
        t_line1=lambda p: F.when(p["start"].isNotNull(), p["full"])
        .when(p["street"].isNull(), trimmed(p["tail"]))
        .when(p["street"].contains(","), clean(F.regexp_replace(
            F.regexp_extract(p["street"], r"(?s)^(.*),[^,]*$", 1), r"[\s,]+$", ""))),
        t_city=lambda p: F.when(
            p["start"].isNotNull(),
            F.when(p["before"].contains(","), trimmed(F.substring_index(p["before"], ",", -1)))
            .otherwise(clean(F.regexp_extract(p["before"], r"(\S*)$", 1))))
        .when(p["street"].isNotNull(), clean_city(F.substring_index(p["street"], ",", -1))),
    )
    return p.add(drop=("start", "t_state"), p_state=lambda p: F.coalesce(
        p["t_state"], F.when(p["start"].isNull(), F.coalesce(lookup(_CITIES, F.lower(p["t_city"])), p["t_circle"]))))


def _given(cell: Column) -> Column:
    return F.when(cell.isNotNull(), known_text(cell))  # most are not given, and asking that is far cheaper


def _merged(p: Column | _Fields, t: Column | _Fields) -> dict[str, Column]:
    """The parts of an address: explicit columns of a party win over what its free text tells."""
    return {
        "spelling": t["spelling"], "has_text": t["full"].isNotNull(), "r_line1": F.coalesce(_given(p["line1"]), t["t_line1"]),
        "r_line2": _given(p["line2"]), "r_line3": _given(p["line3"]), "r_city": F.coalesce(_given(p["city"]), t["t_city"]),
        "r_given_district": _given(p["district"]), "typed": _given(p["state"]), "p_state": t["p_state"],
        "r_pin": F.coalesce(_given(p["pin"]), t["t_pin"]), "r_mobile": F.coalesce(_given(p["mobile"]), _given(p["contact"])),
        "r_std": _given(p["std"]), "r_landline": _given(p["landline"])}


RESOLVED = ("r_line1", "r_line2", "r_line3", "r_city", "r_district", "r_state", "r_pin",
            "r_mobile", "r_std", "r_landline", "notes", "phone_note", "no_state")


def resolve_parties(parties: Column, keep: tuple[str, ...] = ("who",)) -> Column:
    """Explicit address columns win over parsed text: array of structs with ``keep`` and the resolved parts,
    phones and findings."""
    parsed = split_free_text(F.transform(parties, lambda p: p["raw"]))
    merged = F.zip_with(parties, parsed.column, lambda p, t: F.struct(
        *[p[k].alias(k) for k in keep], *[c.alias(n) for n, c in _merged(p, t).items()]))
    return _resolved(Parties(merged, (*keep, *_MERGED))).column


_MERGED = ("spelling", "has_text", "r_line1", "r_line2", "r_line3", "r_city", "r_given_district", "typed", "p_state", "r_pin", "r_mobile", "r_std", "r_landline")


def resolve_rows(df: DataFrame, carried: tuple[str, ...], **fields: Column) -> DataFrame:
    """``resolve_parties`` of rows that are a party each: ``fields`` are its ``PARTY_INPUTS`` and whatever else is to be kept, as plain columns.
    Gives the carried columns, the kept fields and the resolved parts as a struct ``party``."""
    keep = tuple(n for n in fields if n not in PARTY_INPUTS)
    null = F.lit(None).cast("string")
    p = PartyRows.of(df, carried, **{n: fields.get(n, null) for n in PARTY_INPUTS}, **{n: fields[n] for n in keep})
    p = p.add(line=lambda p: one_line(p["raw"])).add(drop=("raw", "line"), full=lambda p: known_text(p["line"]))
    p = _read(p).add(drop=(*PARTY_INPUTS, *PARSED), **{n: (lambda p, c=c: c) for n, c in _merged(_Fields(), _Fields()).items()})
    p = _resolved(p)
    return p.df.select(*carried, F.struct(*[F.col(f"_p_{n}").alias(n) for n in p.fields]).alias("party"))


def _resolved(p: Parties | PartyRows) -> Parties | PartyRows:
    """States, PIN circles and findings of merged parties."""
    p = p.add(drop=("r_given_district",), circle=lambda p: state_from_pin(p["r_pin"]),
              r_district=lambda p: F.coalesce(p["r_given_district"], p["r_city"]))
    p = p.add(drop=("typed", "p_state"), r_state=lambda p: F.when(p["typed"].isNotNull(), named_state(p["typed"]))
              .otherwise(F.coalesce(p["p_state"], p["circle"])))
    exempt = catalogues.PIN_EXEMPT_STATES
    p = p.add(pin_note=lambda p: F.when(
        (p["circle"] != p["r_state"]) & ~p["r_state"].isin(*exempt) & ~p["circle"].isin(*exempt),
        F.concat(F.lit("PIN "), p["r_pin"], F.lit(" belongs to "), state_name(p["circle"]), F.lit(" ("),
                 p["circle"], F.lit(") but the state is "), state_name(p["r_state"]), F.lit(" ("), p["r_state"],
                 F.lit("); correct the PIN or the state."))))
    none = F.array().cast("array<string>")
    return p.add(
        drop=("spelling", "pin_note", "circle", "has_text"),
        notes=lambda p: F.concat(
            F.when(p["spelling"].isNull() & p["pin_note"].isNull(), none).otherwise(F.array_compact(F.array(p["spelling"], p["pin_note"]))),
            city_notes(p["r_city"])),
        phone_note=lambda p: phone_note(p["who"], p["r_mobile"]),
        no_state=lambda p: (p["has_text"] | p["r_line1"].isNotNull()) & p["r_state"].isNull(),
    )


def party(who: Column, **inputs: Column) -> Column:
    """One party struct; inputs that are not given are NULL."""
    null = F.lit(None).cast("string")
    return F.struct(who.alias("who"), *[inputs.get(n, null).cast("string").alias(n) for n in PARTY_INPUTS])


def split_address(raw: Column) -> Column:
    """struct(line1, city, state_code, pin, note) of one free-text address."""
    return F.get(F.transform(split_free_text(F.array(raw)).column, lambda x: F.struct(
        x["t_line1"].alias("line1"), x["t_city"].alias("city"), x["p_state"].alias("state_code"),
        x["t_pin"].alias("pin"), x["spelling"].alias("note"))), F.lit(0))


def resolve_address(**inputs: Column) -> Column:
    """Resolved address of one party given as free text and/or separate columns."""
    return F.get(resolve_parties(F.array(party(F.lit("Party"), **inputs))), F.lit(0))
