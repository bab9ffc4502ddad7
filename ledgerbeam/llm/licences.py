"""License scans: exact lookup of whole texts, and of each of their lines, by digests of a canonical form.

The canonical form has letters A-Z lower-cased, copyright notices left out, equivalent spellings made one, and everything but
letters and digits made single blanks. A notice begins a line, or follows a licence's title there, and ends with its name: terms
on the same line stay. Digests of known licences are a small fixed table, built by the same expression from one-line notices and
from full texts (`licence_texts/`), each with its usual titles, without one, and without the appendix on how to apply it, and
joined by hash. Column functions and joins only.

A null text has the digest of an empty one and no licence; so does a text without letters and digits. A line that is a known
notice counts once a text, however often it stands there. Rows that are equal in id and canonical form share their notices.
Other columns pass through unless they are named like an output."""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Usual titles of the full texts, the one in `licence_texts/` having none.
TITLES = {
    "MIT": ("MIT License", "The MIT License", "The MIT License (MIT)", "MIT License (MIT)", "MIT"),
    "ISC": ("ISC License", "The ISC License", "ISC License (ISC)", "The ISC License (ISC)", "ISC"),
    "0BSD": ("BSD Zero Clause License", "Zero-Clause BSD", "Zero Clause BSD License", "0BSD License", "0BSD"),
    "BSD-2-Clause": ("BSD 2-Clause License", "The BSD 2-Clause License", "Simplified BSD License", "BSD 2-Clause \"Simplified\" License", "BSD License", "The BSD License", "BSD-2-Clause"),
    "BSD-3-Clause": ("BSD 3-Clause License", "The BSD 3-Clause License", "The 3-Clause BSD License", "New BSD License", "BSD 3-Clause \"New\" or \"Revised\" License", "BSD License", "The BSD License", "BSD-3-Clause"),
    "Zlib": ("zlib License", "The zlib License", "zlib/libpng License", "The zlib/libpng License"),
    "Unlicense": ("The Unlicense", "Unlicense"),
    "BSL-1.0": ("Boost Software License - Version 1.0 - August 17th, 2003", "Boost Software License 1.0"),
    "Apache-2.0": ("Apache License Version 2.0, January 2004 http://www.apache.org/licenses/", "Apache License Version 2.0, January 2004", "Apache License 2.0", "Apache License, Version 2.0"),
    "MPL-2.0": ("Mozilla Public License Version 2.0", "Mozilla Public License, version 2.0", "Mozilla Public License 2.0"),
    "GPL-2.0": ("GNU GENERAL PUBLIC LICENSE Version 2, June 1991", "GNU General Public License v2.0"),
    "GPL-3.0": ("GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007", "GNU General Public License v3.0"),
    "LGPL-2.1": ("GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999", "GNU Lesser General Public License v2.1"),
    "LGPL-3.0": ("GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007", "GNU Lesser General Public License v3.0"),
    "CC0-1.0": ("Creative Commons Legal Code CC0 1.0 Universal", "CC0 1.0 Universal"),
}
#: How the terms of known licences begin, after a notice on the same line.
OPENINGS = r"(?:permission (?:is hereby|to use)|redistribution and use|redistributions of|this (?:software|work|program|source code|is free)|terms and conditions|everyone is permitted|creative commons corporation|licen[cs]ed under|released under|1\. definitions)\b"
#: Words of terms that follow "copyright" where it names no holder.
TERMS = r"(?:holders?|owners?|ownership|notices?|laws?|line|disclaimers?|interests?|the|licen[cs]es?|on|in|of|to|by law|permissions?|patents?|statements?|also|like|those|treat(?:y|ies)|are|is|if|and|or|doctrines?|protections?|status)\b"
YEAR = r"(?:\b(?:19|20)\d\d\b|[\[<{][^\]>}\n]{1,40}[\]>}])"
#: Where the name of a notice ends if the line goes on: at terms, or at a stop that is no part of a name.
NAME_END = r"(?:$|(?=[^\p{L}\p{N}\n]" + OPENINGS + r")|(?<!\b(?:inc|ltd|co|corp|llc|gmbh|jr|sr|dr|st|al|[a-z]))(?=\.[ \t]+[\p{L}\p{N}]))"
RESERVED = r"all rights reserved\b[.,;)]*"
#: A notice: a mark and a name, a year and a name, or a name that ends as one of a group does. Looked for in lower case.
NOTICE = (r"(?:(?:portions |parts )?(?:copyright[ \t:]*(?:\(c\)|©|&copy;)|©|(?:copyright|\(c\))[ \t:,]*" + YEAR
          + r"|copyright[ \t:]+(?!" + TERMS + r")[^\n]{0,80}?(?:" + YEAR + r"|\b(?:contributors|authors|developers|team|project|foundation|inc|ltd|llc|corp|corporation|gmbh|all rights reserved)\b))"
          + r"[^\n]*?(?:[ \t.,;(]*" + RESERVED + "|" + NAME_END + r")|" + RESERVED + r")")
_TITLE = "|".join(sorted({re.sub(r"[^a-z0-9]+", r"[^\\p{L}\\p{N}\\n]+", t.lower().strip(")")) + r"\)?" for ts in TITLES.values() for t in ts}, key=lambda t: (-len(t), t)))
HOLDER_LINE = r"(?md)^([ \t#*/;-]*(?:(?:" + _TITLE.replace("license", "licen[cs]e") + r")[ \t.,:;-]*)?)" + NOTICE
#: Notices to be filled in, as appendices show them, wherever they stand.
TEMPLATE = r"copyright[^\p{L}\p{N}]+(?:c[^\p{L}\p{N}]+)?(?:year|yyyy)[^\p{L}\p{N}]+name[^\p{L}\p{N}]+of[^\p{L}\p{N}]+(?:copyright[^\p{L}\p{N}]+owner|author)"
#: Spellings that count as equal.
SPELLINGS = ((r"licence", "license"), (r"sub-license", "sublicense"), (r"non-commercial", "noncommercial"), (r"copyright([^\p{L}\p{N}]+)(?:owner|holder)s?", "copyright$1holder"), (r"https?://", "http "))
#: Texts of short licences and usual notices, by an id.
SHORT = (
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ("ISC", 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
)
#: Where the appendix of a full text begins, which many copies leave out, and whether the mark itself may stay.
APPENDIX = {"END OF TERMS AND CONDITIONS": True, "Exhibit A - ": False}
#: What follows the address of a holder, which counts to the notice on the same line.
PREAMBLE = "Everyone is permitted to copy"


def full_texts() -> list[tuple[str, str]]:
    """(license_id, text) of each full text with and without a title and an appendix."""
    texts = [*SHORT[:2], *[(p.stem.split("+")[0], p.read_text("utf-8")) for p in sorted((Path(__file__).parent / "licence_texts").glob("*.txt"))]]
    found = []
    for name, text in texts:
        bodies = [text]
        for mark, stays in APPENDIX.items():
            if mark in text:
                at = text.index(mark)
                bodies += [text[:at], text[: at + len(mark) * stays]]
        if PREAMBLE in text:
            bodies += [body[body.index(PREAMBLE) :] for body in bodies]
        found += [(name, head + body) for body in bodies for head in ("", *[t + "\n\n" for t in TITLES[name]])]
    return list(dict.fromkeys(found))


KNOWN = (*SHORT, *full_texts())


def canonical(text: Column) -> Column:
    """Canonical form, with line feeds kept between lines."""
    c = F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), TEMPLATE, "")
    c = F.regexp_replace(c, HOLDER_LINE, "$1")
    for pattern, one in SPELLINGS:
        c = F.regexp_replace(c, pattern, one)
    c = F.regexp_replace(c, r"[^\p{L}\p{N}\n]+", " ")
    return F.regexp_replace(c, r" ?\n[ \n]*", "\n")


def whole(form: Column) -> Column:
    return F.trim(F.translate(form, "\n", " "))


def known_licences(spark: SparkSession) -> DataFrame:
    """(digest, license_id): fixed, a row for each known text."""
    rows = spark.createDataFrame(list(KNOWN), "license_id string, text string")
    return rows.groupBy(F.sha2(whole(canonical(F.col("text"))), 256).alias("digest")).agg(F.min("license_id").alias("license_id"))


def scan(docs: DataFrame, id_column: str = "doc_id", text: str = "text", known: DataFrame | None = None) -> DataFrame:
    """`docs` without the text, with `text_sha256` (of the canonical form), `license_id` (of the whole text, or null) and `notices`
    (ids of the licences that lines name, sorted)."""
    known = F.broadcast(known_licences(docs.sparkSession)) if known is None else known
    outputs = ("text_sha256", "license_id", "notices")
    columns = [c for c in docs.columns if c not in (text, *outputs)]
    form = docs.select(F.struct(*columns).alias("row"), F.col(id_column).alias("_id"), canonical(F.col(text)).alias("_form"))
    form = form.withColumn("text_sha256", F.sha2(whole(F.col("_form")), 256))
    lines = form.select("_id", F.col("text_sha256").alias("_sha"), F.explode(F.split("_form", "\n")).alias("_line")).where("_line <> ''")
    named = lines.select("_id", "_sha", F.sha2(F.trim("_line"), 256).alias("digest")).join(known, "digest")
    named = named.groupBy(F.col("_id").alias("_of"), "_sha").agg(F.array_sort(F.collect_set("license_id")).alias("notices"))  # few ids at most
    found = form.drop("_form").join(known.withColumnRenamed("digest", "text_sha256"), "text_sha256", "left")
    found = found.join(named, F.col("_id").eqNullSafe(F.col("_of")) & (F.col("text_sha256") == F.col("_sha")), "left")
    return found.select("row.*", "text_sha256", "license_id", F.coalesce("notices", F.array().cast("array<string>")).alias("notices"))
