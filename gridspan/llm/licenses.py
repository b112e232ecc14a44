"""Licence scan: digests of canonical texts, joined to the digests of known licences."""

from __future__ import annotations

from importlib import resources

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.joins import lookup_join
from .common import query, table

# Short licence texts and notices as they are published, by SPDX identifier. The SQL holds these alone.
KNOWN: tuple[tuple[str, str], ...] = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    (
        "MIT",
        "MIT License\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to "
        "use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the "
        "Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice "
        "shall be included in all copies or substantial portions of the Software.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY "
        "OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE "
        "AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, "
        "WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER "
        "DEALINGS IN THE SOFTWARE.",
    ),
    (
        "ISC",
        "ISC License\n\nPermission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies.\n\nTHE SOFTWARE IS PROVIDED "
        "\"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY "
        "AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES "
        "WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, "
        "ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
)

# Names of licences in notices, by SPDX identifier.
_NAMED: tuple[tuple[str, str], ...] = (
    ("MIT", "MIT License"),
    ("ISC", "ISC License"),
    ("Zlib", "zlib License"),
    ("Unlicense", "Unlicense"),
    ("BSD-2-Clause", "BSD 2-Clause License"),
    ("BSD-3-Clause", "BSD 3-Clause License"),
    ("Apache-2.0", "Apache License, Version 2.0"),
    ("MPL-2.0", "Mozilla Public License, Version 2.0"),
    ("GPL-2.0-only", "GNU General Public License, version 2"),
    ("GPL-3.0-only", "GNU General Public License, version 3"),
    ("LGPL-2.1-only", "GNU Lesser General Public License, version 2.1"),
    ("LGPL-3.0-only", "GNU Lesser General Public License, version 3"),
    ("AGPL-3.0-only", "GNU Affero General Public License, version 3"),
)
_COMMONS: tuple[tuple[str, str], ...] = (
    ("BY", "Attribution"),
    ("BY-SA", "Attribution-ShareAlike"),
    ("BY-ND", "Attribution-NoDerivatives"),
    ("BY-NC", "Attribution-NonCommercial"),
    ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"),
    ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"),
)
_SAID = ("Licensed under {}.", "Released under {}.", "This work is licensed under {}.")
# Headings under which the short licences are published, besides none.
_HEADINGS = {
    "MIT": ("MIT License", "The MIT License", "The MIT License (MIT)"),
    "ISC": ("ISC License", "The ISC License"),
    "0BSD": ("BSD Zero Clause License", "Zero-Clause BSD"),
    "BSD-2-Clause": ("BSD 2-Clause License", "The 2-Clause BSD License", "Simplified BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "The 3-Clause BSD License", "New BSD License"),
    "Zlib": ("zlib License", "The zlib License"),
}

# Spellings that count as the same word, after the text is in lower case without punctuation.
EQUIVALENT: tuple[tuple[str, str], ...] = (
    ("licence", "license"),
    ("licences", "licenses"),
    ("licenced", "licensed"),
    ("sublicence", "sublicense"),
    ("merchantibility", "merchantability"),
    ("noninfringement", "non infringement"),
    ("neighbouring", "neighboring"),
    ("organisation", "organization"),
    ("favour", "favor"),
    ("honour", "honor"),
    ("whilst", "while"),
    ("ver", "version"),
    ("v2", "version 2"),
    ("v3", "version 3"),
)

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Only ASCII is folded and only ASCII signs are taken out, so every engine agrees on the result.
_SIGNS = "[!-/:-@\\[-`{-~\\t\\x0B\\x0C ]+"
_COPYRIGHT = "(^|\\n)[ \\t*#/;-]*(copyright|\\(c\\)|all rights reserved)[^\\n]*"


def canonical(text: Column) -> Column:
    """Lower case, without copyright lines and punctuation, with equivalent spellings made one.

    Lines stay lines; words stand between single spaces, also at the ends of a line.
    """
    out = F.translate(F.regexp_replace(F.coalesce(text, F.lit("")), "\\r\\n?", "\n"), _UPPER, _LOWER)
    out = F.regexp_replace(F.regexp_replace(out, _COPYRIGHT, "\n"), _SIGNS, " ")
    out = F.concat(F.lit(" "), F.replace(out, F.lit("\n"), F.lit(" \n ")), F.lit(" "))
    for word, same in EQUIVALENT:
        out = F.replace(out, F.lit(f" {word} "), F.lit(f" {same} "))
    return out


def one_line(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, "[ \\n]+", " "))


def default_known() -> list[tuple[str, str]]:
    """(licence, text): ``KNOWN``, the whole licences in the folder ``known_licenses``, and notices.

    A whole licence stands there as published; the short ones under each of their headings and without
    one, the Apache licence also without its appendix, and each with either scheme in its links.
    """
    files = [f for f in resources.files(__package__).joinpath("known_licenses").iterdir() if f.name.endswith(".txt")]
    whole = [(f.name[:-4], f.read_text(encoding="utf-8")) for f in sorted(files, key=lambda f: f.name)]
    given = dict(whole)
    whole += [(name, text.split("\n\n", 1)[1]) for name, text in KNOWN if "\n\n" in text]
    start, end = given["BSD-3-Clause"].index("3. Neither"), given["BSD-3-Clause"].index("THIS SOFTWARE")
    whole.append(("BSD-2-Clause", given["BSD-3-Clause"][:start] + given["BSD-3-Clause"][end:]))
    terms, appendix = given["Apache-2.0"].split("APPENDIX:", 1)
    whole += [("Apache-2.0", terms), ("Apache-2.0", appendix[appendix.index("Licensed under the Apache") :])]
    whole += [(name, f"{heading}\n\n{text}") for name, text in whole for heading in _HEADINGS.get(name, ())]
    whole += [(name, text.replace(*pair)) for name, text in whole for pair in (("http://", "https://"), ("https://", "http://"))]
    notices = [(name, said.format(f"{the}{title}")) for name, title in _NAMED for said in _SAID for the in ("the ", "")]
    for kind, title in _COMMONS:
        for version, scope in (("3.0", "Unported"), ("4.0", "International")):
            names = (f"CC {kind} {version}", f"CC-{kind}-{version}", f"a Creative Commons {title} {version} {scope} License")
            notices += [(f"CC-{kind}-{version}", said.format(n)) for said in _SAID for n in names]
    tags = {name for name, _ in (*KNOWN, *whole, *notices)}
    notices += [(name, f"SPDX-License-Identifier: {name}") for name in sorted(tags)]
    return list(dict.fromkeys([*KNOWN, *whole, *notices]))


def known_digests(known: DataFrame) -> DataFrame:
    """(digest, licence) of (licence, text): one row per known text. Empty texts and null licences are none."""
    unit = known.where("licence IS NOT NULL").select("licence", one_line(canonical(F.col("text"))).alias("unit"))
    return unit.where("unit <> ''").select(F.sha2("unit", 256).alias("digest"), "licence").distinct()


def license_scan(docs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(doc_id, line_no, digest, licence): known licences among whole texts and whole lines.

    Every document has a row with ``line_no`` 0: the digest of its whole canonical text and the known
    licence with that digest, else null. Each line that is a known licence by itself has a row with its
    place from 1. ``known`` has (licence, text), a text of any number of lines; without it,
    :func:`default_known` is taken, a list of fixed size. The join is on the digest alone: a known side
    proven small is broadcast and nothing is shuffled, a larger one is shuffled, its hottest digests
    aside. No texts are compared in pairs, and groups of copies make no difference. A text known under
    several licences gives a row for each.

    A null or empty text has the digest of the empty text and no licence; a null id stays null; repeated
    rows stay repeated; an empty table gives no rows; extra columns are not read.
    """
    texts = docs.select("doc_id", canonical(F.col("text")).alias("text"))
    units = texts.select("doc_id", F.posexplode(F.concat(F.array("text"), F.split("text", "\n"))).alias("line_no", "unit"))
    units = units.select("doc_id", F.col("line_no").cast("long").alias("line_no"), F.sha2(one_line(F.col("unit")), 256).alias("digest"))
    if known is None:
        listed = docs.sparkSession.createDataFrame(default_known(), "licence string, text string")
        found = units.join(F.broadcast(known_digests(listed)), "digest", "left")
    else:
        found = lookup_join(units, known_digests(known), ["digest"])
    return found.where((F.col("line_no") == 0) | F.col("licence").isNotNull()).select("doc_id", "line_no", "digest", "licence")


def _sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _sql() -> str:
    text = "translate(regexp_replace(coalesce(text, ''), '\r\n?', chr(10), 'g'), '%s', '%s')" % (_UPPER, _LOWER)
    signs, copyright_ = _SIGNS.replace("\\\\", "\\"), _COPYRIGHT.replace("\\\\", "\\")
    text = f"regexp_replace(regexp_replace({text}, '{copyright_}', chr(10), 'g'), '{signs}', ' ', 'g')"
    text = f"' ' || replace({text}, chr(10), ' ' || chr(10) || ' ') || ' '"
    for word, same in EQUIVALENT:
        text = f"replace({text}, ' {word} ', ' {same} ')"
    one = "trim(regexp_replace(unit, '[ \\n]+', ' ', 'g'))"
    known = ", ".join(f"({_sql_text(a)}, {_sql_text(b)})" for a, b in KNOWN)
    return (
        f"WITH known AS (SELECT DISTINCT licence, sha256({one}) AS digest FROM (SELECT licence, {text} AS unit FROM (VALUES {known}) AS k(licence, text))), "
        f"texts AS (SELECT doc_id, {text} AS text FROM documents), "
        "units AS (SELECT doc_id, 0 AS line_no, text AS unit FROM texts UNION ALL "
        "SELECT doc_id, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line_no, unnest(string_split(text, chr(10))) AS unit FROM texts), "
        f"hashed AS (SELECT doc_id, line_no, sha256({one}) AS digest FROM units) "
        "SELECT doc_id, line_no, hashed.digest AS digest, licence FROM hashed LEFT JOIN known USING (digest) WHERE line_no = 0 OR licence IS NOT NULL"
    )


@query("op7_license_digests", _sql())
def op7(spark, sf_dir):
    return license_scan(table(spark, sf_dir, "documents"))
