"""Licence scans: whole texts against known licences by the digest of their canonical form."""

from __future__ import annotations

import os
import re
import textwrap

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Spellings that licence matching guidelines treat as equal, as (spelling, canonical).
SPELLINGS = (
    ("licence", "license"),
    ("licences", "licenses"),
    ("licenced", "licensed"),
    ("organisation", "organization"),
    ("organisations", "organizations"),
    ("modelled", "modeled"),
    ("favour", "favor"),
    ("fulfil", "fulfill"),
    ("acknowledgement", "acknowledgment"),
    ("judgement", "judgment"),
    ("whilst", "while"),
    ("noncommercial", "non commercial"),
    ("sublicence", "sublicense"),
    ("analogue", "analog"),
    ("behaviour", "behavior"),
    ("recognise", "recognize"),
    ("authorisation", "authorization"),
    ("programme", "program"),
    ("copyright holder", "copyright owner"),
    ("copyright holders", "copyright owners"),
)
COPYRIGHT_LINE = r"(?m)^[^a-z0-9\n]*(copyright|\(c\)|©|all rights reserved)[^\n]*$"

# Public short notices and licences by SPDX identifier.
KNOWN = {
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "MIT-notice": "Released under the MIT License.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "0BSD": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.""",
}

#: A line that states a copyright: the word or its sign before a sign, a year, a placeholder or a capitalised holder. Others may be wrapped text.
STATEMENT_LINE = (
    r"(?m)^[^A-Za-z0-9\n]*(?:(?i:copyright|\(c\)|©)[ \t:]*(?:(?i:\(c\)|©|by )[^\n]*|[0-9\[<{][^\n]*|[A-Z][a-z][^\n]*)|©[^\n]*|(?i:all rights reserved)[^A-Za-z0-9\n]*)$"
)
LICENSES = os.path.join(os.path.dirname(os.path.abspath(__file__)), "licenses")
# The title lines that usual files have above texts that don't begin with their title.
TITLES = {
    "0BSD": ("BSD Zero Clause License", "Zero-Clause BSD", "0BSD License"),
    "BSD-2-Clause": ("BSD 2-Clause License", "The BSD 2-Clause License", 'BSD 2-Clause "Simplified" License', "Simplified BSD License", "BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "The BSD 3-Clause License", 'BSD 3-Clause "New" or "Revised" License', "New BSD License", "BSD License"),
    "ISC": ("ISC License", "The ISC License", "ISC License (ISC)"),
    "MIT": ("MIT License", "The MIT License", "The MIT License (MIT)", "MIT License (MIT)"),
    "Unlicense": ("The Unlicense", "Unlicense"),
    "Zlib": ("zlib License", "The zlib License", "zlib/libpng License"),
}


def known_texts() -> list[tuple[str, str]]:
    """license_id and text of KNOWN and of the files in LICENSES, with each title, plain and numbered clauses, with and without appendix."""
    texts = list(KNOWN.items())
    for name in sorted(os.listdir(LICENSES)):
        with open(os.path.join(LICENSES, name), encoding="utf-8") as file:
            texts.append((name.removesuffix(".txt").split("+")[0], file.read()))
    out = []
    for name, text in texts:
        forms = {text, re.sub(r"(?s)(END OF TERMS AND CONDITIONS).*", r"\1", text), re.sub(r"(?s)\s*END OF TERMS AND CONDITIONS.*", "", text)}
        if name.startswith("BSD"):
            forms |= {re.sub(r"(?m)^\s*[0-9]\. ", "* ", x) for x in forms}
        out += [(name, f"{title}\n\n{x}") for x in forms for title in ("", *TITLES.get(name, ()))]
    return out


def canonical(text: Column) -> Column:
    """Lower case, without copyright lines, words of ASCII letters and digits with one space between, one spelling of each word.

    Characters beyond ASCII end words. A null text is an empty text.
    """
    return _words(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), COPYRIGHT_LINE, " "))


def without_statements(text: Column) -> Column:
    """The canonical form if only lines that state a copyright are left out, however the text is wrapped."""
    return _words(F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), STATEMENT_LINE, " ")))


def _words(out: Column) -> Column:
    out = F.concat(F.lit(" "), F.regexp_replace(out, r"[^a-z0-9]+", " "), F.lit(" "))
    for spelling, one in SPELLINGS:
        out = F.replace(out, F.lit(f" {spelling} "), F.lit(f" {one} "))
    return F.trim(F.regexp_replace(out, " +", " "))


def known_digests(spark: SparkSession, known: dict[str, str] | None = None) -> DataFrame:
    """license_id and digest of each known licence, in both forms; of equal forms, the least id."""
    rows = spark.createDataFrame(sorted(known.items() if known else known_texts()), "license_id string, text string")
    forms = F.explode(F.array(canonical(F.col("text")), without_statements(F.col("text")))).alias("form")
    return rows.select("license_id", forms).select("license_id", F.sha2("form", 256).alias("digest")).groupBy("digest").agg(F.min("license_id").alias("license_id"))


def license_scan(docs: DataFrame, known: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """For every row: the digest of its whole text's canonical form and the licence that has this digest, or null.

    A text that no licence equals there is looked up once more by its form without copyright
    statements, which doesn't depend on where its lines are wrapped.

    ``known`` has digest (unique) and license_id; it is joined by hash, and Spark broadcasts
    it only if it is below the session's size limit. Null and empty texts have the digest of
    the empty text and match nothing; repeated rows give repeated results.
    """
    text = F.col(text_column)
    digests = docs.select(id_column, F.sha2(canonical(text), 256).alias("canonical_sha256"), F.sha2(without_statements(text), 256).alias("__whole"))
    known = known.where(F.col("digest") != F.sha2(F.lit(""), 256))
    first, second = known.select(F.col("digest").alias("__first"), F.col("license_id").alias("__id")), known.select(F.col("digest").alias("__second"), F.col("license_id").alias("__other"))
    return (
        digests.join(first, F.col("canonical_sha256") == F.col("__first"), "left").join(second, F.col("__whole") == F.col("__second"), "left")
        .select(id_column, "canonical_sha256", F.coalesce("__id", "__other").alias("license_id"), F.coalesce("__id", "__other").isNotNull().alias("is_license"))
    )


def license_scan_sql() -> str:
    """The scan of ``documents`` against KNOWN in DuckDB's SQL."""

    def form(x: str) -> str:
        quoted = COPYRIGHT_LINE.replace("(?m)", "").replace("'", "''")
        out = f"' ' || regexp_replace(regexp_replace(lower(coalesce({x}, '')), '(?m){quoted}', ' ', 'g'), '[^a-z0-9]+', ' ', 'g') || ' '"
        for spelling, one in SPELLINGS:
            out = f"replace({out}, ' {spelling} ', ' {one} ')"
        return f"trim(regexp_replace({out}, ' +', ' ', 'g'))"

    values = ", ".join(f"('{n}', '{t.replace(chr(39), chr(39) * 2)}')" for n, t in sorted(KNOWN.items()))
    return f"""WITH known AS (SELECT sha256({form('t')}) AS digest, min(n) AS license_id FROM (VALUES {values}) v(n, t) GROUP BY 1),
        scanned AS (SELECT doc_id, sha256({form('text')}) AS canonical_sha256 FROM documents)
        SELECT doc_id, canonical_sha256, license_id, license_id IS NOT NULL AS is_license
        FROM scanned LEFT JOIN known ON canonical_sha256 = digest AND digest <> sha256('')"""


#: Widths to which ``usual_files`` wraps each known text.
WIDTHS = (60, 80, 100)


def usual_files() -> list[tuple[int, str, str]]:
    """Number, licence and text of files as they are usually found: each known text under a title and a copyright line, wrapped to several widths, and cut in half (no licence).

    Paragraphs that state a copyright keep their lines: where one is run together with the
    sentence behind it, a scan by lines drops that sentence too and finds no licence.
    """
    out = []
    for name, text in dict(known_texts()[::-1]).items():
        if name.endswith("-notice"):
            continue
        for width in WIDTHS:
            wrapped = "\n\n".join(p if re.search(STATEMENT_LINE, p) else textwrap.fill(p, width) for p in re.split(r"\n\s*\n", text))
            out.append((name, f"Copyright (c) 2021 Some One\n\n{wrapped}\n"))
        out.append((None, text[: len(text) // 2]))
    return [(i, name, text) for i, (name, text) in enumerate(out)]
