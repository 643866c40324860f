"""License scans by canonical digest: entire texts, normalised and hashed, are looked up among known licences' digests.

Normalising makes all letters lower case and what lies between words one space, writes equivalent spellings alike and
leaves out copyright lines. A document whose entire text is a known licence is found by a hash join of digests; so is,
by the same digests, each line of a document that is a known notice.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Licence texts and notices as their publishers word them.
PERMISSION = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
AS_IS = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. '
    "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, "
    "WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
BSD_SOURCE = "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
BSD_BINARY = "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
BSD_NAMES = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
BSD_AS_IS = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. '
    "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; "
    "OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)


def bsd(*clauses: str) -> str:
    return "\n\n".join(["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:", *clauses, BSD_AS_IS])


SHORT = (
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, "
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\n"
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. '
        "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH "
        "THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    ("ISC", f"{PERMISSION}, provided that the above copyright notice and this permission notice appear in all copies.\n\n{AS_IS}"),
    ("0BSD", f"{PERMISSION}.\n\n{AS_IS}"),
    (
        "Zlib",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.\n\n"
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:\n\n"
        "1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation "
        "would be appreciated but is not required.\n2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.\n"
        "3. This notice may not be removed or altered from any source distribution.",
    ),
    ("BSD-2-Clause", bsd(BSD_SOURCE, BSD_BINARY)),
    ("BSD-2-Clause", bsd(f"1. {BSD_SOURCE}", f"2. {BSD_BINARY}")),
    ("BSD-3-Clause", bsd(BSD_SOURCE, BSD_BINARY, BSD_NAMES)),
    ("BSD-3-Clause", bsd(f"1. {BSD_SOURCE}", f"2. {BSD_BINARY}", f"3. {BSD_NAMES}")),
)
#: The titles that the short ones are given; each also stands without any.
TITLES = {
    "MIT": ("MIT License", "The MIT License", "The MIT License (MIT)"),
    "ISC": ("ISC License", "The ISC License", "ISC License (ISC)"),
    "0BSD": ("BSD Zero Clause License", "Zero-Clause BSD", "BSD Zero Clause License (0BSD)"),
    "Zlib": ("zlib License", "The zlib License", "zlib/libpng License", "The zlib/libpng License"),
    "BSD-2-Clause": ("BSD 2-Clause License", "The BSD 2-Clause License", 'BSD 2-Clause "Simplified" License', "Simplified BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "The BSD 3-Clause License", 'BSD 3-Clause "New" or "Revised" License', "New BSD License", "Modified BSD License"),
}
NOTICES = (
    ("MIT notice", "Released under the MIT License."),
    ("MIT notice", "Licensed under the MIT License."),
    ("Apache-2.0 notice", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0 notice", "Released under the Apache License, Version 2.0."),
    ("GPL-3.0 notice", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0 notice", "Licensed under the GNU General Public License, version 3."),
    ("GPL-2.0 notice", "This work is licensed under the GNU General Public License, version 2."),
    ("BSD-3-Clause notice", "Licensed under the BSD 3-Clause License."),
    ("CC-BY-NC-4.0 notice", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0 notice", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0 notice", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0 notice", "Released under CC0 1.0."),
)


def long_texts() -> list[tuple[str, str]]:
    """The licences in `license_texts`, with either form of web address, with and without what follows the terms."""
    found = []
    for path in sorted((Path(__file__).parent / "license_texts").glob("*.txt")):
        text = path.read_text(encoding="utf-8")
        end = text.find(mark := "END OF TERMS AND CONDITIONS") + len(mark)
        forms = [text, text[:end]] if mark in text else [text]
        # A copyright line is left out where it is filled in, so the unfilled one is left out here too.
        forms += ["\n".join(li for li in text.split("\n") if "Copyright [yyyy]" not in li)] if "Copyright [yyyy]" in text else []
        found += [(path.stem, x) for form in forms for x in dict.fromkeys([form, form.replace("https:", "http:"), form.replace("http:", "https:")])]
    return found


TEXTS = (*SHORT, *((name, f"{title}\n\n{text}") for name, text in SHORT for title in TITLES[name]), *long_texts(), *NOTICES)
#: Spellings that count as the same, as they stand after normalising.
SPELLINGS = (
    ("licence", "license"),
    ("licences", "licenses"),
    ("licenced", "licensed"),
    ("sub license", "sublicense"),
    ("non commercial", "noncommercial"),
    ("non infringement", "noninfringement"),
    ("acknowledgement", "acknowledgment"),
    ("copyright owner", "copyright holder"),
    ("organisation", "organization"),
    ("favour", "favor"),
    ("judgement", "judgment"),
    ("authorised", "authorized"),
    ("per cent", "percent"),
)
#: A line that says who holds the rights: the word or sign, a year somewhere or a sign, and a name; sentences about copyright stay.
COPYRIGHT = "^(portions |parts )?(copyright|copr|c) (c )?([0-9]{4}|.{1,60} [0-9]{4}$)|^(portions |parts )?copyright c |^all rights reserved|^[0-9]{4}( [0-9]{4})* (copyright|c) "


def canonical_lines(text: Column) -> Column:
    """The text's normalised lines, none empty, without copyright lines."""
    signs = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "\u00a9", " c ")
    # Each word between blanks of its own, so that spellings are replaced as whole words.
    plain = F.concat(F.lit(" "), F.replace(F.regexp_replace(signs, r"[^\p{L}\p{N}\n]+", "  "), F.lit("\n"), F.lit(" \n ")), F.lit(" "))
    for other, chosen in SPELLINGS:
        plain = F.replace(plain, F.lit(f" {other.replace(' ', '  ')} "), F.lit(f" {chosen.replace(' ', '  ')} "))
    plain = F.replace(plain, F.lit("  "), F.lit(" "))
    lines = F.transform(F.split(plain, "\n"), lambda line: F.trim(line))
    return F.filter(lines, lambda line: (line != "") & ~line.rlike(COPYRIGHT))


def known(spark: SparkSession) -> DataFrame:
    """(digest, license) of the fixed texts."""
    texts = spark.createDataFrame(list(TEXTS), "license string, text string")
    return texts.select(F.md5(F.array_join(canonical_lines(F.col("text")), " ")).alias("digest"), "license").distinct()


def scan(docs: DataFrame) -> DataFrame:
    """`docs` (doc_id, text) -> doc_id, digest, license, n_notices, notices, row for row.

    license: the known licence or notice that the entire text is, null if none. notices: the known ones among the lines,
    each once, in order of name. A text without words, null included, has the digest of the empty text and no licence.
    Repeated rows are judged alike, an empty table gives an empty result, other columns are not looked at. The broadcast
    table holds the fixed texts only.
    """
    fixed = known(docs.sparkSession)
    pairs = fixed.collect()  # the fixed texts' digests
    lookup = F.create_map(*[F.lit(x) for r in pairs for x in (r["digest"], r["license"])])
    lines = docs.select("doc_id", canonical_lines(F.col("text")).alias("lines"))
    hit = F.filter(F.transform("lines", lambda line: F.when(F.length(line) <= max(len(t) for _, t in TEXTS), F.element_at(lookup, F.md5(line)))), lambda x: x.isNotNull())
    hashed = lines.select("doc_id", F.md5(F.array_join("lines", " ")).alias("digest"), hit.alias("hits"))
    found = hashed.join(F.broadcast(fixed), "digest", "left")
    return found.select("doc_id", "digest", "license", F.size("hits").cast("long").alias("n_notices"), F.array_join(F.array_sort(F.array_distinct("hits")), ",").alias("notices"))


def op10(docs: DataFrame) -> DataFrame:
    return scan(docs)


def oracle() -> str:
    """The same in DuckDB."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    plain = "' ' || replace(regexp_replace(replace(lower(coalesce(text, '')), chr(169), ' c '), '[^\\p{L}\\p{N}\\n]+', '  ', 'g'), chr(10), ' ' || chr(10) || ' ') || ' '"
    for other, chosen in SPELLINGS:
        plain = f"replace({plain}, {quote(' ' + other.replace(' ', '  ') + ' ')}, {quote(' ' + chosen.replace(' ', '  ') + ' ')})"
    plain = f"replace({plain}, '  ', ' ')"
    lines = f"list_filter(list_transform(string_split({plain}, chr(10)), lambda x: trim(x)), lambda x: x <> '' AND NOT regexp_matches(x, '{COPYRIGHT}'))"
    fixed = ", ".join(f"({quote(n)}, {quote(t)})" for n, t in TEXTS)
    return f"""
WITH fixed AS (SELECT DISTINCT md5(array_to_string({lines}, ' ')) AS digest, license FROM (VALUES {fixed}) AS v(license, text)),
docs AS (SELECT row_number() OVER () AS n, doc_id, {lines} AS lines FROM documents),
hits AS (SELECT n, count(*) AS n_notices, string_agg(DISTINCT license, ',' ORDER BY license) AS notices
         FROM (SELECT n, unnest(lines) AS line FROM docs) JOIN fixed ON digest = md5(line) GROUP BY n)
SELECT doc_id, d.digest, license, coalesce(n_notices, 0) AS n_notices, coalesce(notices, '') AS notices
FROM (SELECT *, md5(array_to_string(lines, ' ')) AS digest FROM docs) d LEFT JOIN fixed f ON f.digest = d.digest LEFT JOIN hits h ON h.n = d.n
"""
