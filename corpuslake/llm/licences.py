"""Licence scan by canonical digest: texts are normalised (case, punctuation, copyright lines, equivalent
spellings) and their digest is hash-joined to the digests of known licences. Lines are looked up the same way,
so that a one-line notice inside a longer text is found too.

Defined results. Null or empty text: the digest of the empty text, no licence, no notice. A text that is only
copyright lines counts as empty. Repeated rows are each answered; other columns pass through, one named like the result as `<name>_input`. Main path: SQL
functions only, one narrow pass; the known digests are as many as the known texts, so the broadcast is bounded.
"""

from __future__ import annotations

from itertools import product
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslake.llm.shared import set_aside

# Licence texts and notices, as their owners publish them.
_WARRANTY = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n" + _WARRANTY
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\nTHE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
_APACHE_NOTICE = "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at\nhttp://www.apache.org/licenses/LICENSE-2.0\nUnless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."
KNOWN = (
    ("MIT", _MIT),
    ("MIT", "MIT License\n" + _MIT),
    ("MIT", "The MIT License (MIT)\n" + _MIT),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("ISC", _ISC),
    ("ISC", "ISC License\n" + _ISC),
    ("Apache-2.0", _APACHE_NOTICE),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
)
_BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n"
_BSD = ("Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.")
_BSD_NAMES = tuple(f"Neither the name of {who} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission." for who in ("the copyright holder", "the University"))
_BSD_END = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT {} OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_UNLICENSE = "This is free and unencumbered software released into the public domain.\nAnyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.\nIn jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.\nFor more information, please refer to <{}://unlicense.org{}>"

#: Families of notices: licence, its names.
FAMILIES = (
    [("MIT", ("MIT License", "MIT")), ("ISC", ("ISC License", "ISC")), ("Unlicense", ("Unlicense",)), ("CC0-1.0", ("CC0 1.0", "CC0-1.0", "CC0 1.0 Universal")), ("MPL-1.1", ("Mozilla Public License, version 1.1", "MPL 1.1")), ("MPL-2.0", ("Mozilla Public License, version 2.0", "Mozilla Public License, v. 2.0", "MPL 2.0"))]
    + [(f"BSD-{n}-Clause", (f"BSD {n}-Clause License", f"BSD-{n}-Clause", f"{n}-Clause BSD License")) for n in (2, 3)]
    + [(f"Apache-{v}", (f"Apache License, Version {v}", f"Apache License {v}", f"Apache-{v}", f"Apache {v}")) for v in ("1.1", "2.0")]
    + [(f"{a}-{v}{end}", tuple(f"{name}{mid}{n}{words}" for name, mid, n in product((f"GNU {f} Public License", a, f"GNU {a}"), (", version ", " v", " "), dict.fromkeys((v, v.removesuffix(".0"))))) + (f"{a}-{v}{end}",)) for a, f, versions in (("GPL", "General", ("1.0", "2.0", "3.0")), ("LGPL", "Lesser General", ("2.1", "3.0")), ("AGPL", "Affero General", ("3.0",))) for v in versions for end, words in (("", ""), ("-or-later", " or later"))]
    + [(f"CC-{k}-{v}", (f"CC {k} {v}", f"CC-{k}-{v}", f"Creative Commons {long} {v}", f"Creative Commons {long} {v} International License")) for k, long in (("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-ND", "Attribution-NoDerivatives"), ("BY-NC", "Attribution-NonCommercial"), ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives")) for v in ("1.0", "2.0", "2.5", "3.0", "4.0")]
)
PHRASES = tuple(f"{head} under {article}{{}}." for head in ("Licensed", "Released", "Distributed", "This work is licensed", "This project is licensed", "This software is licensed", "This file is licensed") for article in ("", "the ", "a ")) + ("SPDX-License-Identifier: {}", "License: {}")


def known_texts() -> list[tuple[str, str]]:
    """(licence, text): KNOWN, the shipped texts and the notices of every family and version."""
    whole = [(p.stem, p.read_text()) for p in sorted((Path(__file__).parent / "licence_texts").glob("*.txt"))]
    whole += [("Apache-2.0", text[: text.index("APPENDIX: How to apply")]) for name, text in whole if name == "Apache-2.0"]
    for marks, party, names in product((True, False), ("HOLDER", "OWNER"), ((), *[(n,) for n in _BSD_NAMES])):
        clauses = "\n".join(f"{i}. {c}" if marks else f"* {c}" for i, c in enumerate(_BSD + names, 1))
        body, n = _BSD_HEAD + clauses + "\n" + _BSD_END.format(party), 2 + len(names)
        whole += [(f"BSD-{n}-Clause", title + body) for title in ("", f"BSD {n}-Clause License\n")]
    whole += [("Unlicense", _UNLICENSE.format("https", end)) for end in ("", "/")]
    return [*KNOWN, *whole, *[(licence, phrase.format(name)) for licence, names in FAMILIES for name in names for phrase in PHRASES]]


#: Spellings that count as the same word.
SPELLINGS = (("licence", "license"), ("licenced", "licensed"), ("sublicence", "sublicense"), ("noncommercial", "non commercial"), ("non-infringement", "noninfringement"), ("favour", "favor"), ("organisation", "organization"), ("merchantibility", "merchantability"), ("copyright holder(s)", "copyright holders"), ("https://", "http://"), ("&", " and "))
COPYRIGHT_LINE = r"(?m)^[^a-z0-9\n(©]*(copyright [^\n]*[0-9]{4}|\(c\)|©|all rights reserved)[^\n]*$"
#: Every known text has one of these; only lines with one are looked up.
CUE = "licens|under|permi"
NOT_LETTERS = r"[^\p{L}\p{N}\n]+"


def canonical_lines(text: Column) -> Column:
    """The text's lines after normalising: lower case, single spaces, no punctuation, no copyright lines."""
    body = F.lower(F.coalesce(text, F.lit("")))
    for said, means in SPELLINGS:
        body = F.replace(body, F.lit(said), F.lit(means))
    body = F.regexp_replace(F.regexp_replace(body, COPYRIGHT_LINE, ""), NOT_LETTERS, " ")
    return F.array_remove(F.split(body, r" ?\n ?"), "")


def canonical_text(lines: Column) -> Column:
    return F.trim(F.regexp_replace(F.array_join(lines, " "), " +", " "))


def known_digests(spark: SparkSession, texts: list[tuple[str, str]] | None = None) -> DataFrame:
    """(digest, licence) of the known texts."""
    names, bodies = zip(*(texts or known_texts()))
    listed = F.arrays_zip(F.split(F.lit("\x01".join(names)), "\x01").alias("licence"), F.split(F.lit("\x01".join(bodies)), "\x01").alias("text"))
    rows = spark.range(0, 1, 1, 1).select(F.explode(listed).alias("k")).select(F.col("k.licence").alias("licence"), F.md5(canonical_text(canonical_lines(F.col("k.text"))).cast("binary")).alias("digest"))
    return rows.groupBy("digest").agg(F.min("licence").alias("licence"))


def scan(docs: DataFrame, text: str = "text", into: str = "licence_scan") -> DataFrame:
    """docs with a struct column: digest of the canonical text, licence that the whole text is (or null), and
    notices: for each line that is a known text, its licence, sorted and distinct."""
    docs, (text,) = set_aside(docs, (into,), (text,))
    names = sorted((r["digest"], r["licence"]) for r in known_digests(docs.sparkSession).collect())  # as many as known texts
    digests = F.split(F.lit(",".join(d for d, _ in names)), ",")
    table = F.str_to_map(F.lit(",".join(f"{d}:{n}" for d, n in names)), F.lit(","), F.lit(":"))
    read = docs.withColumn("__lines", canonical_lines(F.col(f"`{text}`")))
    read = read.withColumn("__digest", F.md5(canonical_text(F.col("__lines")).cast("binary")))
    cued = F.filter("__lines", lambda line: line.rlike(CUE))
    found = F.array_intersect(F.transform(cued, lambda line: F.md5(F.trim(line).cast("binary"))), digests)
    read = read.withColumn("__notices", F.array_sort(F.array_distinct(F.transform(found, lambda d: F.element_at(table, d)))))
    known = docs.sparkSession.range(0, 1, 1, 1).select(F.explode(table).alias("__of", "__licence"))
    hashed = F.broadcast(known)
    joined = read.join(hashed, F.col("__digest") == F.col("__of"), "left")
    return joined.select(*[F.col(f"`{c}`") for c in docs.columns], F.struct(F.col("__digest").alias("digest"), F.col("__licence").alias("licence"), F.col("__notices").alias("notices")).alias(into))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    s = "licence_scan."
    return docs.select("doc_id", F.col(s + "digest").alias("digest"), F.col(s + "licence").alias("licence"), F.size(s + "notices").cast("long").alias("n_notices"), F.array_join(s + "notices", ",").alias("notices"))


def op9_sql() -> str:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    listed = ", ".join(f"({quoted(n)}, {quoted(t)})" for n, t in known_texts())
    body = "lower(coalesce(text, ''))"
    for said, means in SPELLINGS:
        body = f"replace({body}, {quoted(said)}, {quoted(means)})"
    lines = f"list_filter(string_split_regex(regexp_replace(regexp_replace({body}, '{COPYRIGHT_LINE}', '', 'g'), '[^\\p{{L}}\\p{{N}}\\n]+', ' ', 'g'), ' ?\\n ?'), lambda x: x <> '')"
    whole = "md5(trim(regexp_replace(array_to_string(lines, ' '), ' +', ' ', 'g'), ' '))"
    return f"""
WITH k AS (
  SELECT digest, min(licence) AS licence FROM (SELECT licence, {whole} AS digest FROM (SELECT licence, {lines} AS lines FROM (VALUES {listed}) AS v(licence, text))) GROUP BY digest
), d AS (
  SELECT doc_id, lines, {whole} AS digest FROM (SELECT doc_id, {lines} AS lines FROM documents)
), n AS (
  SELECT doc_id, list_sort(list(DISTINCT licence)) AS notices FROM (SELECT doc_id, unnest(lines) AS line FROM d) x JOIN k ON md5(trim(line, ' ')) = k.digest GROUP BY doc_id
)
SELECT d.doc_id, d.digest, k.licence, CAST(coalesce(len(n.notices), 0) AS BIGINT) AS n_notices, coalesce(array_to_string(n.notices, ','), '') AS notices
FROM d LEFT JOIN k ON k.digest = d.digest LEFT JOIN n ON n.doc_id = d.doc_id
"""
