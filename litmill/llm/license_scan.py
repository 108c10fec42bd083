"""License scans by digests of canonical texts.

A text is brought to a canonical form (case, punctuation, copyright lines,
equivalent spellings), and its digest is looked up among those of known license
texts.  The lookup is done for whole documents, and for single lines, which
carry notices.
"""

from __future__ import annotations

import re
from functools import cache
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Spellings that count as the same.
EQUIVALENT = (
    ("licence", "license"),
    ("organisation", "organization"),
    ("favour", "favor"),
    ("labour", "labor"),
    ("non infringement", "noninfringement"),
    ("sub license", "sublicense"),
    ("merchantibility", "merchantability"),
    ("per cent", "percent"),
    ("copyright owner", "copyright holder"),
)

_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_BSD_TWO = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""

#: Known license texts and notices.
KNOWN = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Released under CC0 1.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("BSD-2-Clause", _BSD_TWO + "\n" + _BSD_END),
    ("BSD-3-Clause", _BSD_TWO + "\n3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n" + _BSD_END),
)


#: Lines in canonical form that only name the license whose text follows.
TITLES = tuple(the + name for the in ("", "the ") for name in ("mit license", "mit license mit", "mit no attribution", "zero clause bsd license", "bsd zero clause license", "zlib license", "the unlicense", "expat license", "mit expat license", "isc license", "isc license isc", "bsd license", "bsd 2 clause license", "2 clause bsd license", "bsd 2 clause simplified license", "simplified bsd license", "freebsd license", "bsd 3 clause license", "3 clause bsd license", "bsd 3 clause new or revised license", "new bsd license", "modified bsd license", "revised bsd license"))


@cache
def bodies() -> tuple[tuple[str, str], ...]:
    """(license, text) of the long licenses, with and without what follows the terms."""
    out = []
    for path in sorted((Path(__file__).parent / "licenses").glob("*.txt")):
        text = path.read_text(encoding="utf-8")
        terms, end, _ = text.partition("END OF TERMS AND CONDITIONS")
        out += [(path.stem, t) for t in dict.fromkeys((text, terms + end, terms))]
    return tuple(out)


@cache
def _notice() -> str:
    """What matches lines in canonical form that say whose the copyright is.

    These have a sign or a year, or are short; words that follow `copyright` in
    the licenses' own clauses do not begin an owner's name.
    """
    clauses = set()
    for _, text in (*KNOWN, *bodies()):
        plain = " ".join(re.findall(r"\w+", text.lower().replace("(c)", " copyright ")))
        for a, b in EQUIVALENT:
            plain = plain.replace(a, b)
        words = plain.split()
        clauses |= {b for a, b in zip(words, words[1:], strict=False) if a == "copyright" and b.isalpha()}
    clauses -= {"copyright", "year", "yyyy"}
    own = "|".join(sorted(clauses))
    year = r"\b(?:19|20)\d\d\b"
    return rf"^copyright (?:copyright |\d|yyyy|(?!(?:{own})(?: |$))(?:.*{year}|\S+(?: \S+){{0,6}}$)|(?:the|by) .*{year}$)"


def canonical_lines(text: Column) -> Column:
    """Lines in canonical form, without empty ones and copyright lines; null has none."""
    t = F.lower(F.coalesce(text, F.lit("")))
    t = F.replace(F.replace(t, F.lit("(c)"), F.lit(" copyright ")), F.lit("©"), F.lit(" copyright "))
    t = F.regexp_replace(t, r"[^\p{L}\p{N}\n]+", " ")
    for a, b in EQUIVALENT:
        t = F.replace(t, F.lit(a), F.lit(b))
    # All-rights-reserved lines and lines that only say whose the copyright is are no part of a license.
    return F.filter(F.transform(F.split(t, "\n"), lambda x: F.trim(x)), lambda x: (x != "") & ~x.rlike(_notice()) & (x != "all rights reserved"))


def canonical_whole(lines: Column) -> Column:
    """Canonical lines as one text, without a title before it; spellings of two words may have been on two lines."""
    t = F.array_join(F.when(F.get(lines, F.lit(0)).isin(*TITLES), F.slice(lines, F.lit(2), F.size(lines))).otherwise(lines), " ")
    for a, b in EQUIVALENT:
        if " " in a:
            t = F.replace(t, F.lit(a), F.lit(b))
    return t


def scanned(docs: DataFrame, known=None) -> DataFrame:
    """(doc_id, license, notices) for every row of docs.

    license is the license whose text the whole document is, else null;
    notices the licenses of single lines, sorted, comma-joined, empty if none.
    Rows with an equal doc_id and text get equal results.  Null texts have none.
    known, (license, text) of what is looked up, is KNOWN and the long licenses if not given.
    """
    known = (*KNOWN, *bodies()) if known is None else known
    spark = docs.sparkSession
    table = spark.createDataFrame(list(known), "license string, text string")
    table = table.select("license", canonical_whole(canonical_lines(F.col("text"))).alias("text"))
    # A fixed list, which is broadcast; licenses of equal texts: the first by name.
    table = table.groupBy(F.sha2("text", 256).alias("digest"), F.length("text").alias("size")).agg(F.min("license").alias("license"))
    lines = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), canonical_lines(F.col("text").cast("string")).alias("lines"))
    sizes = sorted(r["size"] for r in table.select("size").distinct().collect())
    whole = canonical_whole(F.col("lines"))
    # The first candidate is the whole text; a line can only match if its length is that of a known text.
    alike = F.filter("lines", lambda x: F.length(x).isin(sizes))
    found = F.concat(F.array(F.struct(F.lit(True).alias("whole"), F.sha2(whole, 256).alias("digest"))), F.transform(F.array_distinct(alike), lambda x: F.struct(F.lit(False).alias("whole"), F.sha2(x, 256).alias("digest"))))
    probes = lines.select("doc_id", "row", F.explode(found).alias("p")).select("doc_id", "row", "p.whole", "p.digest")
    met = probes.join(F.broadcast(table.select("digest", "license")), "digest", "left").where("whole or license is not null")
    return met.groupBy("doc_id", "row").agg(
        F.min(F.when(F.col("whole"), F.col("license"))).alias("license"),
        F.array_join(F.array_sort(F.collect_set(F.when(~F.col("whole"), F.col("license")))), ",").alias("notices"),
    ).drop("row")
