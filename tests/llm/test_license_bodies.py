"""Whole license files: long bodies, titles, and copyright lines of all kinds."""

import re

from litmill.llm import license_scan


def found(spark, texts):
    rows = list(enumerate(texts))
    return [x.license for x in license_scan.scanned(spark.createDataFrame(rows, "doc_id long, text string")).orderBy("doc_id").collect()]


def test_titles_and_owners(spark):
    body = {n: t for n, t in license_scan.KNOWN if len(t) > 500}
    files = [
        ("MIT", "MIT License\n\nCopyright (c) 2020 X\n\n" + body["MIT"]),
        ("MIT", "The MIT License (MIT)\n\nCopyright (c) Facebook, Inc. and its affiliates.\n\n" + body["MIT"]),
        ("MIT", "Copyright Jane Doe 2020\n" + body["MIT"]),
        ("MIT", "Copyright The Authors, 2020\nAll rights reserved.\n" + body["MIT"]),
        ("ISC", "ISC License\n\n\u00a9 Jane Doe\n\n" + body["ISC"]),
        ("BSD-2-Clause", "BSD 2-Clause License\nCopyright [yyyy] [owner]\n" + body["BSD-2-Clause"]),
        ("BSD-3-Clause", "Copyright Jane Doe and others\nBSD 3-Clause License\n" + body["BSD-3-Clause"]),
        (None, "MIT License\nMIT License is good.\n" + body["MIT"]),
        (None, "MIT License"),
        (None, "Copyright holder wanted\n" + body["MIT"]),
    ]
    assert found(spark, [t for _, t in files]) == [n for n, _ in files]


def test_long_bodies(spark):
    held = license_scan.bodies()
    assert {n for n, _ in held} >= {"Apache-2.0", "GPL-2.0", "GPL-3.0", "CC0-1.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "Unlicense", "Zlib", "BSL-1.0", "0BSD", "MIT-0", "GFDL-1.3", "Artistic-1.0-Perl"}
    assert found(spark, [t for _, t in held]) == [n for n, _ in held]
    assert found(spark, [" ".join(t.split()[:-9]) for _, t in held]) == [None] * len(held)
    apache = next(t for n, t in held if n == "Apache-2.0")
    assert found(spark, [apache.replace("[yyyy] [name of copyright owner]", "2019 Jane Doe")]) == ["Apache-2.0"]


def test_own_clauses_are_spared(spark):
    """Wherever a line breaks before or after `copyright`, the text stays the same."""
    texts = [(n, t) for n, t in (*license_scan.KNOWN, *license_scan.bodies()) if len(t) > 500 and "How to Apply" not in t and "APPENDIX" not in t]
    assert len(texts) >= 7
    for cut in (r"(?i)[ \n]+(?=copyright\b)", r"(?i)(?<=copyright)[ \n]+(?!\(c\))"):
        # The notices' own lines stay whole.
        broken = ["\n".join(x if re.match(r"\s*copyright \(c\)", x, re.I) else re.sub(cut, "\n", x) for x in t.split("\n")) for _, t in texts]
        assert found(spark, broken) == [n for n, _ in texts]
