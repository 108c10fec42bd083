"""Files in ranges of bytes against readers of one cell."""

import json
import random

import pytest
from pyspark.sql import functions as F

from litmill.sources import bibliography, files

N = 10_000


@pytest.fixture
def ranges(spark):
    """Sets the size of ranges."""
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")

    def of(path, count):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(path.stat().st_size // count + 1))
        spark.conf.set("spark.sql.files.openCostInBytes", "1")

    yield of
    spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
    spark.conf.set("spark.sql.files.openCostInBytes", before[1])


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def titles(seed):
    r = random.Random(seed)
    return [" ".join(r.choices(["Sea", "of", "größe", "{Brace}", "a@b", "TY", "waves"], k=r.randint(1, 12))) + f" {i}" for i in range(N)]


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_ris(spark, tmp_path, ranges, end):
    text = "".join(f"TY  - JOUR{end}TI  - {t}{end}AU  - A, B{end}AU  - C{end}PY  - {1900 + i % 100}/01{end}DO  - 10.1/{i}{end}ER  - {end}{end}" for i, t in enumerate(titles(1))) + f"TY  - BOOK{end}AU  - Untitled{end}"
    path = tmp_path / "a.ris"
    path.write_bytes(b"\xef\xbb\xbf" + text.encode())
    ranges(path, 4)
    df = files.read_ris_files(spark, str(path))
    assert df.rdd.getNumPartitions() >= 4
    want = bibliography.read_ris(spark.createDataFrame([(text,)], "text string")).drop("pos")
    assert rows_of(df.drop("file")) == rows_of(want) and df.count() == N


def test_bibtex(spark, tmp_path, ranges):
    text = "% a header\n@comment{x}\n" + "".join(f"@article{{k{i},\n  title = {{{t}}},\n  author = {{Sea, Ada and Bo Chu}},\n year = {1900 + i % 100}, doi = \"10.1/{i}\"\n}}\n{'  ' if i % 7 == 0 else ''}" for i, t in enumerate(titles(2)))
    path = tmp_path / "a.bib"
    path.write_text(text)
    ranges(path, 4)
    df = files.read_bibtex_files(spark, str(path))
    assert df.rdd.getNumPartitions() >= 4
    want = bibliography.read_bibtex(spark.createDataFrame([(text,)], "text string")).drop("pos")
    assert rows_of(df.drop("file")) == rows_of(want) and df.count() == N


@pytest.mark.parametrize(("indent", "wrap"), [(None, True), (2, True), (None, False)])
def test_csl(spark, tmp_path, ranges, indent, wrap):
    items = [{"id": str(i), "type": "book", "title": t + ' \\ "q} {" }', "author": [{"family": "Sea", "given": "A"}, {"family": "{"}], "issued": {"date-parts": [[1900 + i % 100]]}, "DOI": f"10.1/{i}"} for i, t in enumerate(titles(3))]
    items[50]["title"] = "x}" * 200_000  # over several ranges
    text = json.dumps(items, indent=indent) if wrap else "\n".join(json.dumps(x) for x in items)
    path = tmp_path / "a.json"
    path.write_text(text + "\n")
    ranges(path, 9)
    df = files.read_csl_files(spark, str(path))
    got = {r.doi: (r.title, r.year, r.authors) for r in df.collect()}
    assert len(got) == df.count() == N
    assert all(got[x["DOI"]] == (x["title"], x["issued"]["date-parts"][0][0], ["A Sea", "{"]) for x in items)


def test_files_that_say_little(spark, tmp_path):
    for name, text in (("a.json", ""), ("b.json", "[]"), ("c.json", '{"id": "1", "title": "Only"}'), ("d.json", '[{"id": "2", "title": "open"')):
        (tmp_path / name).write_text(text)
    got = {r.title for r in files.read_csl_files(spark, str(tmp_path)).where(F.col("title").isNotNull()).collect()}
    assert got >= {"Only"} and got <= {"Only", "open"}
