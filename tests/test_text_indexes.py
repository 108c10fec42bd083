"""Substring search against a scan, and the index in batches against one made anew."""

import random
import shutil

import pytest
from pyspark.sql import functions as F

from litmill.operators import retrieval, segments, substring

ROWS = "id long, field string, text string"


@pytest.fixture(scope="module")
def texts(spark, tmp_path_factory):
    r = random.Random(8)
    letters = "abcdeABé%_ \\\nσςİß𝄞"
    rows = [(i, "".join(r.choices(letters, k=r.choice([0, 1, 2, 3, 10, 60, 400])))) for i in range(400)] + [(900, None), (901, "Needle in_hay%stack"), (901, "Needle in_hay%stack")]
    folder = str(tmp_path_factory.mktemp("texts"))
    spark.createDataFrame(rows, "id long, text string").write.parquet(f"{folder}/t")
    table = spark.read.parquet(f"{folder}/t")
    return rows, table, substring.stored("grams", table, table)


def test_substring_search(spark, texts):
    """Patterns of 1 to 20 letters, cut from texts or not, with and without wildcards."""
    rows, table, index = texts
    r = random.Random(9)
    patterns = ["NEEDLE", "needle in_hay", "hay%stack", "n%stack", "_", "%", "", "é", "ab", "xyzxyz", "\\", "i̇", "\n", "ΣΣ"]
    while len(patterns) < 40:
        text = r.choice(rows)[1] or ""
        at = r.randrange(len(text) + 1)
        patterns.append(text[at : at + r.randint(1, 20)])
    answers = {p: sorted(x.id for x in substring.search(index, table, p).collect()) for p in patterns}
    scan = table.select("id", *[substring.contains(F.col("text"), p).alias(f"p{k}") for k, p in enumerate(patterns)]).collect()
    for k, p in enumerate(patterns):
        assert answers[p] == sorted(x.id for x in scan if x[f"p{k}"]), p
    assert answers["NEEDLE"] == [901, 901]


def test_only_the_patterns_trigrams_are_read(texts):
    _, _, index = texts
    df = substring.candidates(index, "needle in")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "part#" in plan and "PushedFilters: [In(gram" in plan
    assert df.collect()[0].id == 901 and substring.candidates(index, "a%b_c") is None
    assert substring.wanted("AbcD%efg_h") == ["abc", "bcd", "efg"]


def test_batches_equal_an_index_made_anew(spark, tmp_path):
    """Ten files; one is replaced, one removed, one added: only new ones are read again."""
    r = random.Random(4)
    words = [f"w{k}" for k in range(40)]

    def file(k, seed):
        r.seed(seed)
        spark.createDataFrame([(100 * k + i, r.choice(["title", "abstract", "body_low"]), " ".join(r.choices(words, k=r.randint(0, 12)))) for i in range(12)], ROWS).coalesce(1).write.mode("overwrite").parquet(f"{tmp_path}/t/file={k}")

    def state():
        table = spark.read.parquet(f"{tmp_path}/t")
        seen = []

        def rows_of(docs):
            seen.extend(docs.inputFiles())
            return docs.select("id", "field", "text")

        folder, living = segments.kept_up(table, f"batches-{tmp_path.name}", "id", rows_of)
        got = {(x.term, x.id): x.score for x in segments.scored(folder, living, "w1 w2 w3 the").collect()}
        anew = retrieval.field_postings(table.select("id", "field", "text")).where("term in ('w1', 'w2', 'w3')")
        want = {(x.term, x.id): x.score for x in anew.collect()}
        assert got.keys() == want.keys() and want and all(got[k] == pytest.approx(want[k], rel=1e-12) for k in want)
        return len(seen)

    for k in range(10):
        file(k, k)
    assert state() == 10
    assert state() == 0
    file(3, 99)
    assert state() == 1
    shutil.rmtree(f"{tmp_path}/t/file=5")
    file(11, 12)
    assert state() == 1


def test_batches_of_nothing(spark, tmp_path):
    spark.createDataFrame([(1, "title", "the of"), (2, "title", None)], ROWS).coalesce(1).write.parquet(f"{tmp_path}/t")
    table = spark.read.parquet(f"{tmp_path}/t")
    folder, living = segments.kept_up(table, f"none-{tmp_path.name}", "id", lambda d: d)
    assert segments.scored(folder, living, "w1 the").collect() == [] and segments.scored(folder, living, "the").collect() == []
    assert segments.kept_up(table, f"none-{tmp_path.name}", "id", lambda d: 1 / 0)[0] == folder
