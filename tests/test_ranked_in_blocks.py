"""Candidates ranked by kinds against the ranking of all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from litmill import queries_text
from litmill.catalog import Catalog
from litmill.operators import linkage


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_the_ranking_of_all_pairs(spark, seed):
    r = random.Random(seed)
    title = lambda: r.choice([None, "", *(" ".join(r.choices(["sea", "Salt", "stone!"], k=r.choice([1, 2, 3]))) for _ in range(8))])
    year, names = lambda: r.choice([None, 2000, 2001, 2005]), lambda: r.choice([None, [], ["A Sea"], ["B Salt", " "], ["C Stone", "A Sea"]])
    wanted = [(r.choice(["x", "y", None]), i, title(), year(), names()) for i in range(60)]
    wanted += [wanted[0], (*wanted[1][:2], "sea", 2001, [])]  # ids that come twice
    given = [(r.choice(["x", "y", None]), i, title(), year(), names(), r.choice([True, False, None])) for i in range(90)]
    q = spark.createDataFrame(wanted, "block string, query_id long, wanted_title string, wanted_year int, wanted_authors array<string>")
    c = spark.createDataFrame(given, "block string, cand_id long, title string, year int, authors array<string>, open boolean")
    for k in (1, 3):
        want = sorted(map(repr, linkage.ranked_candidates(q.join(c, "block"), k).collect()))
        assert sorted(map(repr, linkage.ranked_in_blocks(q, c, k).collect())) == want
    assert linkage.ranked_in_blocks(q, c.limit(0), 3).count() == 0


def test_copies_multiply_no_pairs(spark, tables):
    """100 copies of the papers are 10,000 times the pairs of rows, 40 million here."""
    c = Catalog(spark, tables)
    part = c.table("part")
    many = part.crossJoin(spark.range(100).select((F.col("id") * 2 * 3 * 5000).alias("_by"))).withColumn("p_partkey", F.col("p_partkey") + F.col("_by")).drop("_by")
    few = {(r.query_id, r.place): r.score for r in queries_text.ranked_candidates(c).collect()}
    got = queries_text.ranked_candidates(c.over(part=many))
    rows = got.collect()
    assert len(rows) == 300 * part.count()
    best = {r.query_id: r.score for r in rows if r.place == 1}
    assert all(best[i] == score for (i, place), score in few.items() if place == 1)
