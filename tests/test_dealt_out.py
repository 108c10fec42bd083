"""What a task holds does not grow with the input: rows are dealt out by their number, pairs are met as products."""

import re

import numpy as np
import pytest

from litmill.operators import access, graph, resolution, retrieval
from litmill.session import spread
from litmill.sources import records, tei


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_records_of_one_task_are_parsed_by_many(spark):
    one = spark.range(5_000).coalesce(1).selectExpr("id", "'<x/>' as text")
    assert records.read_atom(one).rdd.getNumPartitions() == 3 and tei.read_tei_records(one).rdd.getNumPartitions() == 3
    assert spread(one, "id", most=1_000).rdd.getNumPartitions() == 5


def test_grants_are_told_apart_by_sets_of_groups(spark):
    members = spark.createDataFrame([(1, 1), (1, 2), (1, 2), (2, 2), (2, 1), (3, 3), (None, 3), (4, None)], "user_id long, group_id long")
    grants = spark.createDataFrame([(1, "shelf", 5), (2, "shelf", 5), (2, "shelf", 6), (3, "rack", 9), (3, "shelf", 7), (3, "shelf", 7)], "group_id long, target_type string, target_id long")
    mine = access.granted(members, grants, "shelf")
    assert sorted(map(tuple, mine.collect()), key=repr) == sorted([(1, 5), (1, 6), (2, 5), (2, 6), (3, 7), (None, 7)], key=repr)
    users = spark.createDataFrame([(1, "librarian"), (3, "reader"), (9, "owner"), (8, None)], "user_id long, role string")
    shelves = spark.createDataFrame([(5, "private"), (7, "private"), (8, None)], "id long, access_level string")
    rights = access.container_rights(users, shelves, mine)
    # Neither of the joins makes a row for each user and target.
    assert not re.search(r"Join \[[^\]]*user_id[^\]]*target_id", plan(rights))
    got = {(r.user_id, r.target_id): (r.sees, r.changes) for r in rights.collect()}
    assert len(got) == 12 and got[1, 5] == (True, True) and got[1, 7] == (False, False) and got[3, 7] == (True, False) and got[9, 7] == (True, True) and got[3, 8][0]


def test_edges_of_mentions_without_structs(spark):
    make = lambda rows: spark.createDataFrame(rows, "src long, dst long, weight long")
    df = resolution.typed_edges(make([(1, 2, 3), (1, 2, 4), (5, 6, None)]), make([(1, 2, 9), (3, 4, 1), (3, 4, 1), (5, 6, 2)]))
    assert "SortAggregate" not in plan(df) and "ObjectHashAggregate" not in plan(df)
    assert {tuple(r) for r in df.collect()} == {(1, 2, "reference", 7), (3, 4, "citing", 2), (5, 6, "reference", None)}


def test_pairs_are_dealt_out_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(spread, "__kwdefaults__", {"most": 10, "count": None})
    links = spark.createDataFrame([(i, j) for i in range(20) for j in range(3)], "citing_id long, cited_id long")
    df = graph.coupling(links)
    assert "hashpartitioning(a#" in plan(df) and f", {20 * 19 // 2 * 3 // 10}), REPARTITION_BY_NUM" in plan(df)
    assert {tuple(r) for r in df.collect()} == {(a, b, 3) for a in range(20) for b in range(a + 1, 20)}


@pytest.mark.parametrize("least", [0.3, 0.0, -2.0])
def test_nearest_by_blocks(spark, monkeypatch, least):
    """Against all cosines, with copies, other widths and vectors that are null or zero."""
    rng = np.random.default_rng(3)
    rows = [(i, rng.integers(-3, 4, 3 if i % 11 == 5 else 4).astype(float).tolist()) for i in range(120)] + [(200, None), (201, [0.0] * 4), (202, [1.0, 2.0, 0.0, 0.0]), (203, [1.0, 2.0, 0.0, 0.0])]
    for name, value in (("QUERIES", 7), ("ROWS", 16), ("ASKED", 3)):
        monkeypatch.setattr(graph, name, value)
    v = spark.createDataFrame(rows, "chunk_id long, vector array<double>").coalesce(1)
    df = graph.nearest(v, v.where("chunk_id % 5 = 0"), 4, least)
    assert "NestedLoopJoin" not in plan(df)

    def cosine(a, b):
        return round(float(np.dot(a, b) / np.sqrt(np.dot(a, a) * np.dot(b, b))), 9) if a and b and len(a) == len(b) and any(a) and any(b) else 0.0

    got = {}
    for r in df.collect():
        got.setdefault(r.query_id, {})[r.place] = (r.id, r.score)
    for i, q in rows:
        if i % 5 == 0:
            want = sorted((-cosine(q, x), j) for j, x in rows if j != i and cosine(q, x) >= least)[:4]
            assert got.get(i, {}) == {place: (j, pytest.approx(-s, abs=1e-9)) for place, (s, j) in enumerate(want, 1)}


def test_shortlists_in_blocks_without_pairs(spark, monkeypatch):
    rng = np.random.default_rng(5)
    bags = [(i, int(b), float(x)) for i in range(40) for b, x in zip(rng.choice(30, 5, replace=False), rng.integers(-3, 4, 5))]
    p = spark.createDataFrame(bags, "id long, bucket int, x double")
    c = p.where("id < 25").withColumnRenamed("id", "label")
    whole = retrieval.prefiltered(p, c, 6)
    assert "Join" not in plan(whole)
    want = {tuple(r) for r in whole.collect()}
    monkeypatch.setattr(retrieval, "SENT", 20)
    monkeypatch.setattr(retrieval, "CELLS", 64)
    assert {tuple(r) for r in retrieval.prefiltered(p, c, 6).collect()} == want and len(want) == 240
    assert {(r.id, r.label) for r in retrieval.label_affinity(p, c, 1).where("score > 0.9999999").collect()} >= {(i, i) for i in range(25) if any(x and b == i for b, _, x in bags)} - {(i, i) for i in range(25) if sum(x * x for b, _, x in bags if b == i) == 0}
