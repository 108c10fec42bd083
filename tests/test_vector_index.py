"""The inverted file against the exact scan: recall with filters, lists read, exactness, awkward vectors."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from litmill.operators import vector_index

DDL = "id long, vector array<double>"


def clustered(n=10_000, width=24, kinds=60, seed=5):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(kinds, width))
    return centres[r.integers(0, kinds, n)] + 0.6 * r.normal(size=(n, width))


def plain(x, queries, k, least, visible=None):
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    score = np.round(unit[queries] @ unit.T, 9)
    score[np.arange(len(queries)), queries] = -np.inf
    if visible is not None:
        score[:, ~visible] = -np.inf
    out = {}
    for i, q in enumerate(queries):
        best = np.lexsort((np.arange(len(x)), -score[i]))[:k]
        out[q] = [(int(j), float(score[i, j])) for j in best if score[i, j] >= least]
    return out


@pytest.fixture(scope="module")
def vectors(spark, tmp_path_factory):
    x = clustered()
    folder = str(tmp_path_factory.mktemp("vectors"))
    spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], DDL).write.parquet(f"{folder}/table")
    table = spark.read.parquet(f"{folder}/table")
    vector_index.built(table, f"{folder}/index")
    return x, table, vector_index.opened(spark, f"{folder}/index")


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: r.place):
        out.setdefault(r.query_id, []).append((r.id, r.score))
    return out


def recall(got, expected):
    hits = sum(len({i for i, _ in got.get(q, [])} & {i for i, _ in e}) for q, e in expected.items())
    return hits / sum(map(len, expected.values()))


@pytest.mark.parametrize("share", [None, 0.05, 0.3, 0.6])
def test_recall(spark, vectors, share):
    x, table, index = vectors
    assert index.count == len(x) and len(index.sizes) == 100
    queries = table.where("id % 100 = 0").select(F.col("id").alias("query_id"), "vector")
    seen = None if share is None else np.random.default_rng(1).random(len(x)) < share
    visible = None if share is None else spark.createDataFrame([(i,) for i in np.flatnonzero(seen).tolist()], "id long")
    expected = plain(x, list(range(0, len(x), 100)), 10, -1.0, seen)
    got = found(vector_index.search(index, queries, 10, -1.0, visible))
    assert recall(got, expected) >= (1.0 if share == 0.05 else 0.9)
    whole = found(vector_index.search(index, queries, 10, -1.0, visible, probes=4, exact=True))
    assert {q: [i for i, _ in e] for q, e in whole.items()} == {q: [i for i, _ in e] for q, e in expected.items()}


def test_only_probed_lists_are_read(spark, vectors):
    x, table, index = vectors
    queries = table.where("id = 7").select(F.col("id").alias("query_id"), "vector")
    df = vector_index.search(index, queries, 5, 0.0, probes=3)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [list#" in plan and " IN (" in plan
    lists = {r.list for r in index.rows.join(df.select("id"), "id", "left_semi").select("list").distinct().collect()}
    assert 1 <= len(lists) <= 3


def test_hot_lists_are_dealt(spark, vectors, tmp_path, monkeypatch):
    """A third of all vectors alike, and blocks of a few rows."""
    monkeypatch.setattr(vector_index, "ROWS", 32)
    x = clustered(600, 8, 5)
    x[::3] = x[0]
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], DDL)
    vector_index.built(table, str(tmp_path), lists=6)
    index = vector_index.opened(spark, str(tmp_path))
    queries = table.select(F.col("id").alias("query_id"), "vector")
    expected = plain(x, list(range(len(x))), 5, 0.2)
    got = found(vector_index.search(index, queries, 5, 0.2, probes=1, exact=True))
    for q, e in expected.items():
        assert [s for _, s in got.get(q, [])] == pytest.approx([s for _, s in e], abs=2e-9), q


def test_awkward_vectors(spark, tmp_path):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [math.nan, 1.0]), (6, [1.0]), (7, [None, 1.0]), (8, [0.0, -3.0]), (2, [2.0, 0.0])]
    table = spark.createDataFrame(rows, DDL)
    vector_index.built(table.where("id <> 6"), f"{tmp_path}/a")
    index = vector_index.opened(spark, f"{tmp_path}/a")
    assert index.count == 4
    got = found(vector_index.search(index, table.withColumnRenamed("id", "query_id"), 3, 0.5, exact=True))
    assert got == {1: [(2, 1.0), (2, 1.0)], 2: [(1, 1.0)]}
    vector_index.built(table.limit(0), f"{tmp_path}/b")
    nothing = vector_index.opened(spark, f"{tmp_path}/b")
    assert nothing.count == 0 and vector_index.search(nothing, table.withColumnRenamed("id", "query_id"), 3).collect() == []


def test_index_is_written_once(spark, tmp_path):
    table = spark.createDataFrame([(i, [float(i % 5), 1.0]) for i in range(50)], DDL)
    table.write.parquet(f"{tmp_path}/t")
    table = spark.read.parquet(f"{tmp_path}/t")
    a = vector_index.stored("once", table, table)
    b = vector_index.stored("once", table, table)
    c = vector_index.stored("once", table, table, lists=3)
    assert a.rows.inputFiles() == b.rows.inputFiles() != c.rows.inputFiles() and len(c.sizes) == 3


def test_what_is_sent_does_not_grow_with_the_lists(spark, tmp_path, monkeypatch):
    """Every vector asks for all of many lists: it goes to each bundle once, not to each list."""
    monkeypatch.setattr(vector_index, "ROWS", 32)

    def counted(*_):
        import uuid

        import pyarrow as pa

        return lambda part, asked: pa.table({"query_id": [uuid.uuid4().int % 2**62], "id": [part.num_rows + asked.num_rows], "score": [1.0]})

    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(clustered(600, 8, 5))], DDL)
    vector_index.built(table, str(tmp_path), lists=60)
    index = vector_index.opened(spark, str(tmp_path))
    monkeypatch.setattr(vector_index, "_product", counted)
    sent = vector_index.search(index, table.withColumnRenamed("id", "query_id"), 5, -1.0, probes=60)
    assert 2 * 600 <= sent.agg(F.sum("id")).first()[0] <= 16 * 600


@pytest.mark.parametrize(("rows", "tile", "cells"), [(8, 16, 64), (64, 1 << 20, 1 << 23), (4096, 100, 256)])
def test_ties_are_placed_by_id_in_blocks_of_any_size(spark, tmp_path, monkeypatch, rows, tile, cells):
    for name, value in (("ROWS", rows), ("TILE", tile), ("CELLS", cells)):
        monkeypatch.setattr(vector_index, name, value)
    x = np.random.default_rng(2).integers(-2, 3, (300, 4)).astype(float)
    x[~x.any(axis=1)] = 1.0
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], DDL)
    vector_index.built(table, str(tmp_path), lists=9)
    index = vector_index.opened(spark, str(tmp_path))
    queries = table.withColumnRenamed("id", "query_id")
    few = spark.createDataFrame([(i,) for i in range(0, 300, 11)], "id long")
    seen = np.arange(300) % 11 == 0
    for k, visible, mask in ((4, None, None), (2, few, seen)):
        want = {q: e for q, e in plain(x, list(range(300)), k, 0.6, mask).items() if e}
        assert found(vector_index.search(index, queries, k, 0.6, visible, probes=2, exact=True)) == want
