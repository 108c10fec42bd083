"""The topic graph asks for the neighbours of every vector, in the query and in its SQL."""

import duckdb

from litmill.queries import QUERIES, SQL


def test_every_vector_asks(spark, tables):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tables}/embeddings.parquet'")
    vectors = "WITH vectors AS (SELECT vec_id AS chunk_id, label AS work_id, CAST(embedding AS DOUBLE[]) AS vector FROM embeddings), "
    want = con.sql(vectors + SQL["topic_graph"][SQL["topic_graph"].index("s AS (SELECT q.chunk_id") :]).fetchall()
    got = [tuple(r) for r in QUERIES["topic_graph"](spark, tables).collect()]
    assert sorted(got) == sorted(want)
    few = {(r.query_id, r.id) for r in QUERIES["nearest_vectors"](spark, tables).collect()}
    assert {(min(x), max(x)) for x in few} < {(a, b) for a, b, _ in got} and any(a % 100 and b % 100 for a, b, _ in got)
