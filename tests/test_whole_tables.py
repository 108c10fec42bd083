"""Queries over whole tables reach what the filtered ones leave out."""

from litmill import queries as Q


def test_whole_neighbourhood(spark, tables):
    lines = [(r.l_orderkey, r.l_partkey) for r in spark.read.parquet(f"{tables}/lineitem.parquet").collect()]
    near = {}
    for a, b in lines:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    want, edge = {1: 0}, {1}
    for hop in (1, 2):
        edge = {b for a in edge for b in near.get(a, ())} - set(want)
        want |= dict.fromkeys(edge, hop)
    got = {r.node: r.hop for r in Q.QUERIES["whole_neighbourhood"](spark, tables).collect()}
    assert got == want and len(got) > Q.QUERIES["neighbourhood"](spark, tables).count()


def test_whole_candidates(spark, tables):
    lines = spark.read.parquet(f"{tables}/lineitem.parquet").selectExpr("least(l_orderkey, l_partkey) a", "greatest(l_orderkey, l_partkey) b").distinct()
    got = Q.QUERIES["whole_upserted_candidates"](spark, tables)
    assert {(r.a, r.b) for r in got.collect()} == {(r.a, r.b) for r in lines.collect()}
    assert {r.status for r in got.select("status").distinct().collect()} == {"open", "dismissed"}


def test_whole_staged(spark, tables):
    fates = {r.fate for r in Q.QUERIES["whole_staged_items"](spark, tables).select("fate").distinct().collect()}
    assert fates == {"in_library", "in_batch", "same_title", "accept"}
