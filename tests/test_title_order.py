"""Places in the order of titles against SQL, also for papers without a title."""

import duckdb
from pyspark.sql import functions as F

from litmill import queries_more
from litmill.catalog import Catalog
from litmill.queries import SQL


def test_title_order_counts_from_one_and_has_nulls_last(spark, tables):
    parts = spark.read.parquet(f"{tables}/part.parquet")
    k = F.col("p_partkey")
    odd = parts.withColumns({"p_name": F.when(k % 5 == 0, None).when(k % 7 == 0, "").when(k % 3 == 0, F.upper("p_name")).otherwise(F.col("p_name")), "p_brand": F.when(k % 10 != 0, F.col("p_brand"))})
    rows = [tuple(r) for r in odd.select("p_partkey", "p_name", "p_brand").collect()]
    con = duckdb.connect()
    con.sql("create table part (p_partkey bigint, p_name varchar, p_brand varchar)")
    con.executemany("insert into part values (?, ?, ?)", rows)
    con.sql("create view refs as select p_partkey id, p_name title, p_brand venue from part")
    want = con.sql("select " + SQL["title_order"].rpartition("SELECT ")[2]).fetchall()
    got = queries_more.title_order.__wrapped__(Catalog(spark, tables).over(part=odd)) if hasattr(queries_more.title_order, "__wrapped__") else queries_more.title_order(Catalog(spark, tables).over(part=odd))
    assert sorted(map(tuple, got.collect())) == sorted(want)
