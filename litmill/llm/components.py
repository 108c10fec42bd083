"""Connected components of a graph given as a DataFrame of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import cut


#: Parts that the rows of one key are dealt into, where a key may hold a large share of all rows.
SALTS = 8


def met(many: DataFrame, few: DataFrame, by: str, spread: str, how: str = "inner") -> DataFrame:
    """many joined with few (a row for each value of `by`), the rows of a value dealt by `spread`, so that no task gets all of them."""
    left = many.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int"))
    right = few.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return left.join(right, [by, "_salt"], how).drop("_salt")


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): the smallest node reachable from each node that has an edge.

    Alternating star contraction: every round hangs each node's larger
    neighbours, then its smaller ones, on the smallest neighbour, so the number
    of rounds is logarithmic.  Only a minimum per node is aggregated and joined
    back to its edges, which are dealt out, so no neighbourhood is gathered in
    one place.  Self-loops and
    repeated edges are allowed; nodes without edges are not returned.
    """
    edges = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    edges = cut(edges)
    before = None
    while True:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        hung = met(both.where("v > u"), least, "u", "v").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = hung.groupBy("u").agg(F.min("v").alias("m"))
        moved = met(hung, low, "u", "v").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = cut(moved.unionAll(low.select("u", F.col("m").alias("v"))).distinct())
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(
                edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
        before = now
