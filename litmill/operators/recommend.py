"""Recommended shelves and racks for papers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def combined(scores: DataFrame, links: DataFrame, mode: str = "sum") -> DataFrame:
    """(parent_id, score): scores of children (child_id, score) combined by parent: sum, max or median."""
    how = {"sum": F.sum, "max": F.max, "median": F.median}[mode]
    return links.join(scores, "child_id").groupBy("parent_id").agg(F.round(how("score"), 6).alias("score"))


def assignable(tags: DataFrame, applied: DataFrame) -> DataFrame:
    """(work_id, tag) that a paper does not have, of the tags that papers have at all."""
    works, names = applied.select("work_id").distinct(), tags.select("tag").distinct()
    return works.crossJoin(names).join(applied, ["work_id", "tag"], "left_anti")


def rank_points(ranked: DataFrame, k: int) -> DataFrame:
    """(work_id, child_id, points): k for the first place, one less for each after, nothing below."""
    return ranked.where(F.col("place") <= k).withColumn("points", F.greatest(F.lit(0), k - F.col("place") + 1).cast("double"))


def propagated(base: DataFrame, chain: DataFrame, weight: float = 0.5, mode: str = "sum") -> DataFrame:
    """(level, id, score): scores (level, id, score) of rows, racks and shelves after each level has taken part of its parent's.

    chain is (level, id, parent_level, parent_id), top level first by `level` number.
    """
    how = {"sum": F.sum, "max": F.max, "median": F.median}[mode]
    levels = sorted(r["level"] for r in base.select("level").distinct().collect())  # a row per level
    done = None
    for level in levels:
        own = base.where(F.col("level") == level).select("level", "id", "score")
        if done is not None:
            up = chain.where(F.col("level") == level).select(F.col("id").alias("_id"), "parent_level", "parent_id")
            given = up.join(done.select(F.col("level").alias("parent_level"), F.col("id").alias("parent_id"), F.col("score").alias("_s")), ["parent_level", "parent_id"]).groupBy("_id").agg(how("_s").alias("_s"))
            own = own.join(given, own["id"] == given["_id"], "left").select("level", "id", (F.col("score") + weight * F.coalesce("_s", F.lit(0.0))).alias("score"))
        done = own if done is None else done.unionAll(own)
    return done.withColumn("score", F.round("score", 6))


def candidates(found: DataFrame) -> DataFrame:
    """Candidates (doi, title, year, source, authors) as one row per DOI, or per title and year without one; sources joined, longest author list."""
    key = F.coalesce(F.lower("doi"), F.concat_ws("|", F.lower("title"), F.col("year").cast("string")))
    return found.withColumn("key", key).groupBy("key").agg(
        F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"),
        F.max_by("authors", F.struct(F.size("authors").alias("n"), F.col("source"))).alias("authors"),
        F.min("title").alias("title"),
        F.min("year").alias("year"),
    )


def candidate_score(similarity, same_year, author_share, open_access):
    """0.6 of the title's similarity, 0.2 for the year, 0.2 for authors, 0.05 for open access, at most 1."""
    return F.least(F.lit(1.0), 0.6 * similarity + 0.2 * same_year.cast("double") + 0.2 * author_share + 0.05 * open_access.cast("double"))
