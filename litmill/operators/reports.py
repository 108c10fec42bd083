"""Summaries of a library: years, venues, missing and isolated papers, coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut


def chronology(works: DataFrame) -> DataFrame:
    """Papers by year, unknown years last."""
    return works.groupBy("year").agg(F.count("*").alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id")).orderBy(F.col("year").asc_nulls_last())


def venues(works: DataFrame, name: str = "venue") -> DataFrame:
    """Venues by normalised name: papers, share in percent, years, and how many spellings there are."""
    key = F.trim(F.regexp_replace(F.lower(F.col(name)), "[^a-z0-9]+", " "))
    by = works.where(F.col(name).isNotNull()).groupBy(key.alias("venue_key")).agg(F.count("*").alias("n"), F.min("year").alias("first_year"), F.max("year").alias("last_year"), F.countDistinct(name).alias("spellings"))
    total = by.agg(F.sum("n").alias("total"))
    return by.crossJoin(total).select("venue_key", "n", F.round(100.0 * F.col("n") / F.col("total"), 1).alias("pct"), "first_year", "last_year", "spellings")


def missing_works(citations: DataFrame, works: DataFrame, cited_key: str, least: int = 2) -> DataFrame:
    """Cited papers that the library lacks, with the number of different citing papers and of mentions."""
    wanted = citations.groupBy(F.col(cited_key).alias("missing_id")).agg(F.countDistinct("citing_id").alias("cited_by"), F.count("*").alias("mentions")).where(F.col("cited_by") >= least)
    return wanted.join(works.select(F.col("id").alias("missing_id")), "missing_id", "left_anti")


def in_degree(citations: DataFrame, limit: int) -> DataFrame:
    """The most cited papers by different citing papers."""
    return citations.groupBy("cited_id").agg(F.countDistinct("citing_id").alias("in_degree")).orderBy(F.desc("in_degree"), "cited_id").limit(limit)


def isolated(works: DataFrame, edges: DataFrame) -> DataFrame:
    """Papers without a link in either direction."""
    ends = edges.select(F.col("src").alias("_end")).union(edges.select(F.col("dst").alias("_end")))
    return works.join(ends, works["id"] == F.col("_end"), "left_anti")


def topic_river(rows: DataFrame, year: str, topic: str) -> DataFrame:
    """Share of each topic in each year, zeros filled in, four places."""
    counts = rows.groupBy(F.col(year).alias("year"), F.col(topic).alias("topic")).count()
    years, topics = counts.select("year").distinct(), counts.select("topic").distinct()
    full = years.crossJoin(topics).join(counts, ["year", "topic"], "left")  # distinct years times distinct topics
    share = F.coalesce("count", F.lit(0)) / F.sum("count").over(Window.partitionBy("year"))
    return full.select("year", "topic", F.round(share, 4).alias("share"))


def section_mentions(citations: DataFrame, weights: dict[str, int]) -> DataFrame:
    """Mentions of each cited paper by section, and their weighted sum."""
    columns = [F.count_if(F.col("section") == s).alias(f"n_{s.lower()}") for s in weights]
    weighted = sum(F.count_if(F.col("section") == s) * w for s, w in weights.items())
    return citations.groupBy("cited_id").agg(*columns, weighted.alias("weighted"))


def signature(works: DataFrame, chunks: DataFrame) -> DataFrame:
    """One string that changes whenever the corpus does."""
    a = works.agg(F.count("*").alias("n"), F.max("updated_at").alias("m"))
    return a.crossJoin(chunks.agg(F.count("*").alias("c"))).select(F.concat_ws(":", "n", F.date_format("m", "yyyy-MM-dd"), "c").alias("signature"))  # two single rows


def evenly_sampled(rows: DataFrame, by: list[str], cap: int) -> DataFrame:
    """`cap` rows at even distances in the given order, all if there are fewer.

    Rows are numbered without a global window: counts per range partition give
    each partition its first number.
    """
    n = rows.count()
    if n <= cap:
        return rows
    ordered = rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_part", F.spark_partition_id())
    ordered = ordered.withColumn("_at", F.monotonically_increasing_id() - F.shiftleft(F.col("_part").cast("long"), 33))
    ordered = cut(ordered)  # read twice, so it must stay as it is
    sizes = {r["_part"]: r["count"] for r in ordered.groupBy("_part").count().collect()}  # a row per partition
    first, total = {}, 0
    for part in sorted(sizes):
        first[part], total = total, total + sizes[part]
    start = F.create_map(*[F.lit(v) for p in first for v in (p, first[p])])
    at = F.col("_at") + start[F.col("_part")]
    # Row number at is chosen if it is floor(i * n / cap) for some i.
    i = F.ceil(at * cap / F.lit(n)).cast("long")
    return ordered.where((i < cap) & (F.floor(i * n / F.lit(cap)) == at)).drop("_part", "_at")


def authors(works: DataFrame, names: str = "authors") -> DataFrame:
    """Authors by surname and initial: in how many papers, and in how many spellings."""
    from ..functions.names import person

    one = works.select("id", F.explode(F.split(names, ";")).alias("name")).where("trim(name) <> ''")
    return one.groupBy(person(F.col("name")).alias("author")).agg(F.countDistinct("id").alias("n"), F.countDistinct(F.trim("name")).alias("spellings"))


def folded_authors(works: DataFrame, names: str = "authors") -> DataFrame:
    """`authors` where accents and case make no difference; each spelling is folded once."""
    from ..functions.names import folded, person

    one = works.select("id", F.explode(F.split(names, ";")).alias("name")).select("id", F.trim("name").alias("name")).where("name <> ''")
    keys = one.select("name").distinct().withColumn("author", person(folded("name")))
    return one.join(keys, "name").groupBy("author").agg(F.countDistinct("id").alias("n"), F.countDistinct("name").alias("spellings"))


def first_container(shelf_works: DataFrame, shelves: DataFrame) -> DataFrame:
    """The least name of each paper's public shelves, for sorting by shelf."""
    return shelf_works.join(shelves.where(F.col("access_level").isin("open", "visible")), "shelf_id").groupBy("work_id").agg(F.min("name").alias("shelf"))


def warned(works: DataFrame, warnings: list[DataFrame]) -> DataFrame:
    """Ids with a flag: whether any of the warning lists (id) names them."""
    ids = None
    for w in warnings:
        ids = w.select("id") if ids is None else ids.union(w.select("id"))
    ids = ids.distinct().select(F.col("id").alias("_id"), F.lit(True).alias("_w"))
    return works.select("id").join(ids, F.col("id") == F.col("_id"), "left").select("id", F.coalesce("_w", F.lit(False)).alias("warning"))


def chronology_members(works: DataFrame) -> DataFrame:
    """(year, n, members): papers of each year, by id."""
    ids = F.transform(F.array_sort(F.collect_list("id")), lambda i: i.cast("string"))
    return works.groupBy("year").agg(F.count("*").alias("n"), F.array_join(ids, ",").alias("members"))


#: Ids that a page of a chronology spans.
PAGE = 1000


def chronology_pages(works: DataFrame) -> DataFrame:
    """(year, page, n, members): papers of each year by id, in pages that span PAGE ids, so that a year of any size stays in rows of bounded size."""
    ids = F.transform(F.array_sort(F.collect_list("id")), lambda i: i.cast("string"))
    return works.groupBy("year", F.floor(F.col("id") / PAGE).alias("page")).agg(F.count("*").alias("n"), F.array_join(ids, ",").alias("members"))


def spellings(works: DataFrame) -> DataFrame:
    """(venue_key, venue, n): venues that differ in case and marks only as one, in the most frequent spelling, then the longest, then the last."""
    key = F.trim(F.regexp_replace(F.lower("venue"), "[^a-z0-9]+", " "))
    counts = works.where("venue is not null").groupBy(key.alias("venue_key"), "venue").agg(F.count("*").alias("n"))
    return counts.groupBy("venue_key").agg(F.max_by("venue", F.struct("n", F.length("venue").alias("l"), "venue")).alias("venue"), F.sum("n").alias("n"))
