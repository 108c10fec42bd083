"""Texts by section: what kind a section is, what belongs together, and what papers are described by."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Labels of sections of little weight, of those that are left out, and words of the buckets.
LOW = "introduc|related|background|prior work|motivation|acknowledg"
SKIPPED = r"reference|bibliograph|acknowledg|funding|conflict|competing\s+interest|author\s+contribution|data\s+availabilit|declaration|ethic|orcid|supplementary\s+material|supporting\s+information"
BUCKETS = {
    "Background": "title|abstract|introduction|intro|related|background|motivation|preliminar|overview",
    "Methods": "method|approach|model|architecture|implementation|experiment|setup|dataset|data|algorithm|design|framework",
    "Results": "result|discussion|conclusion|evaluation|analysis|finding|appendix|future|limitation",
}
#: Words of a heading that tell its kind; the first kind with one of its words counts.
HEADINGS = {
    "abstract": ("abstract",),
    "related": ("related", "state of the art", "state-of-the-art", "background", "prior work", "literature"),
    "introduction": ("introduction", "intro"),
    "methods": ("method", "approach", "materials", "architecture", "implementation"),
    "results": ("result", "experiment", "evaluation", "discussion", "analysis", "ablation", "findings"),
}
#: What a mention in a section of each kind weighs.
HEADING_WEIGHTS = {"abstract": 5, "methods": 4, "results": 3, "introduction": 2, "other": 2, "related": 1}
#: Letters of a description, labels in it.
DESCRIPTION, LABELS = 4000, 20


def index_field(label: Column) -> Column:
    low = F.lower(F.coalesce(label, F.lit("")))
    return F.when(label == "title", "title").when(label == "abstract", "abstract").when(low.rlike(LOW), "body_low").otherwise("body_high")


def skipped(label: Column) -> Column:
    return F.coalesce(F.lower(label).rlike(SKIPPED), F.lit(False))


def bucket(label: Column) -> Column:
    low = F.lower(F.coalesce(label, F.lit("")))
    return reduce(lambda out, item: out.when(low.rlike(item[1]), item[0]), list(BUCKETS.items())[1:], F.when(low.rlike(BUCKETS["Background"]), "Background")).otherwise("Other")


def heading_kind(label: Column) -> Column:
    """One of HEADING_WEIGHTS for the heading of a section; "other" where nothing fits or it has none."""
    low = F.lower(F.coalesce(label, F.lit("")))
    kinds = [F.when(low.rlike("|".join(words)), kind) for kind, words in HEADINGS.items()]
    return F.coalesce(*kinds, F.lit("other"))


def mains(sections: DataFrame) -> DataFrame:
    """(id, main, label, parts, letters): numbered main sections with all that follows up to the next one.

    A section is a main one if its whole number is greater than every one
    before it; what stands before the first belongs to that.  Texts without
    numbers are left out.
    """
    by = Window.partitionBy("id").orderBy("pos")
    number = F.regexp_extract(F.coalesce("label", F.lit("")), "^([0-9]+)[.)]? ", 1).try_cast("int")
    greatest = F.max("number").over(by.rowsBetween(Window.unboundedPreceding, -1))
    s = sections.withColumn("number", number).withColumn("main", (F.col("number") > F.coalesce(greatest, F.lit(0))).cast("int"))
    s = s.withColumn("main", F.coalesce("main", F.lit(0))).withColumn("group", F.sum("main").over(by))
    out = s.groupBy("id", F.greatest("group", F.lit(1)).alias("main")).agg(F.min_by("label", F.when(F.col("main") == 1, F.col("pos"))).alias("label"), F.count("*").alias("parts"), F.sum(F.length("text")).alias("letters"), F.max("group").alias("top"))
    return out.where("top > 0").drop("top")


def tiers(sections: DataFrame) -> DataFrame:
    """(id, tier, n_sections): how much of a paper there is."""
    body = F.max(~F.col("label").isin("title", "abstract"))
    return sections.groupBy("id").agg(F.when(body, "full_text").when(F.max(F.col("label") == "abstract"), "abstract_only").otherwise("title_only").alias("tier"), F.count("*").alias("n_sections"))


def feature_blocks(sections: DataFrame) -> DataFrame:
    """(id, block): title, first labels and abstract as one description of bounded length."""
    at = F.row_number().over(Window.partitionBy("id").orderBy("pos"))
    s = sections.withColumn("k", at).where((F.col("k") <= LABELS) | F.col("label").isin("title", "abstract"))

    def joined(column: str, when: Column | None, sep: str) -> Column:
        row = F.struct("pos", F.col(column).alias("v"))
        rows = F.collect_list(row if when is None else F.when(when, row))
        return F.nullif(F.array_join(F.transform(F.array_sort(rows), lambda x: x["v"]), sep), F.lit(""))

    f = s.groupBy("id").agg(joined("text", F.col("label") == "title", " ").alias("title"), joined("text", F.col("label") == "abstract", " ").alias("abstract"), joined("label", None, ", ").alias("topics"))
    block = F.concat_ws("\n", F.concat(F.lit("Title: "), F.coalesce("title", F.lit(""))), F.concat(F.lit("Topics: "), "topics"), F.concat(F.lit("Abstract: "), "abstract"))
    return f.select("id", F.substring(block, 1, DESCRIPTION).alias("block"))


def side_by_side(models: list[DataFrame]) -> DataFrame:
    """(work_id, vector): the mean vector of each paper in each model, of unit length, one after the other; what a model lacks is left out."""
    parts = None
    for k, chunks in enumerate(models):
        mean = chunks.select("work_id", F.posexplode("vector").alias("pos", "x")).groupBy("work_id", "pos").agg(F.avg("x").alias("x"))
        norm = mean.groupBy("work_id").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
        part = mean.join(norm.where("norm > 0"), "work_id").select("work_id", F.lit(k).alias("model"), "pos", (F.col("x") / F.col("norm")).alias("x"))
        parts = part if parts is None else parts.unionAll(part)
    rows = F.array_sort(F.collect_list(F.struct("model", "pos", "x")))
    return parts.groupBy("work_id").agg(F.transform(rows, lambda r: r["x"]).alias("vector"))


def rebuilt_topics(assignments: DataFrame, k: int) -> DataFrame:
    """(topic, members, terms): stored topics with their strongest terms."""
    weights = assignments.groupBy("topic", "term").agg(F.round(F.sum("value"), 4).alias("weight"))
    place = F.row_number().over(Window.partitionBy("topic").orderBy(F.desc("weight"), "term"))
    terms = weights.withColumn("place", place).where(F.col("place") <= k).groupBy("topic").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "term"))), lambda t: t["term"]), " ").alias("terms"))
    return assignments.groupBy("topic").agg(F.countDistinct("id").alias("members")).join(terms, "topic")
