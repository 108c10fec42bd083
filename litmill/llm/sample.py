"""Bounded samples of labelled documents to learn from: whole texts, chosen by hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sample_of(labels: DataFrame, label: str, fold: int, left_out: int, most: int) -> DataFrame:
    """(doc_id, label): at most `most` labelled documents outside the left-out fold, those of the least hash of doc_id.

    Rows without a doc_id or a label are passed over; of several labels of one
    doc_id the greatest counts.
    """
    named = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & (F.crc32(F.col("doc_id").cast("string")) % fold != left_out))
    return named.groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def chosen(docs: DataFrame, sample: DataFrame, weight: Column, each: int, total: int) -> DataFrame:
    """(doc_id, text, label) of the sampled documents that weigh at most `each` and, in order of hash, together at most `total`.

    So memory is bounded without cutting a text.  Of several texts of one
    doc_id the least counts; a doc_id without a row in docs is passed over.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    sized = rows.join(F.broadcast(sample), "doc_id").groupBy("doc_id", "label").agg(F.max(weight).alias("weight")).where(F.col("weight") <= each)
    # As many rows as the sample has, at most.
    so_far = F.sum("weight").over(Window.orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    kept = sized.withColumn("so_far", so_far).where(F.col("so_far") <= total).select("doc_id", "label")
    return rows.join(F.broadcast(kept), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text")).select("doc_id", "text", "label")
