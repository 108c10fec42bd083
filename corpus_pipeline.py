"""A cleaning pipeline over documents: each stage takes what the one before it kept.

What holds for all stages: columns other than doc_id and text are passed on as
they are, whatever their names; null and empty texts, repeated rows and rows
without a doc_id are decided like others (see the operators); an empty table
stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litmill.llm import queries
from litmill.llm.bpe import encoded, read_vocabulary
from litmill.llm.ngram_join import one_of_each
from litmill.llm.session import checkpoint_folder, table
from litmill.llm.winnow import contamination


def _with(docs: DataFrame, judge, verdict: str) -> DataFrame:
    """Rows of docs on which the verdict of `judge`, which adds score and predicted, holds; columns of these names are put aside meanwhile."""
    aside = {c: f"_own_{i}" for i, c in enumerate(docs.columns) if c.lower() in ("score", "predicted")}
    kept = judge(docs.withColumnsRenamed(aside)).where(verdict)
    return kept.select(*[F.col(aside.get(c, c)).alias(c) for c in docs.columns])


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not called toxic.  Texts without words have the score of no features, which is low."""
    return _with(docs, lambda d: queries.toxicity_of(spark, sf_dir, d), "predicted = 0")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are called good.  Null and empty texts are judged as one empty line."""
    return _with(docs, lambda d: queries.quality_of(spark, sf_dir, d), "predicted = 1")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five words, similarity 0.8 or more) the document with the smallest doc_id.

    Texts without words are no copies of each other; of rows that repeat a
    doc_id one stays; rows without a doc_id stay.
    """
    return one_of_each(docs, width=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without contamination by the benchmark; rows without a doc_id stay."""
    found = contamination(docs.select("doc_id", "text"), table(spark, sf_dir, "benchmark")).where("contaminated").select(F.col("doc_id").alias("_dirty")).distinct()
    return docs.join(found, F.col("doc_id") == F.col("_dirty"), "left_anti").select(docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each document that is left, with digests of the ids and of the text decoded from them; a null text has none."""
    return encoded(docs, read_vocabulary(queries.vocabulary_path()), ids_column="ids")


STAGES = [
    ("toxicity", toxicity),
    ("quality", quality),
    ("near_copies", near_copies),
    ("decontamination", decontamination),
    ("tokens", tokens),
]

#: Learned scores and exact tokenisation are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents; each result is written as Parquet and read again."""
    import uuid

    folder = f"{checkpoint_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
