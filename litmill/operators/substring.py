"""Finding texts that contain a pattern, without reading all of them.

An index has, parted by trigram, which texts contain each three letters in a
row, whatever the case, and how many texts do.  A pattern's rarest trigrams,
those of what stands between its wildcards, are met text by text; the texts that
have them all are then looked at themselves, so what is found is what a scan
finds.  Patterns without three letters in a row need the scan.
"""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint_folder
from .retrieval import BUCKETS, part_of, signature

#: Trigrams of a pattern that are met; its others are left to the look at the texts.
MET = 4
#: Changes when what is stored does.
VERSION = 1
#: Letters whose lower case depends on their neighbours or is longer, which no trigram has.
UNSTEADY = "Σσςİı̇"
#: No pattern has it: backslashes mean themselves.
_ESCAPE = "\x01"


def trigrams(text: Column) -> Column:
    """The different three letters in a row of a text in lower case."""
    low = F.lower(text)
    # A look ahead from each letter, as taking letters by their number starts from the first each time.
    found = F.regexp_extract_all(low, F.lit("(?s)(?=(...))"), F.lit(1))
    return F.array_distinct(F.filter(found, lambda g: ~g.rlike(f"[{UNSTEADY}]")))


def postings(texts: DataFrame) -> DataFrame:
    """(gram, id, part) of texts (id, text)."""
    return texts.where("text is not null").select("id", F.explode(trigrams(F.col("text"))).alias("gram")).withColumn("part", (F.crc32("gram") % BUCKETS).cast("int"))


class Index:
    def __init__(self, spark, folder: str):
        self.grams = spark.read.schema("gram string, id long, part int").parquet(f"{folder}/grams")
        self.counts = spark.read.schema("gram string, n long, part int").parquet(f"{folder}/counts")


def stored(name: str, table: DataFrame, texts: DataFrame) -> Index:
    """The index of texts (id, text), written once for each state of the table they come from."""
    spark = table.sparkSession
    folder = f"{checkpoint_folder(spark)}/{name}-v{VERSION}-{signature(table)}"
    try:
        return Index(spark, folder)
    except AnalysisException:  # not there yet
        # Parts of any size: adaptive execution cuts large ones, so a frequent trigram is no single task.
        postings(texts).hint("rebalance", "part").sortWithinPartitions("part", "gram", "id").write.mode("overwrite").partitionBy("part").parquet(f"{folder}/grams")
        grams = spark.read.schema("gram string, id long, part int").parquet(f"{folder}/grams")
        # Written last: an index without it is not whole.
        grams.groupBy("part", "gram").agg(F.count("*").alias("n")).repartition("part").sortWithinPartitions("part", "gram").write.mode("overwrite").partitionBy("part").parquet(f"{folder}/counts")
        return Index(spark, folder)


def wanted(pattern: str) -> list[str]:
    """The different trigrams that a text must have to contain the pattern."""
    low = pattern.lower()
    found = {piece[i : i + 3] for piece in re.split("[%_]", low) for i in range(len(piece) - 2)}
    return sorted(g for g in found if not set(g) & set(UNSTEADY))


def contains(text: Column, pattern: str) -> Column:
    """Whether a text contains the pattern, case aside; `%` stands for any letters, `_` for one."""
    return F.like(F.lower(text), F.lower(F.lit(f"%{pattern}%")), F.lit(_ESCAPE))


def candidates(index: Index, pattern: str) -> DataFrame | None:
    """(id): texts that have the pattern's rarest trigrams; None where it has no trigram."""
    grams = wanted(pattern)
    if not grams:
        return None
    parts = sorted({part_of(g) for g in grams})
    known = {r["gram"]: r["n"] for r in index.counts.where(F.col("part").isin(parts) & F.col("gram").isin(grams)).collect()}  # a row for each
    rarest = sorted(grams, key=lambda g: (known.get(g, 0), g))[:MET]
    met = index.grams.where(F.col("part").isin(sorted({part_of(g) for g in rarest})) & F.col("gram").isin(rarest))
    if len(rarest) == 1:
        return met.select("id")
    return met.groupBy("id").agg(F.countDistinct("gram").alias("n")).where(F.col("n") == len(rarest)).select("id")


def search(index: Index, texts: DataFrame, pattern: str) -> DataFrame:
    """The rows of texts (id, text, ...) that contain the pattern."""
    ids = candidates(index, pattern)
    rows = texts if ids is None else texts.join(ids, "id", "left_semi")
    return rows.where(contains(F.col("text"), pattern))
