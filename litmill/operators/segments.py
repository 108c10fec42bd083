"""A text index that keeps up with its files: counts in batches, one for each time that new files were found.

A batch holds, parted by term, how often each document of some files has a term,
and what the files add up to.  A file that was replaced or removed is dead: its
rows stay in their batch until batches are merged, and nothing counts them.
Scores are made when a query is asked, from the counts of its terms and the sums
over living files, so they equal those of an index made anew.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..session import checkpoint_folder
from .retrieval import B, BUCKETS, DELTA, FIELD_STOPS, FIELD_WEIGHTS, K1, dealt, field_counts, field_texts, part_of
from .textmine import by_text

#: Changes when what is stored does.
VERSION = 1


def folder_of(spark, name: str) -> str:
    """Where the batches of an index are; other stop words have another."""
    kind = zlib.crc32(repr((VERSION, FIELD_STOPS, BUCKETS)).encode())
    return f"{checkpoint_folder(spark)}/{name}-{kind:08x}"


def _file() -> Column:
    """The name of a row's file: its path, size and time, hashed."""
    return F.sha2(F.concat_ws("|", *(F.col(f"_metadata.file_{x}").cast("string") for x in ("path", "size", "modification_time"))).cast("binary"), 256).alias("file")


def files_of(table: DataFrame) -> DataFrame:
    """(file, path): the files of a table."""
    return table.select(_file(), F.col("_metadata.file_path").alias("path")).distinct()


def _stored(spark, folder: str, what: str, schema: str) -> DataFrame | None:
    try:
        return spark.read.schema(schema).parquet(f"{folder}/{what}")
    except AnalysisException:  # nothing there yet
        return None


def _judged(i: int, no: int, texts: list[dict]) -> Iterator[tuple]:
    for field, found in field_counts(texts).items():
        length = found.total()
        yield from ((term, i, field, tf, length, no) for term, tf in found.items())


_SUMS = "file string, field string, length long, docs long, batch string"
_ROWS = "term string, id long, field string, tf long, length long, file string, batch string, part int"


def kept_up(table: DataFrame, name: str, key: str, rows_of) -> tuple[str, DataFrame]:
    """The folder of the index and its living files, after the documents of new files have been counted.

    rows_of makes rows (id, field, text) of a part of the table; id is its
    column `key`, and belongs to one file.  Only files that no batch knows are read.  A batch
    counts from the moment that its sums are written, which is last.
    """
    spark = table.sparkSession
    folder = folder_of(spark, name)
    living = files_of(table)
    known = _stored(spark, folder, "sums", _SUMS)
    new = (living if known is None else living.join(known.select("file").distinct(), "file", "left_anti")).collect()  # a row for each new file
    if new:
        batch = uuid.uuid4().hex
        docs = spark.read.schema(table.schema).parquet(*[r["path"] for r in new])
        of = docs.select(F.col(key).cast("long").alias("id"), _file()).distinct()
        rows = rows_of(docs)
        lengths = rows.select("id", "field", F.size(F.filter(tokens(F.col("text")), lambda t: ~t.isin(*FIELD_STOPS))).alias("length")).where("length > 0").groupBy("id", "field").agg(F.sum("length").alias("length"))
        # A document's texts meet once and are counted there; its terms are shuffled once, with the number of its file.
        numbers = spark.createDataFrame([(k, r["file"]) for k, r in enumerate(new)], "_no int, file string")
        texts = field_texts(rows).join(of.join(F.broadcast(numbers), "file").select("id", "_no"), "id").select(F.col("id").cast("long").alias("id"), "_no", "texts")
        counted = by_text(texts, _judged, "term string, id bigint, field string, tf bigint, length bigint, _no int")
        words = lengths.agg(F.sum("length")).first()[0] or 0
        stored = dealt(counted, words).join(F.broadcast(numbers), "_no").select("term", "id", "field", "tf", "length", "file", "part")
        stored.sortWithinPartitions("part", "term").write.mode("overwrite").partitionBy("part").parquet(f"{folder}/rows/batch={batch}")
        # A file without words is known as well.
        here = spark.createDataFrame([(r["file"],) for r in new], "file string")
        whole = lengths.join(of, "id")
        docs_of = whole.groupBy("file").agg(F.countDistinct("id").alias("docs"))
        sums = here.join(whole.groupBy("file", "field").agg(F.sum("length").alias("length")), "file", "left").join(docs_of, "file", "left")
        sums.select("file", "field", F.coalesce("length", F.lit(0)).alias("length"), F.coalesce("docs", F.lit(0)).alias("docs")).write.mode("overwrite").parquet(f"{folder}/sums/batch={batch}")
    return folder, living.select("file")


def scored(folder: str, living: DataFrame, query: str, weights: dict[str, float] = FIELD_WEIGHTS) -> DataFrame:
    """(term, id, score) of BM25F+ of the query's terms over living files; only the parts of these terms are read."""
    spark = living.sparkSession
    terms = sorted({t for t in re.findall(r"[a-z][a-z0-9'-]+", query.lower()) if t not in FIELD_STOPS})
    sums = _stored(spark, folder, "sums", _SUMS)
    rows = _stored(spark, folder, "rows", _ROWS)
    if not terms or sums is None or rows is None:
        return spark.createDataFrame([], "term string, id long, score double")
    # Of a file that was counted twice at once one batch counts.
    batch = sums.join(living, "file").groupBy("file").agg(F.min("batch").alias("batch"))
    mine = sums.join(batch, ["file", "batch"])
    stats = mine.where("field is not null").groupBy("field").agg(F.sum("length").alias("total")).collect()  # a row for each field
    n = mine.select("file", "docs").distinct().agg(F.sum("docs")).first()[0] or 0
    mean = {r["field"]: (r["total"] / n) or 1.0 for r in stats}
    hits = rows.where(F.col("part").isin(sorted({part_of(t) for t in terms})) & F.col("term").isin(terms)).join(batch, ["file", "batch"])
    by_field = {name: F.create_map(*[F.lit(x) for f in weights for x in (f, float(values.get(f, 1.0)))])[F.col("field")] for name, values in (("mean", mean), ("weight", weights))}
    wtf = F.sum(by_field["weight"] * F.col("tf") / (1 - B + B * F.col("length") / by_field["mean"])).alias("wtf")
    by_doc = hits.groupBy("term", "id").agg(wtf)
    frequency = by_doc.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log((F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    return by_doc.join(frequency, "term").select("term", "id", ((F.col("wtf") * (K1 + 1) / (K1 + F.col("wtf")) + DELTA) * idf).alias("score"))
