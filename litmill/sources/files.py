"""Bibliography files of any size: RIS, BibTeX and CSL-JSON, read in ranges of bytes by many tasks.

RIS and BibTeX records begin with a mark at the start of a line, so Spark's text
source can cut there: a range reads the records that begin in it, once, over its
end if need be.  JSON has no such mark: text is cut behind every `}`, each range
says for both cases, that it begins inside a string or not, how deep it leads,
and with these few numbers every range knows where its records begin.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bibliography


def _cut(spark: SparkSession, path, mark: str) -> DataFrame:
    """(file, text): what stands between marks, with the mark before it."""
    rows = spark.read.option("lineSep", "\n" + mark).text(path).select(F.col("_metadata.file_path").alias("file"), F.regexp_replace("value", r"^\x{FEFF}", "").alias("text"))
    # Only what a file begins with can still have its own mark.
    return rows.withColumn("text", F.when(F.ltrim("text").startswith(mark.strip()), F.ltrim("text")).otherwise(F.concat(F.lit(mark), "text")))


def read_ris_files(spark: SparkSession, path) -> DataFrame:
    """`read_ris` of whole files, with the file of each record."""
    return bibliography.read_ris(_cut(spark, path, "TY  - ")).drop("pos")


def read_bibtex_files(spark: SparkSession, path) -> DataFrame:
    """`read_bibtex` of whole files, with the file of each entry."""
    return bibliography.read_bibtex(_cut(spark, path, "@")).drop("pos")


def read_csl_files(spark: SparkSession, path) -> DataFrame:
    """`read_csl` of whole files, with the file of each item: arrays, single objects, or objects one after another."""
    return bibliography.read_csl(json_objects(spark, path))


#: What matters in JSON text: braces, quotes, and what a backslash protects.
_SIGNS = re.compile(r'[{}"]|\\.', re.DOTALL)


def _pieces(batches):
    """(file, start, texts) of each range, in order, each text with the brace that it was cut behind."""
    at, texts = None, []
    for batch in batches:
        for file, start, text in zip(*(batch.column(c).to_pylist() for c in ("file", "start", "text")), strict=True):
            if at is not None and at != (file, start):
                yield *at, texts
                texts = []
            at = file, start
            texts.append(text + "}")
    if at is not None:
        yield *at, texts


def _depths(texts, quoted: bool):
    """(depth, start of a `{` or end of a `}`, text) at each brace outside strings, then whether a string is open at last."""
    depth = 0
    for k, text in enumerate(texts):
        for sign in _SIGNS.finditer(text):
            s = sign[0]
            if s == '"':
                quoted = not quoted
            elif not quoted and s in "{}":
                depth += 1 if s == "{" else -1
                yield depth, k, sign.start() if s == "{" else sign.end()
    yield None, quoted, None


def _led(batches):
    """For each range, and for both ways that it may begin: whether it ends inside a string, its change of depth, and its least depth."""
    out: list[list] = [[], [], [], [], [], []]
    for file, start, texts in _pieces(batches):
        for quoted in (False, True):
            depth = least = 0
            for d, k, _ in _depths(texts, quoted):
                if d is None:
                    ends = k
                else:
                    depth, least = d, min(least, d)
            for column, value in zip(out, (file, start, quoted, ends, depth, least), strict=True):
                column.append(value)
    yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(out, (pa.string(), pa.int64(), pa.bool_(), pa.bool_(), pa.int64(), pa.int64()), strict=True)], names=["file", "start", "quoted", "ends", "depth", "least"])


def _begun(ranges) -> dict[tuple[str, int], tuple[bool, int, int]]:
    """For each range how it begins: inside a string or not, how deep, and the range in which the object that is open began."""
    known = {(r["file"], r["start"], r["quoted"]): r for r in ranges}
    out = {}
    quoted, depth, owner, last = False, 0, 0, None
    for file, start in sorted({k[:2] for k in known}):
        if file != last:
            quoted, depth, owner, last = False, 0, start, file
        out[file, start] = quoted, depth, owner
        r = known[file, start, quoted]
        if depth + r["least"] <= 0:
            owner = start
        quoted, depth = r["ends"], max(0, depth + r["depth"])
    return out


def _objects(begun):
    """Ranges to whole objects, and to the parts of those that lie in several ranges."""

    def run(batches):
        for file, start, texts in _pieces(batches):
            quoted, lead, owner = begun.value[file, start]
            rows: list[tuple] = []
            depth, since = lead, (0, 0) if lead else None
            for d, k, at in _depths(texts, quoted):
                if d is None:
                    break
                before, depth = depth, max(0, lead + d)
                if before == 0 and depth == 1:
                    since, owner = (k, at), None
                elif before == 1 and depth == 0:
                    rows.append((file, owner, start, "".join([*texts[since[0] : k], texts[k][:at]])[since[1] :]))
                    since = None
                if lead + d < 0:
                    lead -= lead + d
            if since is not None:
                rows.append((file, start if owner is None else owner, start, "".join(texts[since[0] :])[since[1] :]))
            for lo in range(0, len(rows), 4096):
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows[lo : lo + 4096], strict=True), (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["file", "owner", "start", "text"])

    return run


def json_objects(spark: SparkSession, path) -> DataFrame:
    """(file, text) of the outermost objects of JSON files.  The driver sees two rows of numbers for each range of bytes."""
    cut = spark.read.option("lineSep", "}").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("value").alias("text"))
    ranges = cut.mapInArrow(_led, "file string, start long, quoted boolean, ends boolean, depth long, least long").collect()
    begun = spark.sparkContext.broadcast(_begun(ranges))
    found = cut.mapInArrow(_objects(begun), "file string, owner long, start long, text string")
    # An object in several ranges: its parts, in order; where the brace of a file's end was none, it closes nothing.
    parts = found.where(F.col("owner").isNotNull()).groupBy("file", "owner").agg(F.array_sort(F.collect_list(F.struct("start", "text"))).alias("parts"))
    return found.where(F.col("owner").isNull()).select("file", "text").unionAll(parts.select("file", F.array_join(F.transform("parts", lambda p: p["text"]), "").alias("text")))
