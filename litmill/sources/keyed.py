"""Tables with a key, of which a write changes only the buckets that its keys fall into.

Rows lie in `data`, by hash of their key in buckets that are each written anew
when one of their rows changes.  A manifest, one small file for each version,
names the folder of each bucket; it is written last and as a whole, so a run
that is lost before that leaves the version before it, and what it wrote is
never read.  A table has one writer at a time: two manifests of one version are
an error when it is read.  Old versions stay, and can be read.

Keys are unique and not null: rows with a null in their key are left out (as in
a table with a primary key), and of rows in one write with equal keys the
greatest by `order`, then by all columns, counts.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..session import cut

MANIFEST = "bucket int, folder string, buckets int, keys array<string>, schema string"
#: What becomes of a column of a known row, by mode.
RULES: dict[str, Callable[[Column, Column], Column]] = {"replace": lambda old, new: new, "fill": lambda old, new: F.coalesce(new, old), "keep": lambda old, new: old}


def _manifest(spark: SparkSession, folder: str, version: int | None = None):
    """(version, folder of each bucket, buckets, keys, schema): the newest version, or the given one."""
    try:
        every = spark.read.schema(MANIFEST + ", version long").parquet(f"{folder}/manifests")
        at = every.agg(F.max("version")).first()[0] if version is None else version
        rows = every.where(F.col("version") == at).collect()  # one for each bucket
    except AnalysisException:
        rows = []
    if not rows:
        raise FileNotFoundError(f"no such version of a table in {folder}")
    places = {r["bucket"]: r["folder"] for r in rows if r["bucket"] is not None}
    if len(places) < sum(r["bucket"] is not None for r in rows):
        raise RuntimeError(f"two writers made version {at} of {folder}")
    return at, places, rows[0]["buckets"], list(rows[0]["keys"]), StructType.fromJson(json.loads(rows[0]["schema"]))


def _switch(spark: SparkSession, folder: str, version: int, places: dict[int, str], buckets: int, keys: list[str], schema: StructType) -> None:
    """Write a manifest: a single file, which is there as a whole or not at all."""
    rows = [(b, p, buckets, keys, schema.json(), version) for b, p in sorted(places.items())] or [(None, None, buckets, keys, schema.json(), version)]
    spark.createDataFrame(rows, MANIFEST + ", version long").coalesce(1).write.partitionBy("version").mode("append").parquet(f"{folder}/manifests")


def _single(rows: DataFrame, keys: list[str], order: str | None, buckets: int) -> DataFrame:
    """Rows of one key as one, with their bucket."""
    known = rows.where(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys]))
    rest = [c for c in rows.columns if c not in keys]
    first = [F.col(order).alias("_first")] if order else []
    # A null never beats a value: the greatest of structs puts nulls first.
    best = known.groupBy(*keys).agg(F.max(F.struct(*first, *rest) if first or rest else F.lit(True)).alias("_row"))
    return best.select(*keys, *[F.col("_row")[c].alias(c) for c in rest], F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int").alias("_bucket")).select(*rows.columns, "_bucket")


def _put(rows: DataFrame, folder: str, buckets: int) -> dict[int, str]:
    """Write rows by bucket; the folder of each bucket that has rows."""
    place = f"{folder}/data/{uuid.uuid4().hex}"
    rows.repartition(buckets, "_bucket").write.partitionBy("_bucket").parquet(place)
    there = rows.sparkSession.read.schema("_bucket int").parquet(place).select("_bucket").distinct().collect()  # as many as buckets
    return {r[0]: f"{place}/_bucket={r[0]}" for r in there}


def create(rows: DataFrame, folder: str, keys: list[str], buckets: int = 64, order: str | None = None) -> None:
    """A new table, or a new first state of one: all its rows are replaced."""
    spark = rows.sparkSession
    try:
        version = _manifest(spark, folder)[0] + 1
    except FileNotFoundError:
        version = 0
    _switch(spark, folder, version, _put(_single(rows, keys, order, buckets), folder, buckets), buckets, keys, rows.schema)


def _read(spark: SparkSession, places: dict[int, str], schema: StructType) -> DataFrame:
    return spark.read.schema(schema).parquet(*places.values()) if places else spark.createDataFrame([], schema)


def read(spark: SparkSession, folder: str, version: int | None = None) -> DataFrame:
    """The rows of the newest version, or of the given one."""
    _, places, _, _, schema = _manifest(spark, folder, version)
    return _read(spark, places, schema)


def write(changes: DataFrame, folder: str, mode: str = "replace", rules: dict[str, Callable[[Column, Column], Column]] | None = None, order: str | None = None) -> int:
    """Bring changes into a table; the number of buckets written.

    New keys are added.  Of known ones `replace` takes the new row, `fill` its
    values where they are not null, `keep` the old row, and `delete` takes the
    row away (new keys are then ignored); `rules` give a column a rule of its
    own, of its old and new value.  Columns may be missing on either side:
    they are null there, and a missing new one leaves the old value.
    """
    spark = changes.sparkSession
    version, places, buckets, keys, schema = _manifest(spark, folder)
    changes = changes.select(*[F.col(f"`{f.name}`").cast(schema[f.name].dataType).alias(f.name) if f.name in schema.names else F.col(f"`{f.name}`") for f in changes.schema])
    new = cut(_single(changes, keys, order, buckets))
    touched = {r[0] for r in new.select("_bucket").distinct().collect()}  # as many as buckets
    if mode == "delete":
        touched &= set(places)
    if not touched:
        return 0
    wide = schema if mode == "delete" else StructType([*schema, *(StructField(f.name, f.dataType) for f in changes.schema if f.name not in schema.names)])
    old = _read(spark, {b: p for b, p in places.items() if b in touched}, wide)
    if mode == "delete":
        merged = old.join(new.select(*keys), keys, "left_anti")
    else:
        o = old.select(*keys, F.struct(*old.columns).alias("_old"))
        n = new.select(*keys, F.struct(*changes.columns).alias("_new"))
        usual, own = RULES[mode], rules or {}

        def value(name: str) -> Column:
            if name not in changes.columns:
                return F.col("_old")[name]
            was, now = F.col("_old")[name], F.col("_new")[name]
            met = own.get(name, usual)(was, now)
            return F.when(F.col("_old").isNull(), now).when(F.col("_new").isNull(), was).otherwise(met)

        merged = o.join(n, keys, "full").select(*keys, *[value(f.name).alias(f.name) for f in wide if f.name not in keys]).select(*wide.names)
    merged = merged.withColumn("_bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
    written = _put(merged, folder, buckets)
    _switch(spark, folder, version + 1, {b: p for b, p in places.items() if b not in touched} | written, buckets, keys, wide)
    return len(touched)
