"""Session settings that the plans of this library rely on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def session(name: str = "litmill", **conf: str) -> SparkSession:
    """A session with adaptive execution and UTC; give a master in `conf` or by spark-submit."""
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder of checkpoints: a new one in spark.checkpoint.dir; where that is unset, in the warehouse."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints")
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Compute df once into the checkpoint folder (that of spark.checkpoint.dir) and go on from there."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


#: Rows of a part of work that is costly for each row, and of one whose rows a task must hold.
COSTLY, HELD = 2_000, 500_000


def spread(rows: DataFrame, *keys: str, most: int = HELD, count: int | None = None) -> DataFrame:
    """rows dealt out in parts of about `most` rows, so that a task's share does not grow with the input; by keys, if given.

    A table of few large files or row groups comes in as few tasks, whatever its number of rows.
    """
    n = rows.count() if count is None else count
    return rows.repartition(max(1, -(-n // most)), *keys)
