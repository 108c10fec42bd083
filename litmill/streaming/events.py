"""Monitoring of event streams: rates, failures, sessions, newest values.

Each function takes a batch or a streaming DataFrame of events (event_id, ts,
user_id, event_type, value); on a stream, late events are dropped by watermark.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..session import checkpoint_folder

LATE = "10 minutes"
#: State that transformWithState keeps needs this setting.
ROCKS = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def stream(spark: SparkSession, folder: str, per_trigger: int = 8) -> DataFrame:
    """The events table of a folder as a stream of files; times become timestamps, which watermarks need."""
    schema = spark.read.parquet(f"{folder}/events.parquet").schema
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).option("pathGlobFilter", "*").parquet(f"{folder}/events.parquet*")
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def _timed(events: DataFrame) -> DataFrame:
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return events.withWatermark("ts", LATE) if events.isStreaming else events


def rates(events: DataFrame, length: str = "1 hour") -> DataFrame:
    """Requests and different types in fixed windows."""
    w = _timed(events).groupBy(F.window("ts", length).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return w.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def over_limit(events: DataFrame, limit: int, length: str = "1 day") -> DataFrame:
    """Users with more events than allowed in a fixed window."""
    w = _timed(events).groupBy(F.window("ts", length).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return w.where(F.col("n") > limit).select(F.col("w.start").alias("start"), "user_id", "n")


def failures(events: DataFrame, limit: int, length: str = "6 hours", step: str = "1 hour") -> DataFrame:
    """Users with at least `limit` errors in a sliding window."""
    w = _timed(events).where("event_type = 'error'").groupBy(F.window("ts", length, step).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return w.where(F.col("n") >= limit).select(F.col("w.start").alias("start"), "user_id", "n")


def sessions(events: DataFrame, gap: str = "8 hours") -> DataFrame:
    """Sessions of each user: events no further apart than the gap."""
    w = _timed(events).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return w.select("user_id", F.col("w.start").alias("start"), "n")


def newest(events: DataFrame) -> DataFrame:
    """The newest value of each (user, type), as a manifest is kept up to date."""
    return events.groupBy("user_id", "event_type").agg(F.max_by("value", F.struct("ts", "event_id")).alias("value"), F.max("ts").alias("ts"))


def _held(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    count, seen = state.get if state.exists else (0, 0.0)
    for rows in batches:
        count += len(rows)
        seen = max(seen, float(rows["value"].max()))
    state.update((count, seen))
    yield pd.DataFrame({"user_id": [key[0]], "n": [count], "peak": [seen]})


def running(events: DataFrame) -> DataFrame:
    """Count and peak of each user so far, kept in state from batch to batch."""
    return events.groupBy("user_id").applyInPandasWithState(_held, "user_id long, n long, peak double", "n long, peak double", "update", GroupStateTimeout.NoTimeout)


def drained(rows: DataFrame, name: str, mode: str = "complete", settings: dict[str, str] | None = None) -> DataFrame:
    """Run a stream over all that is there now; its result as a table.

    Result, offsets and state lie in the checkpoint folder.  A complete result
    replaces the one before it (two are kept in turn), else each micro-batch adds its rows.
    `settings` hold in the session while the stream starts, which keeps them.
    """
    spark = rows.sparkSession
    folder = f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"
    places = []

    def put(batch: DataFrame, number: int) -> None:
        # A batch that is run again writes over itself.
        place = f"{folder}/rows/{number % 2 if mode == 'complete' else number}"
        batch.write.mode("overwrite").parquet(place)
        places[:] = [place if mode == "complete" else f"{folder}/rows/*"]

    before = {k: spark.conf.get(k, None) for k in settings or {}}
    try:
        for k, v in (settings or {}).items():
            spark.conf.set(k, v)
        query = rows.writeStream.foreachBatch(put).outputMode(mode).option("checkpointLocation", f"{folder}/stream").trigger(availableNow=True).start()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    query.awaitTermination()
    return spark.read.schema(rows.schema).parquet(*places) if places else spark.createDataFrame([], rows.schema)


def locked(events: DataFrame, most: int, length: str = "INTERVAL '6' HOUR") -> DataFrame:
    """Failures with how many their user had within `length` before, and whether that locks them out."""
    rows = events.where("event_type = 'error'").select("event_id", "user_id", "ts")
    n = F.expr(f"count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN {length} PRECEDING AND CURRENT ROW)")
    return rows.withColumn("n", n).withColumn("locked", F.col("n") >= most)


def coalesced(jobs: DataFrame, keys: list[str]) -> DataFrame:
    """One live job for each key: the first wins.  On a stream, within the watermark."""
    if jobs.isStreaming:
        return _timed(jobs).dropDuplicatesWithinWatermark(keys)
    return jobs.groupBy(*keys).agg(F.min_by(F.struct("event_id", "ts"), F.struct("ts", "event_id")).alias("first")).select(*keys, "first.*")


def completed(started: DataFrame, finished: DataFrame, within: str = "INTERVAL 1 DAY") -> DataFrame:
    """Starts joined with what finished for the same user within a time; works on two streams with watermarks."""
    a = _timed(started).select(F.col("user_id"), F.col("event_id").alias("start_id"), F.col("ts").alias("started"))
    b = _timed(finished).select(F.col("user_id").alias("_user"), F.col("event_id").alias("end_id"), F.col("ts").alias("ended"))
    return a.join(b, F.expr(f"user_id = _user AND ended >= started AND ended <= started + {within}")).drop("_user")


def scan_changes(before: DataFrame, now: DataFrame) -> DataFrame:
    """(path, change): files that are new, changed or missing against the last scan, by size and time."""
    a, b = before.alias("a"), now.alias("b")
    both = a.join(b, F.col("a.path") == F.col("b.path"), "full")
    same = (F.col("a.size") == F.col("b.size")) & (F.col("a.mtime") == F.col("b.mtime"))
    change = F.when(F.col("a.path").isNull(), "new").when(F.col("b.path").isNull(), "missing").when(same, "same").otherwise("changed")
    return both.select(F.coalesce("a.path", "b.path").alias("path"), change.alias("change")).where("change <> 'same'")


class _Stages(StatefulProcessor):
    """Which of the needed types a user has had, as one small value of state."""

    def __init__(self, needed: list[str]) -> None:
        self.needed = needed

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.had = handle.getValueState("had", "bits long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        full = (1 << len(self.needed)) - 1
        before = self.had.get()[0] if self.had.exists() else 0
        counts: Counter = Counter()
        for part in rows:
            counts.update(part["event_type"])
        bits = before
        for kind in counts:
            bits |= 1 << self.needed.index(kind)
        if bits != before:
            self.had.update((bits,))
        if bits == full != before:
            counts["joined"] = 1
        yield pd.DataFrame({"user_id": key[0], "stage": list(counts), "n": list(counts.values())})


def staged(spark: SparkSession, folder: str, needed: tuple[str, ...] = ("click", "view")) -> DataFrame:
    """(stage, n): events of each needed type, and users joined: each once, when they first have all types.

    What is due comes from a user's state, so a batch reads its own rows only,
    and one that is run again does nothing twice.  A user's state is one number, which is kept.
    """
    rows = stream(spark, folder).where(F.col("event_type").isin(*needed) & F.col("user_id").isNotNull()).select("user_id", "event_type")
    out = rows.groupBy("user_id").transformWithStateInPandas(_Stages(list(needed)), "user_id long, stage string, n long", "Append", "None")
    return drained(out, "stages", "append", ROCKS).groupBy("stage").agg(F.sum("n").alias("n"))
