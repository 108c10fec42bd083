"""Limits on requests and failures: who is turned away, and for how long.

Each function takes events (event_id, ts, user_id, event_type).  Rows without
a time or a user are left out; of repeated rows each counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

SCHEMA = "user_id long, us long, kind string, event_id long, n long, locked boolean, retry_after long"


def _numbered(rows: DataFrame, keys: list[str], counts: Column, name: str) -> DataFrame:
    """rows with how many up to each of them count, within keys, in order of time and event_id.

    Tenths of a second are numbered by themselves, from what came before them,
    so no task has to go through a whole minute of a busy client.
    """
    spot = [*keys, "_slice"]
    rows = rows.withColumn("_counts", counts.cast("long"))
    before = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1))
    slices = rows.groupBy(*spot).agg(F.sum("_counts").alias("_n")).select(*spot, F.coalesce(before, F.lit(0)).alias("_before"))
    within = F.sum("_counts").over(Window.partitionBy(*spot).orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0))
    return rows.join(slices, spot).withColumn(name, F.col("_before") + within).drop("_counts", "_before")


def limited(events: DataFrame, each: int, overall: int) -> DataFrame:
    """(event_id, user_id, ts, scope, retry_after): requests beyond `each` of a user or `overall` of all in a minute.

    Requests count in order of time and event_id.  Those turned away for
    their user do not count overall.  `retry_after` is in seconds, to the end of the minute.
    """
    ts = F.col("ts").cast("timestamp")
    rows = events.where("ts IS NOT NULL AND user_id IS NOT NULL").select("event_id", "user_id", "ts", F.date_trunc("minute", ts).alias("_minute"), F.floor(F.unix_micros(ts) / 100_000).alias("_slice"))
    rows = _numbered(rows, ["_minute", "user_id"], F.lit(1), "_own")
    rows = _numbered(rows, ["_minute"], F.col("_own") <= each, "_all")
    scope = F.when(F.col("_own") > each, "client").when(F.col("_all") > overall, "global")
    left = F.greatest(F.lit(1), 60 - F.second("ts")).cast("long")
    return rows.withColumn("scope", scope).where("scope IS NOT NULL").select("event_id", "user_id", "ts", "scope", left.alias("retry_after"))


class _Window(StatefulProcessor):
    """The failures of a user in a window; events wait until the watermark has passed them, so their order of arrival is of no account."""

    def __init__(self, most: int, span: int) -> None:
        self.most, self.span = most, span

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "us long, event_id long, clears boolean")
        self.recent = handle.getListState("recent", "us long")

    def _wake(self, at: int | None) -> None:
        """One timer a user, at the time (microseconds) of what happens next."""
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        if at is not None:
            self.handle.registerTimer(at // 1000 + 1)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        new = [(int(u), int(e), bool(c)) for part in rows for u, e, c in zip(part["us"], part["event_id"], part["clears"]) if u >= passed]
        if new:
            self.waiting.appendList(new)
            ends = [r[0] + self.span for r in self.recent.get()]
            self._wake(min([*(r[0] for r in self.waiting.get()), *ends]))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = sorted(tuple(r) for r in self.waiting.get())
        due, later = [r for r in waiting if r[0] < now], [r for r in waiting if r[0] >= now]
        recent, out = [r[0] for r in self.recent.get()], []

        def expire(upto: int) -> None:
            while recent and recent[0] + self.span <= upto:
                end = recent.pop(0) + self.span
                if len(recent) == self.most - 1:
                    out.append((key[0], end, "unlocked", None, len(recent), False, 0))

        for us, group in groupby(due, lambda r: r[0]):
            expire(us)
            group = list(group)
            recent.extend(us for r in group if not r[2])
            n = len(recent)
            wait = max(1, (recent[0] + self.span - us) // 1_000_000) if n >= self.most else 0
            out.extend((key[0], us, "failure", r[1], n, n >= self.most, wait) for r in group if not r[2])
            clears = [r[1] for r in group if r[2]]
            if clears:
                if n >= self.most:
                    out.append((key[0], us, "unlocked", min(clears), 0, False, 0))
                recent.clear()
        expire(now - 1)
        for state, rows in ((self.waiting, later), (self.recent, [(u,) for u in recent])):
            if rows:
                state.put(rows)
            else:
                state.clear()
        self._wake(min([*(r[0] for r in later), *(u + self.span for u in recent)], default=None))
        frame = pd.DataFrame(out, columns=["user_id", "us", "kind", "event_id", "n", "locked", "retry_after"])
        yield frame.astype({"event_id": "Int64", "locked": "bool"})


def throttled(events: DataFrame, most: int, minutes: int, failure: str = "error", clears: str | None = None, late: str = "10 minutes") -> DataFrame:
    """(user_id, ts, kind, event_id, n, locked, retry_after): each failure with those of its user in the last `minutes`, and each end of a lock.

    A user is locked from `most` failures in the window on; `retry_after` is
    the seconds until the oldest of them leaves it.  A lock ends (`unlocked`)
    when fewer than `most` are left, or with an event of type `clears`
    (then with its event_id), which forgets the failures before it.  Failures
    of one time count together, before an event that clears at that time.

    A stream puts a row out once the watermark has passed its time, ends of
    locks by a timer, so it gives the rows of the batch up to the watermark;
    later events are dropped.  A user's state is the failures of one window
    and the events ahead of the watermark, and nothing once the window has
    passed.  The stream's session needs the settings `events.ROCKS`.
    """
    kinds = [failure, *([clears] if clears else [])]
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if events.isStreaming:
        rows = rows.withWatermark("ts", late)
    # A comparison with ts stays above the watermark, which all events are to move, not only those of these types.
    counted = F.unix_micros("ts") > F.when(F.col("event_type").isin(kinds) & F.col("user_id").isNotNull(), -(1 << 62)).otherwise(1 << 62)
    rows = rows.where(counted)
    rows = rows.select("user_id", "ts", F.unix_micros("ts").alias("us"), "event_id", (F.col("event_type") != failure).alias("clears"))
    span = minutes * 60_000_000
    if events.isStreaming:
        out = rows.groupBy("user_id").transformWithStateInPandas(_Window(most, span), SCHEMA, "Append", "EventTime")
    else:
        out = _rows(rows, most, span)
    return out.select("user_id", F.timestamp_micros("us").alias("ts"), "kind", "event_id", "n", "locked", "retry_after")


def _rows(rows: DataFrame, most: int, span: int) -> DataFrame:
    """The same of a batch, by windows over each user's events."""
    user = Window.partitionBy("user_id").orderBy("us")
    # Events between two that clear are a spell; one that clears ends its spell.
    rows = rows.withColumn("_spell", F.coalesce(F.sum(F.col("clears").cast("long")).over(user.rangeBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    spell = Window.partitionBy("user_id", "_spell")
    recent = spell.orderBy("us").rangeBetween(-(span - 1), 0)
    fails = F.when(~F.col("clears"), F.col("us"))
    rows = rows.withColumns({"n": F.count(fails).over(recent), "_oldest": F.min(fails).over(recent), "_cleared": F.min(F.when(F.col("clears"), F.col("us"))).over(spell)})
    locked = F.col("n") >= most
    left = F.greatest(F.lit(1), F.floor((F.col("_oldest") + span - F.col("us")) / 1_000_000)).cast("long")
    failed = rows.where("NOT clears").select("user_id", "us", F.lit("failure").alias("kind"), "event_id", "n", locked.alias("locked"), F.when(locked, left).otherwise(0).cast("long").alias("retry_after"))
    no_more = [F.lit(False).alias("locked"), F.lit(0).cast("long").alias("retry_after")]
    freed = rows.where(F.col("clears") & locked).groupBy("user_id", "us").agg(F.min("event_id").alias("event_id"))
    freed = freed.select("user_id", "us", F.lit("unlocked").alias("kind"), "event_id", F.lit(0).cast("long").alias("n"), *no_more)
    # With a failure's end just `most` - 1 are left if that many follow before it, and no more.
    follow = spell.orderBy("us", "event_id")
    ends = rows.where("NOT clears").withColumns({"_last": F.lead("us", most - 1).over(follow) if most > 1 else F.col("us"), "_next": F.lead("us", most).over(follow)})
    end = F.col("us") + span
    ended = ends.where((F.col("_last") < end) & F.coalesce(F.col("_next") >= end, F.lit(True)) & F.coalesce(F.col("_cleared") >= end, F.lit(True)))
    ended = ended.select("user_id", end.alias("us"), F.lit("unlocked").alias("kind"), F.lit(None).cast("long").alias("event_id"), F.lit(most - 1).cast("long").alias("n"), *no_more)
    return failed.unionAll(freed).unionAll(ended)
