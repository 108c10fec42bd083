"""Limits by a plain restatement, event by event; streams against batches."""

import random
from collections import Counter
from datetime import datetime, timedelta, timezone

import pytest

from litmill.streaming import events as ev
from litmill.streaming import throttle

START = datetime(2024, 1, 1)
SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string"


def made(n=400, seed=5):
    rng = random.Random(seed)
    rows = [(i, START + timedelta(seconds=rng.randrange(0, 7200), milliseconds=rng.randrange(3) * 250), rng.choice([1, 1, 1, 2, 3]), rng.choice(["error", "error", "error", "ok", "view"])) for i in range(n)]
    return rows + [(n, rows[0][1], 1, "error"), (n + 1, rows[0][1], 1, "ok"), (n + 2, None, 1, "error"), (n + 3, START, None, "error")]


def plain(rows, most, minutes):
    """Failures are kept in a list that is looked at whenever something happens."""
    span, out = timedelta(minutes=minutes), set()
    for user in {r[2] for r in rows if r[2] is not None}:
        mine = [r for r in rows if r[2] == user and r[1] is not None and r[3] in ("error", "ok")]
        kept = []
        moments = sorted({r[1] for r in mine} | {r[1] + span for r in mine if r[3] == "error"})
        for now in moments:
            was = len(kept)
            kept = [t for t in kept if t > now - span]
            if was >= most > len(kept):
                out.add((user, now, "unlocked", None, len(kept), False, 0))
            failed = [r for r in mine if r[1] == now and r[3] == "error"]
            kept += [now] * len(failed)
            locked = len(kept) >= most
            wait = max(1, int((kept[0] + span - now).total_seconds())) if locked else 0
            out |= {(user, now, "failure", r[0], len(kept), locked, wait) for r in failed}
            cleared = [r[0] for r in mine if r[1] == now and r[3] == "ok"]
            if cleared:
                if locked:
                    out.add((user, now, "unlocked", min(cleared), 0, False, 0))
                kept = []
    return out


def rows_of(df):
    return [(r.user_id, r.ts.replace(tzinfo=None), r.kind, r.event_id, r.n, r.locked, r.retry_after) for r in df.selectExpr("user_id", "cast(ts as timestamp_ntz) ts", "kind", "event_id", "n", "locked", "retry_after").collect()]


@pytest.mark.parametrize("most", [1, 2, 4])
def test_batch(spark, most):
    rows = made()
    got = rows_of(throttle.throttled(spark.createDataFrame(rows, SCHEMA), most, 4, clears="ok"))
    want = plain(rows, most, 4)
    # With several failures at one time a lock may end at once by more than one of them.
    assert {r for r in got if r[2] == "failure"} == {r for r in want if r[2] == "failure"}
    assert {(r[:2], r[3]) for r in got if r[2] == "unlocked"} == {(r[:2], r[3]) for r in want if r[2] == "unlocked"}
    assert len(got) == len(set(got)) and {r[2] for r in got} == {"failure", "unlocked"}


def test_empty(spark):
    assert throttle.throttled(spark.createDataFrame([], SCHEMA), 2, 4).collect() == []
    assert throttle.limited(spark.createDataFrame([], SCHEMA), 2, 4).collect() == []


def test_stream_equals_batch_and_forgets(spark, tmp_path):
    """Batches in order of time with rows out of order within the lateness; state is gone after the window."""
    rows = sorted((r for r in made() if r[1] is not None), key=lambda r: r[1])
    rng = random.Random(1)
    batches = [rows[i : i + 80] for i in range(0, len(rows), 80)]
    late = [[r for r in a if a[-1][1] - r[1] < timedelta(minutes=5) and rng.random() < 0.3] for a in batches]
    late[-1] = []
    # Some rows of each batch come with the next.
    batches = [[r for r in a if r not in out] + come for a, out, come in zip(batches, late, [[], *late])]
    end = START + timedelta(days=1)
    batches.append([(9000, end, 9, "view")])
    batches.append([(9001, end + timedelta(hours=1), 9, "view")])
    for i, batch in enumerate(batches):
        rng.shuffle(batch)
        spark.createDataFrame(batch, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/e/{i}")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/e")
    spark.conf.set(*next(iter(ev.ROCKS.items())))
    try:
        query = throttle.throttled(stream, 3, 4, clears="ok").writeStream.format("memory").queryName("throttle_test").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.unset(next(iter(ev.ROCKS)))
    got = rows_of(spark.table("throttle_test"))
    assert Counter(got) == Counter(rows_of(throttle.throttled(spark.createDataFrame(rows, SCHEMA), 3, 4, clears="ok"))) and len(got) > 100
    state = query.lastProgress["stateOperators"][0]
    assert state["numRowsTotal"] == 0


def test_limited(spark):
    rows = [r for r in made(600, 8) if r[1] is not None and r[2] is not None]
    want, own, all_ = set(), Counter(), Counter()
    for i, ts, user, _ in sorted(rows, key=lambda r: (r[1], r[0])):
        minute = ts.replace(second=0, microsecond=0)
        own[minute, user] += 1
        scope = "client" if own[minute, user] > 3 else None
        if scope is None:
            all_[minute] += 1
            scope = "global" if all_[minute] > 4 else None
        if scope:
            want.add((i, scope, max(1, 60 - int(ts.replace(tzinfo=timezone.utc).timestamp() % 60))))
    got = throttle.limited(spark.createDataFrame(rows, SCHEMA), 3, 4).collect()
    assert {(r.event_id, r.scope, r.retry_after) for r in got} == want and len(got) == len(want)
    assert {s for _, s, _ in want} == {"client", "global"}
