"""What a stream leaves lies in the checkpoint folder, not in the driver."""

import glob

from litmill.session import checkpoint_folder
from litmill.streaming import events as ev


def test_drained_writes_to_the_checkpoint_folder(spark, tables):
    top = checkpoint_folder(spark)
    for name, mode, rows in (("held_test", "update", ev.running(ev.stream(spark, tables, 1))), ("rates_folder_test", "complete", ev.rates(ev.stream(spark, tables, 1)))):
        got = ev.drained(rows, name, mode)
        assert got.inputFiles() and all(f.split("://")[-1].removeprefix("file:").startswith(top.removeprefix("file:")) for f in got.inputFiles())
        at = glob.glob(f"{top.removeprefix('file:')}/{name}-*/stream")
        assert len(at) == 1 and glob.glob(f"{at[0]}/offsets/*") and glob.glob(f"{at[0]}/state/*")
        assert name not in {t.name for t in spark.catalog.listTables()}


def test_drained_keeps_every_batch(spark, tmp_path):
    """Users and counts over several micro-batches, and the last complete result only."""
    for i in range(3):
        spark.createDataFrame([(i, u, "t", 1.0 + i) for u in range(i + 1)], "event_id long, user_id long, event_type string, value double").coalesce(1).write.mode("append").parquet(f"{tmp_path}/e")
    stream = lambda: spark.readStream.schema("event_id long, user_id long, event_type string, value double").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/e")
    held = ev.drained(ev.running(stream()), "batches", "update").groupBy("user_id").max("n").collect()
    assert {tuple(r) for r in held} == {(0, 3), (1, 2), (2, 1)}
    full = ev.drained(stream().groupBy("user_id").count(), "full").collect()
    assert {tuple(r) for r in full} == {(0, 3), (1, 2), (2, 1)} and len(full) == 3
