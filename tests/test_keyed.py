"""Tables with a key: what a write reads and writes, what it leaves if it is lost."""

import pytest
from pyspark.sql import functions as F

from litmill.sources import keyed


def rows_of(df):
    return {tuple(r) for r in df.collect()}


def table(spark, n=2000):
    return spark.range(n).select(F.col("id").alias("a"), (F.col("id") * 7 % 50).alias("score"), F.lit("open").alias("status"))


def test_modes(spark, tmp_path):
    base = {i: (i, i * 7 % 50, "open") for i in range(50)}
    new = [(3, 99, None), (49, None, "done"), (70, 1, "new"), (None, 5, "lost"), (70, 2, "new")]
    fates = {
        "replace": {3: (3, 99, None), 49: (49, None, "done"), 70: (70, 2, "new")},
        "fill": {3: (3, 99, "open"), 49: (49, base[49][1], "done"), 70: (70, 2, "new")},
        "keep": {70: (70, 2, "new")},
    }
    for mode, fate in fates.items():
        folder = f"{tmp_path}/{mode}"
        keyed.create(table(spark, 50), folder, ["a"], 8)
        keyed.write(spark.createDataFrame(new, "a int, score int, status string"), folder, mode)
        got = keyed.read(spark, folder)
        assert rows_of(got) == set((base | fate).values()) and got.count() == len(base | fate), mode
        assert [f.dataType.simpleString() for f in got.schema] == ["bigint", "bigint", "string"]
        assert rows_of(keyed.read(spark, folder, 0)) == set(base.values())
    keyed.write(spark.createDataFrame([(3,), (800,)], "a long"), folder, "delete")
    assert rows_of(keyed.read(spark, folder).select("a")) == {(i,) for i in base.keys() | {70}} - {(3,)}


def test_rules_and_columns(spark, tmp_path):
    """The higher score stays, the status too; columns may be missing on either side, and two columns may be the key."""
    folder = f"{tmp_path}/t"
    keyed.create(spark.createDataFrame([(1, 2, 0.5, "dismissed"), (1, 3, 0.9, "open")], "a long, b long, score double, status string"), folder, ["a", "b"], 4)
    new = spark.createDataFrame([(1, 2, 0.8, "x"), (1, 3, 0.1, None), (2, 3, 0.7, "y")], "a long, b long, score double, reason string")
    keyed.write(new, folder, "fill", {"score": F.greatest})
    assert rows_of(keyed.read(spark, folder)) == {(1, 2, 0.8, "dismissed", "x"), (1, 3, 0.9, "open", None), (2, 3, 0.7, None, "y")}


def test_order_of_repeats(spark, tmp_path):
    rows = spark.createDataFrame([(1, "z", 1), (1, "a", 5), (2, "q", None), (2, "p", 0)], "a long, v string, at long")
    keyed.create(rows, f"{tmp_path}/t", ["a"], 4, order="at")
    assert rows_of(keyed.read(spark, f"{tmp_path}/t")) == {(1, "a", 5), (2, "p", 0)}


def test_only_touched_buckets_are_written(spark, tmp_path):
    folder = f"{tmp_path}/t"
    keyed.create(table(spark), folder, ["a"], 64)
    before = {f for f in keyed.read(spark, folder).inputFiles()}
    few = table(spark).where("a < 20").withColumn("score", F.lit(1000))
    hit = {r[0] for r in few.select(F.pmod(F.xxhash64("a"), F.lit(64))).collect()}
    assert keyed.write(few, folder) == len(hit) < 20
    after = {f for f in keyed.read(spark, folder).inputFiles()}
    gone = {int(f.split("_bucket=")[1].split("/")[0]) for f in before - after}
    assert gone == hit and len(before & after) == 64 - len(hit)
    assert rows_of(keyed.read(spark, folder)) == {(a, 1000 if a < 20 else s, t) for a, s, t in rows_of(table(spark))}


def test_a_lost_run_leaves_the_version_before(spark, tmp_path, monkeypatch):
    folder = f"{tmp_path}/t"
    keyed.create(table(spark, 100), folder, ["a"], 8)
    with monkeypatch.context() as m:
        m.setattr(keyed, "_switch", lambda *_: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            keyed.write(table(spark, 10).withColumn("score", F.lit(-1)), folder)
    assert rows_of(keyed.read(spark, folder)) == rows_of(table(spark, 100))
    keyed.write(table(spark, 10).withColumn("score", F.lit(-1)), folder)
    assert keyed.read(spark, folder).where("score = -1").count() == 10


def test_empty_tables_and_two_writers(spark, tmp_path):
    folder = f"{tmp_path}/t"
    with pytest.raises(FileNotFoundError):
        keyed.read(spark, folder)
    keyed.create(table(spark, 0), folder, ["a"], 4)
    assert keyed.read(spark, folder).count() == 0 and keyed.write(table(spark, 0), folder) == 0
    assert keyed.write(table(spark, 5), folder) > 0 and keyed.read(spark, folder).count() == 5
    assert keyed.write(table(spark, 5), folder, "delete") > 0 and keyed.read(spark, folder).count() == 0
    _, places, buckets, keys, schema = keyed._manifest(spark, folder, 1)
    for _ in range(2):
        keyed._switch(spark, folder, 7, places, buckets, keys, schema)
    with pytest.raises(RuntimeError):
        keyed.read(spark, folder)
