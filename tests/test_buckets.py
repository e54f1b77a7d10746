"""A bucketed table reads and writes the buckets that a change touches, and no others."""

import tempfile
from pathlib import Path

from strideframe.sources.buckets import BucketedTable


def files(path):
    return {p for p in Path(path).glob("bucket=*/*.parquet")}


def table(spark, n=200, **more):
    rows = spark.range(n).selectExpr("id AS key", "id * 10 AS v")
    return BucketedTable(tempfile.mkdtemp(prefix="spark-") + "/t", ("key",), 16, **more).write(rows)


def content(spark, t):
    return {r.key: r.v for r in t.read(spark).collect()}


def test_only_touched_buckets_change(spark):
    t = table(spark)
    before = files(t.path)
    keys = spark.createDataFrame([(3,), (3,), (77,)], "key long")
    buckets = t.refresh(keys, spark.createDataFrame([(3, -1), (50, -2)], "key long, v long"))
    after = files(t.path)
    assert 1 <= len(buckets) <= 2
    changed = {p.parent.name for p in before ^ after}
    assert changed == {f"bucket={b}" for b in buckets}
    # 77 has no fresh row and stays, 50 is no key of the change.
    assert content(spark, t) == {k: -1 if k == 3 else k * 10 for k in range(200)}
    plan = t.read(spark, buckets)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan


def test_removed_keys_stay_out_and_can_return(spark):
    t = table(spark, 40)
    every = spark.range(40).selectExpr("id AS key")
    none = spark.createDataFrame([], "key long, v long")
    t.refresh(every.where("key != 7"), none, remove=True)
    assert content(spark, t) == {7: 70}
    t.refresh(every, none, remove=True)
    assert content(spark, t) == {}
    again = spark.createDataFrame([(5, 1), (99, 2)], "key long, v long")
    t.refresh(again.select("key"), again, remove=True)
    t.refresh(again.select("key"), again, remove=True)
    assert content(spark, t) == {5: 1, 99: 2}


def test_no_keys_and_null_keys_and_several_files(spark):
    t = table(spark, 10, files=3)
    none = spark.createDataFrame([], "key long, v long")
    assert t.refresh(none.select("key"), none) == []
    t.refresh(spark.createDataFrame([(None,)], "key long"), spark.createDataFrame([(None, 4)], "key long, v long"), remove=True)
    assert content(spark, t) == {k: k * 10 for k in range(10)}  # a null key is no key
