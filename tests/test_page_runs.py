"""Many pages behind cursors: runs of them in a task, pages written in one pass, places of a large stage by ranges of ids."""

import tempfile
from collections import Counter
from pathlib import Path

from pyspark.sql import functions as F

from strideframe.operators import gaps
from strideframe.sources import paged

STAGES = ("b", "a")


def refs(spark, n):
    stage = F.when(F.col("id") % 3 > 0, "b").otherwise("a")
    return spark.range(n).select(F.lit(0).alias("scope"), stage.alias("stage"), F.col("id").alias("ref_id"), F.lit("h").alias("hint"), F.struct("id").alias("payload"))


def test_many_pages_are_read_in_runs_of_pages(spark):
    at = tempfile.mkdtemp(prefix="spark-")
    rows = gaps.pages(refs(spark, 1500), STAGES, 2).select("stage", F.substring_index("cursor", ":", -1).cast("long").alias("offset"), "next_cursor", F.col("ref_id").cast("string").alias("ref"), "hint", "payload")
    broken = F.col("ref").cast("long") % 10 == 0
    paged.write_pages(rows, at, (F.col("stage") == "a") & (F.col("offset") == 2), broken)
    spark.dataSource.register(paged.PagedSource)
    df = spark.read.format("pages").options(path=at, stages=",".join(STAGES)).load()
    found = df.collect()
    want = [i for i in range(1500) if i % 3] + [0, 3]
    assert Counter(r.ref for r in found) == Counter(None if i % 10 == 0 else str(i) for i in want)
    assert len({(r.stage, r.offset) for r in found}) == 501
    assert df.rdd.getNumPartitions() <= paged.RUNS
    # The broken page alone is written again.
    other = Path(at, "stage=b", "offset=0", "part-0.txt").stat().st_mtime_ns
    paged.write_pages(rows.where("stage = 'a' AND offset = 2"), at, F.lit(False), broken, "append")
    assert spark.read.format("pages").options(path=at, stages=",".join(STAGES)).load().count() == 1500
    assert Path(at, "stage=b", "offset=0", "part-0.txt").stat().st_mtime_ns == other


def test_runs_cover_a_walk(monkeypatch):
    pages = paged.Pages("", ["a"])
    monkeypatch.setattr(paged.Pages, "after", lambda self, c: f"a:{int(c[2:]) + 1}" if int(c[2:]) < 5000 else None)
    monkeypatch.setattr(paged, "RUNS", 8)
    monkeypatch.setattr(paged, "RUN_PAGES", 64)
    for end in (0, 1, 7, 8, 9, 100, 4097, 5000):
        runs, behind = pages.runs("a:0", f"a:{end}")
        assert behind == f"a:{end}" and [int(r.first[2:]) for r in runs] == [sum(x.pages for x in runs[:i]) for i in range(len(runs))]
        assert sum(r.pages for r in runs) == end and all(r.pages <= 64 for r in runs)


def test_pages_of_a_large_stage_are_the_same(spark):
    rows = refs(spark, 1000).unionByName(refs(spark, 10).withColumn("scope", F.lit(1)))
    plain = gaps.pages(rows, STAGES, 7)
    ranged = gaps.pages(rows, STAGES, 7, hot_rows=100)
    assert plain.columns == ranged.columns
    assert sorted(map(str, plain.collect())) == sorted(map(str, ranged.collect()))
