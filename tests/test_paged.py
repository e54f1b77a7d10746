"""The paged source: cursors, broken pages and records, growth behind the last page, and streams that go on."""

import json
import tempfile
from pathlib import Path

from strideframe.sources import paged


def page(at, stage, offset, following, records, head=None):
    folder = Path(at, f"stage={stage}", f"offset={offset}")
    folder.mkdir(parents=True, exist_ok=True)
    lines = [json.dumps({"ref": r, "hint": None, "payload": {"n": r}}) if isinstance(r, str) else r[0] for r in records]
    (folder / "part-0.txt").write_text("\n".join([*lines, head or json.dumps({"next": following, "size": len(records)})]))


def test_batch_ends_at_the_first_broken_page(spark):
    at = tempfile.mkdtemp(prefix="spark-")
    page(at, "a", 0, "a:2", ["x", ("{oops",)])
    page(at, "a", 2, "b:0", ["y"])
    page(at, "b", 0, "b:1", ["z"], head="{")
    page(at, "b", 1, None, ["never"])
    spark.dataSource.register(paged.PagedSource)
    for path in (at, f"file://{at}"):
        df = spark.read.format("pages").options(path=path, stages="a,b").load()
        rows = sorted((r.stage, r.offset, r.ref or "", r.payload or "", r.error is None) for r in df.collect())
        assert rows == [("a", 0, "", "", False), ("a", 0, "x", '{"n":"x"}', True), ("a", 2, "y", '{"n":"y"}', True)]
        assert df.rdd.getNumPartitions() == 2
    assert spark.read.format("pages").options(path=f"{at}/none", stages="a").load().count() == 0


def test_stream_goes_on_from_its_cursor(spark):
    at = tempfile.mkdtemp(prefix="spark-")
    spark.dataSource.register(paged.PagedSource)

    def run():
        stream = spark.readStream.format("pages").options(path=f"{at}/in", stages="a,b").load()
        query = stream.writeStream.foreachBatch(lambda b, n: b.write.mode("overwrite").parquet(f"{at}/out/batch={n}")).option("checkpointLocation", f"{at}/ck").start()
        query.processAllAvailable()
        query.stop()
        return sorted(r.ref for r in spark.read.schema(paged.SCHEMA).parquet(f"{at}/out").collect())

    page(f"{at}/in", "a", 0, "b:0", ["x", "y"])
    page(f"{at}/in", "b", 0, None, ["z"], head="?")
    assert run() == ["x", "y"]
    page(f"{at}/in", "b", 0, None, ["z"])
    assert run() == ["x", "y", "z"] == run()
    page(f"{at}/in", "b", 1, None, ["new"])  # behind the last page
    assert run() == ["new", "x", "y", "z"]
