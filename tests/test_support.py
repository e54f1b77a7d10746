"""Stores, exports, orders and folds that have no SQL form."""

import tempfile
from pathlib import Path

import pytest

from strideframe.operators import lifecycle, listing, serve
from strideframe.sources import blobs
from strideframe.streaming import ingest


def test_tables_in_order():
    parents = {"lap": ["activity"], "activity": ["athlete"], "athlete": [], "file": ["activity"], "token": []}
    assert lifecycle.table_order(parents) == ["athlete", "activity", "file", "lap", "token"]
    assert lifecycle.table_order(parents, ["file"], delete=True) == ["file", "token", "lap", "activity", "athlete"]
    with pytest.raises(ValueError, match="ring"):
        lifecycle.table_order({"a": ["b"], "b": ["a"]})


def test_blobs(spark):
    at = tempfile.mkdtemp(prefix="spark-") + "/store"
    files = spark.createDataFrame([("b", b"one"), ("a", b"one"), ("c", b"two")], "path string, content binary")
    found = {r.path: (r.copies, r.n_bytes, r.ref) for r in blobs.manifest(files).collect()}
    assert found["a"][:2] == (2, 3) and found["c"][:2] == (1, 3)
    blobs.store(files, at)
    assert [bytes(r.content) for r in blobs.fetch(spark, at, found["c"][2]).collect()] == [b"two"] and blobs.fetch(spark, at, "0" * 64).count() == 0


def test_artifacts(spark):
    rows = spark.createDataFrame([(2, "b"), (1, None), (3, "c")], "day int, name string")
    for kind in ("json", "csv"):
        at = tempfile.mkdtemp(prefix="spark-") + "/out"
        serve.write_artifact(rows, at, kind, "day")
        back = spark.read.json(at) if kind == "json" else spark.read.option("header", True).csv(at)
        assert [(int(r.day), r.name) for r in back.orderBy("day").collect()] == [(1, None), (2, "b"), (3, "c")]
        assert list(Path(at).glob("*.gz"))
    with pytest.raises(ValueError, match="kind"):
        serve.write_artifact(rows, at, "zip", "day")


def test_folds_read_new_batches_alone(spark):
    at = tempfile.mkdtemp(prefix="spark-")
    write = lambda n, rows: spark.createDataFrame(rows, "id long, v double, content_hash string").write.parquet(f"{at}/log/batch={n}")
    write(0, [(1, 1.0, "a"), (2, 2.0, "b")])
    assert {(r.id, r.v) for r in ingest.fold_versions(spark, f"{at}/log", f"{at}/now", "id").collect()} == {(1, 1.0), (2, 2.0)}
    write(1, [(1, 5.0, "c")])
    for _ in range(2):  # a fold that runs again changes nothing
        assert {(r.id, r.v) for r in ingest.fold_versions(spark, f"{at}/log", f"{at}/now", "id").collect()} == {(1, 5.0), (2, 2.0)}
    assert {(r.id, r.v) for r in ingest.current_rows(spark, f"{at}/log", "id").select("id", "v").collect()} == {(1, 5.0), (2, 2.0)}


def test_seeds_must_be_finite(spark):
    import datetime as dt

    days = spark.createDataFrame([(1, dt.date(2024, 1, d), 50.0) for d in range(1, 9)], "key long, day date, load double")
    reasons = lambda *seed: {r.reason for r in listing.seeded_window(days, "2024-01-04", "2024-01-08", *seed).collect()}
    assert reasons() == reasons(float("nan"), 1.0) == {"not_seeded"} and reasons(1.0, 2.0) == {None}
    assert {r.reason for r in listing.seeded_window(days, "2024-01-01", "2024-01-08").collect()} == {None}


def test_adapters(spark):
    from dataclasses import dataclass

    from pyspark.errors import PySparkException

    from strideframe.sources import adapters

    @dataclass
    class Point:
        name: str
        found: object

        def load(self):
            if isinstance(self.found, Exception):
                raise self.found
            return self.found

    read = lambda s, types: s.createDataFrame([(t,) for t in types], "gbo_type string")
    good = adapters.Adapter("a", "file", ("activity",), ("map",), read)
    odd = [adapters.Adapter("b", "poll", ("activity",), ("map",), read), adapters.Adapter("c", "file", ("invoice",), ("map",), read), adapters.Adapter("a", "file", ("activity",), ("map",), read), object(), RuntimeError("broken")]
    registry = adapters.load_registry([Point("p0", good), *(Point(f"p{i}", x) for i, x in enumerate(odd, 1))])
    assert list(registry.adapters) == ["a"]
    assert registry.refused == {"p1": "phases missing: discover, fetch", "p2": "not writable: invoice", "p3": "key is taken: a", "p4": "not an adapter", "p5": "RuntimeError: broken"}
    assert registry.candidates(spark, "a", types=["activity"]).count() == 1
    with pytest.raises(PySparkException, match="schema_mismatch"):
        registry.candidates(spark, "a", types=["activity", "daily_wellness"]).collect()
