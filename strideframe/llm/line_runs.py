"""Line dedup: lines that many documents share stay in one of them.

The store of line keys is a set of sorted runs in levels. Each run is a bucketed, sorted table of
``(h1, h2, n, keeper)``: 128 bits of a key's hash, the number of documents of one batch that hold it, and the document
that keeps it, named only by the batch that brought the key first. A new batch is joined bucket by bucket to the runs:
what matches none is new and gets its keeper, what matches adds its count; the outcome is a run of level 0. Two runs
of a level are merged into one of the next, bucket by bucket. Batches come from the largest doc_ids down, so the first to bring a key
holds the largest one.

A key with many documents is sent to every task by a broadcast of at most ``HOT_KEYS`` rows; the others meet their lines
in a shuffle in which no key has more than that share of all rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strideframe.llm.common import as_bytes, dropped, row_of, saved, scratch, slices

BLANK = b" \t\n\x0b\x0c\r"
LEAST_CHARS = 20
LEAST_DOCS = 3
BATCHES = 4
HOT_KEYS = 65_536
KEY = ["h1", "h2"]


def line_keys(text: bytes) -> list[bytes]:
    """The key of each line, ``b""`` for those under LEAST_CHARS code points, which never count."""
    keys = [line.strip(BLANK) for line in text.lower().split(b"\n")]
    return [k if len(k) >= LEAST_CHARS and (k.isascii() or len(k.decode("utf-8", "replace")) >= LEAST_CHARS) else b"" for k in keys]


def _halves(digests: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
    return both[:, 0], both[:, 1]


def hashed_lines(docs: DataFrame) -> DataFrame:
    """``(doc_id, t, h1, h2)``: each key of each row once; ``t`` is the hash of the row's text."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            keys = [{xxhash.xxh3_128_digest(k) for k in line_keys(text) if k} for text in as_bytes(part.column("text"))]
            h1, h2 = _halves([d for found in keys for d in found])
            again = np.repeat(np.arange(len(keys)), [len(k) for k in keys])
            yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(again)), part.column("t").take(pa.array(again)), pa.array(h1), pa.array(h2)], names=["doc_id", "t", *KEY])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("t"), "text")
    return rows.mapInArrow(hashed, "doc_id long, t long, h1 long, h2 long")


class LineRuns:
    """Levelled runs of line keys. ``buckets`` holds for all of them, so that merges move no entry between tasks."""

    def __init__(self, spark: SparkSession, buckets: int | None = None):
        self.spark = spark
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[DataFrame]] = [[]]

    def _run(self, entries: DataFrame) -> DataFrame:
        """``entries`` as a written run: bucketed by key, sorted in its buckets."""
        name, path = f"line_run_{uuid.uuid4().hex}", scratch(self.spark, "line-run")
        entries.select(*KEY, "n", "keeper").write.bucketBy(self.buckets, *KEY).sortBy(*KEY).option("path", path).saveAsTable(name)
        run = self.spark.table(name)  # resolved before the name goes; the files stay
        self.spark.sql(f"DROP TABLE {name}")
        run._scratch_path = path
        return run

    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def add(self, lines: DataFrame) -> DataFrame:
        """Take a batch of ``(doc_id, h1, h2)`` in; its run is returned. Keys of earlier batches keep their keeper."""
        batch = lines.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("last"))
        known = []
        for i, run in enumerate(self.runs()):
            known.append(f"known_{i}")
            batch = batch.join(run.select(*KEY, F.lit(True).alias(known[-1])).hint("merge"), KEY, "left")
        new = F.coalesce(*map(F.col, known), F.lit(False)) == F.lit(False)
        added = self._run(batch.withColumn("keeper", F.when(new, F.col("last"))))
        self.levels[0].append(added)
        self._compact()
        return added

    def _compact(self) -> None:
        for i, level in enumerate(self.levels):
            if len(level) == 2:
                if i + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[i + 1].append(self._merged(*level))
                self.levels[i] = []

    def _merged(self, a: DataFrame, b: DataFrame) -> DataFrame:
        """One run in place of two, whose files go. Both have the same buckets, so that the join moves no entry."""
        theirs = b.select(*KEY, F.col("n").alias("n_b"), F.col("keeper").alias("keeper_b")).hint("merge")
        both = a.join(theirs, KEY, "full")
        count = F.coalesce("n", F.lit(0)) + F.coalesce("n_b", F.lit(0))
        run = self._run(both.select(*KEY, count.alias("n"), F.coalesce("keeper", "keeper_b").alias("keeper")))
        for old in (a, b):
            dropped(old)
        return run

    def entries(self) -> DataFrame:
        """``(h1, h2, n, keeper)`` of every key: what is left of the runs once all are merged, the smaller first."""
        left = list(reversed(self.runs()))
        while len(left) > 1:
            left[:2] = [self._merged(left[1], left[0])]
        self.levels = [left]
        return left[0]


def _batched(docs: DataFrame, batches: int) -> tuple[DataFrame, int]:
    """The lines of ``docs`` as a table with a folder for each batch; batch 0 has the largest doc_ids, null ones are last."""
    cuts = docs.agg(F.percentile_approx(F.col("doc_id").cast("long"), [(batches - i) / batches for i in range(1, batches)], 1000)).first()[0] or []
    cuts = sorted(set(cuts), reverse=True)
    batch = F.lit(len(cuts))
    for i, cut in reversed(list(enumerate(cuts))):
        batch = F.when(F.col("doc_id") > cut, i).otherwise(batch)
    lines, path = hashed_lines(docs).withColumn("batch", batch), scratch(docs.sparkSession, "lines")
    lines.write.partitionBy("batch").parquet(path)
    return docs.sparkSession.read.schema(lines.schema).parquet(path), len(cuts) + 1


def dropped_keys(docs: DataFrame, batches: int = BATCHES) -> DataFrame:
    """``(doc_id, t, keys)``: the keys that the rows of this doc_id and text hash lose."""
    lines, n = _batched(docs, batches)
    store = LineRuns(docs.sparkSession)
    for i in range(n):
        store.add(lines.where(F.col("batch") == i))
    shared = saved(store.entries().where(F.col("n") >= LEAST_DOCS), "shared-lines")
    # At most HOT_KEYS keys have that share of all holders.
    many = (shared.agg(F.sum("n")).first()[0] or 0) // HOT_KEYS + 1
    hot = F.broadcast(shared.where(F.col("n") > many).select(*KEY, "keeper"))
    rest = shared.where(F.col("n") <= many).select(*KEY, "keeper")
    met = lines.join(hot, KEY).unionByName(lines.join(hot, KEY, "left_anti").join(rest, KEY))
    lost = met.where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
    return lost.groupBy("doc_id", "t").agg(F.collect_set(F.struct(*KEY)).alias("keys"))


def _cut(docs: DataFrame, batches: int) -> DataFrame:
    """``(row, n_lines, n_dropped, kept)`` of every row; kept is null where nothing goes."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("t"), "text", row_of(docs).alias("row"))
    lost = dropped_keys(docs.select("doc_id", "text"), batches)
    on = F.col("doc_id").eqNullSafe(F.col("d_id")) & (F.col("t") == F.col("d_t"))
    met = rows.join(lost.select(F.col("doc_id").alias("d_id"), F.col("t").alias("d_t"), "keys"), on, "left").select("row", "text", F.col("keys.h1").alias("k1"), F.col("keys.h2").alias("k2"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            lines, gone, kept = [], [], []
            for text, k1, k2 in zip(as_bytes(part.column("text")), part.column("k1"), part.column("k2")):
                lines.append(text.count(b"\n") + 1)
                gone.append(0)
                kept.append(None)
                if k1.is_valid:
                    keys = set(np.stack([k1.values.to_numpy(), k2.values.to_numpy()], 1).astype("<i8").view("V16").ravel().tolist())
                    stay = [line for line, key in zip(text.split(b"\n"), line_keys(text)) if not key or xxhash.xxh3_128_digest(key) not in keys]
                    gone[-1], kept[-1] = lines[-1] - len(stay), b"\n".join(stay)
            yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(lines, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], names=["row", "n_lines", "n_dropped", "kept"])

    fields = [T.StructField("row", met.schema["row"].dataType), T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType()), T.StructField("kept", T.StringType())]
    return met.mapInArrow(cut, T.StructType(fields))


def line_report(docs: DataFrame, batches: int = BATCHES) -> DataFrame:
    """``(doc_id, n_lines, n_dropped, kept_sha256)`` of every row of ``docs``.

    Each row is a document: rows that repeat a doc_id count one by one, and all rows of a key's largest doc_id keep it.
    A null or empty text is one empty line. A null doc_id is smaller than any other; a key that only such rows hold stays
    in all of them. Rows and columns of any other name change nothing; an empty table gives none.
    """
    docs = docs.select("doc_id", "text")
    text = F.coalesce("kept", "row.text", F.lit(""))
    return _cut(docs, batches).select(F.col("row.doc_id").cast("long").alias("doc_id"), "n_lines", "n_dropped", F.sha2(text, 256).alias("kept_sha256"))


def without_shared_lines(docs: DataFrame, batches: int = BATCHES) -> DataFrame:
    """``docs`` with the lines that :func:`line_report` drops cut out of ``text``; all other columns and all rows stay."""
    fields = [F.coalesce("kept", "row.text").alias("text") if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns]
    return _cut(docs, batches).select(*fields)
