"""Tables in buckets of their key, where a change reads and writes the buckets it touches and no others."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class BucketedTable:
    """Rows by hash of ``on`` in ``count`` folders of Parquet files.

    ``count`` grows with the table, so that a bucket stays at some hundred MB. It is a part of the layout: every
    reader and writer of a path gives the same. A key that is taken out stays as a row that is marked removed, as a
    bucket left without rows would not be overwritten; readers don't see such rows.
    """

    path: str
    on: tuple[str, ...]
    count: int = 64
    #: Files that a bucket is written in, by hash of the whole row, so that a hot key isn't one task.
    files: int = 1

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.on), F.lit(self.count)).cast("int")

    def _write(self, rows: DataFrame, mode: str) -> None:
        part = F.pmod(F.xxhash64(*(c for c in rows.columns if c != "bucket")), F.lit(self.files))
        dealt = rows.repartition("bucket", part) if self.files > 1 else rows.repartition("bucket")
        dealt.write.partitionBy("bucket").option("partitionOverwriteMode", "dynamic").mode(mode).parquet(self.path)

    def write(self, rows: DataFrame) -> BucketedTable:
        """Write the table anew; the folder must not exist."""
        self._write(rows.withColumns({"removed": F.lit(False), "bucket": self.bucket()}), "error")
        return self

    def touched(self, keys: DataFrame) -> list[int]:
        """Buckets that hold any of the keys: at most ``count`` numbers, whatever the number of keys."""
        return sorted(r.bucket for r in keys.select(self.bucket().alias("bucket")).distinct().collect())

    def _stored(self, spark: SparkSession, buckets: Sequence[int] | None) -> DataFrame:
        rows = spark.read.parquet(self.path)
        return rows if buckets is None else rows.where(F.col("bucket").isin(list(buckets)))

    def read(self, spark: SparkSession, buckets: Sequence[int] | None = None) -> DataFrame:
        """All rows, or those of some buckets; folders of other buckets aren't opened."""
        return self._stored(spark, buckets).where(~F.col("removed")).drop("removed", "bucket")

    def refresh(self, keys: DataFrame, fresh: DataFrame, remove: bool = False) -> list[int]:
        """Give ``keys`` their rows of ``fresh`` and return the buckets written.

        A key without a fresh row keeps what is stored, or is taken out with ``remove``; fresh rows of other keys don't
        count. New files of a bucket take the place of the old ones when the job commits, so that a run that fails
        leaves the table as it was, and one that is repeated gives the same table.
        """
        spark, on = keys.sparkSession, list(self.on)
        buckets = self.touched(keys)
        if not buckets:
            return []
        once = keys.select(*on).distinct()
        stored = self._stored(spark, buckets)
        new = fresh.join(once, on, "left_semi").withColumns({"removed": F.lit(False), "bucket": self.bucket()}).select(stored.columns)
        rest = stored.join(new.select(*on).distinct(), on, "left_anti")
        if remove:
            rest = rest.join(once.withColumn("out_", F.lit(True)), on, "left")
            rest = rest.withColumn("removed", F.col("removed") | F.coalesce("out_", F.lit(False))).select(stored.columns)
        self._write(rest.unionByName(new), "overwrite")
        return buckets
