"""Files by content: references, shards and a manifest of what is stored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def manifest(files: DataFrame) -> DataFrame:
    """``(ref, shard, n_bytes, copies, path)`` of ``files(path, content)``: equal contents are one blob, named by their sha256 and
    kept under its first two digits; ``path`` is the least of its copies'."""
    named = files.select("path", F.sha2("content", 256).alias("ref"), F.octet_length("content").cast("long").alias("n_bytes"))
    found = named.groupBy("ref").agg(F.max("n_bytes").alias("n_bytes"), F.count(F.lit(1)).alias("copies"), F.min("path").alias("path"))
    return found.select("ref", F.substring("ref", 1, 2).alias("shard"), "n_bytes", "copies", "path")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return manifest(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path))


def _folder(ref: Column) -> Column:
    """The shard's folder; the letter keeps digits like 1e from being read as numbers."""
    return F.concat(F.lit("s"), F.substring(ref, 1, 2))


def store(files: DataFrame, path: str) -> None:
    """Contents by shard, one row for each blob; a reader of one shard reads no other."""
    kept = files.groupBy(F.sha2("content", 256).alias("ref")).agg(F.first("content").alias("content"))
    kept.withColumn("shard", _folder(F.col("ref"))).write.mode("append").partitionBy("shard").parquet(path)


def fetch(spark: SparkSession, path: str, ref: str) -> DataFrame:
    """The content of a reference; no row where it isn't stored."""
    return spark.read.parquet(path).where((F.col("shard") == f"s{ref[:2]}") & (F.col("ref") == ref)).select("ref", "content").limit(1)
