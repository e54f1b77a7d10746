"""Incremental ingestion: versioned log by micro-batch, current rows, watermarks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strideframe.functions.scalars import content_hash
from strideframe.operators.resolve import current_version


def append_versions(stream: DataFrame, log: str, checkpoint: str, key: str, available_now: bool = True):
    """Write a stream to a log of versions, one folder for each micro-batch: a batch that runs again replaces its folder, so a
    restart neither loses nor repeats rows. ``content_hash`` tells byte-identical re-deliveries apart from changes."""

    def write(batch: DataFrame, batch_id: int) -> None:
        hashed = batch.withColumn("content_hash", content_hash(*batch.columns))
        hashed.dropDuplicates([key, "content_hash"]).write.mode("overwrite").parquet(f"{log}/batch={batch_id}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def current_rows(spark: SparkSession, log: str, key: str) -> DataFrame:
    """The version of each key that the latest batch brought; a version that came again unchanged stays one."""
    rows = spark.read.parquet(log)
    return current_version(rows, [key], [F.desc("batch"), F.col("content_hash")])


def watermarks(rows: DataFrame, scope: list[str], observed: str) -> DataFrame:
    """High-water instant of each scope and the hash of the row that set it; a later batch can only raise it."""
    return rows.groupBy(*scope).agg(F.max(observed).alias("high_water_at"), F.max_by("content_hash", F.struct(observed, "content_hash")).alias("content_hint"))


def raised(stored: DataFrame, fresh: DataFrame, scope: list[str]) -> DataFrame:
    """Watermarks after a run: the later instant counts, the hint is always the fresh one."""
    f = fresh.select(*scope, F.col("high_water_at").alias("fresh_at"), F.col("content_hint").alias("fresh_hint"))
    both = stored.join(f, scope, "full_outer")
    return both.select(*scope, F.greatest("high_water_at", "fresh_at").alias("high_water_at"), F.coalesce("fresh_hint", "content_hint").alias("content_hint"))


def fold_versions(spark: SparkSession, log: str, current: str, key: str) -> DataFrame:
    """The current version of each key, kept as a table so that a run reads the batches since the last one alone.

    ``current`` has a folder for each fold, named by the last batch in it; a fold that runs again replaces its folder.
    """
    from pyspark.errors import AnalysisException

    batches = spark.read.parquet(log)
    last = batches.agg(F.max("batch")).first()[0]
    try:
        folded = spark.read.parquet(current)
        upto = folded.where(F.col("upto") < last).agg(F.max("upto")).first()[0]
    except AnalysisException:
        upto = None
    rows = batches if upto is None else folded.where(F.col("upto") == upto).drop("upto").unionByName(batches.where(F.col("batch") > upto))
    current_version(rows, [key], [F.desc("batch"), F.col("content_hash")]).write.mode("overwrite").parquet(f"{current}/upto={last}")
    return spark.read.parquet(current).where(F.col("upto") == last).drop("upto")
