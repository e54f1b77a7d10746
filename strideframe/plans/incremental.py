"""Queries that run as streams over the tables' files until all is read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strideframe.functions import constants as C
from strideframe.operators import gaps
from strideframe.sources import paged
from strideframe.sources.scratch import scratch
from strideframe.streaming import fitness, ingest


def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events through the version log; daily loads of the current versions."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    source = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*")
    at = scratch(spark, "stream")
    ingest.append_versions(source, f"{at}/log", f"{at}/checkpoint", "event_id").awaitTermination()
    rows = ingest.current_rows(spark, f"{at}/log", "event_id")
    return rows.groupBy("user_id", F.to_date("ts").alias("day")).agg(F.round(F.sum("value"), 4).alias("load"), F.count(F.lit(1)).alias("n"))


INGEST = "SELECT user_id, CAST(ts AS DATE) AS day, round(sum(value), 4) AS load, count(*) AS n FROM events GROUP BY 1, 2"


def stream_watermarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """High-water instants by event type after two runs over the log: all events but those of odd numbers before 15 January, then these."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("content_hash", F.col("event_id").cast("string"))
    second = (F.col("event_id") % 2 == 1) & (F.col("ts") < F.lit("2024-01-15").cast("timestamp_ntz"))
    early, late = rows.where(~second), rows.where(second)
    out = ingest.raised(ingest.watermarks(early, ["event_type"], "ts"), ingest.watermarks(late, ["event_type"], "ts"), ["event_type"])
    return out.select("event_type", F.unix_micros(F.col("high_water_at").cast("timestamp")).alias("high_water_us"), "content_hint")


WATERMARKS = """WITH a AS (SELECT event_type, max(ts) AS t, max_by(CAST(event_id AS VARCHAR), ts) AS h FROM events WHERE NOT (event_id % 2 = 1 AND ts < TIMESTAMP '2024-01-15 00:00:00') GROUP BY 1),
b AS (SELECT event_type, max(ts) AS t, max_by(CAST(event_id AS VARCHAR), ts) AS h FROM events WHERE event_id % 2 = 1 AND ts < TIMESTAMP '2024-01-15 00:00:00' GROUP BY 1)
SELECT coalesce(a.event_type, b.event_type) AS event_type, epoch_us(greatest(a.t, b.t)) AS high_water_us, coalesce(b.h, a.h) AS content_hint FROM a FULL JOIN b ON a.event_type = b.event_type"""

def stream_fitness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fitness of each user by keyed state over two runs of a stream of several batches in any order of days.

    Some records are unusable; in the second run some come again as they were and some with another load.
    """
    e, n = spark.read.parquet(f"{sf_dir}/events.parquet"), F.col("event_id")
    load = F.when(n % 97 == 0, "n/a").when(n % 89 == 0, "NaN").when(F.col("value") <= 100, F.col("value").cast("string"))
    records = e.select(n.alias("id"), F.col("user_id").alias("key"), F.date_diff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).alias("day"), load.alias("load"))
    early = F.col("id") % 5 < 3
    changed = F.when(F.col("id") % 13 == 0, (F.col("load").try_cast("double") + 1).cast("string")).otherwise(F.col("load"))
    second = records.where(~early | (F.col("id") % 11 == 0) | (F.col("id") % 13 == 0)).withColumn("load", F.when(early, changed).otherwise(F.col("load")))
    seeds = e.where("user_id % 3 = 0").select(F.col("user_id").alias("key")).distinct().select("key", F.lit(-5).alias("day"), F.lit(50.0).alias("ctl"), F.lit(40.0).alias("atl"))
    at = scratch(spark, "stream")
    for part in (records.where(early), second):
        part.repartition(3, F.xxhash64("id")).write.mode("append").parquet(f"{at}/in")
        stream = spark.readStream.schema(records.schema).option("maxFilesPerTrigger", 2).parquet(f"{at}/in")
        fitness.land_states(fitness.fitness_states(stream, seeds), f"{at}/states", f"{at}/checkpoint").awaitTermination()
    lost = fitness.landed(spark, f"{at}/states", "rejected").groupBy("key").agg(F.count_distinct("id").alias("n_rejected"))
    out = fitness.current_fitness(spark, f"{at}/states").join(lost, "key", "left")
    return out.select("key", "day", F.round("ctl", 6).alias("ctl"), F.round("atl", 6).alias("atl"), F.coalesce("n_rejected", F.lit(0)).alias("n_rejected"))


_DECAYED = "sum((1 - exp(-1.0 / {0})) * load * exp(-(last - day) / {0})) + CASE WHEN key % 3 = 0 THEN {1} * exp(-(last + 5) / {0}) ELSE 0 END"
FITNESS = f"""WITH e AS (SELECT event_id, user_id AS key, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS day, CASE WHEN event_id % 97 <> 0 AND event_id % 89 <> 0 AND value <= 100 THEN value + CASE WHEN event_id % 13 = 0 AND event_id % 5 < 3 THEN 1 ELSE 0 END END AS load FROM events),
g AS (SELECT *, max(day) OVER (PARTITION BY key) AS last FROM e WHERE load IS NOT NULL), b AS (SELECT key, count(*) AS n FROM e WHERE load IS NULL GROUP BY 1),
f AS (SELECT key, last AS day, {_DECAYED.format(C.CTL_DAYS, 50)} AS ctl, {_DECAYED.format(C.ATL_DAYS, 40)} AS atl FROM g GROUP BY key, last)
SELECT f.key, CAST(day AS INTEGER) AS day, round(ctl, 6) AS ctl, round(atl, 6) AS atl, coalesce(n, 0) AS n_rejected FROM f LEFT JOIN b ON f.key = b.key"""

STAGES, PAGE_SIZE = ("activities", "wellness"), 200


def _order_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    refs = o.select(
        F.lit(0).alias("scope"), F.when(F.col("o_orderkey") % 3 > 0, STAGES[0]).otherwise(STAGES[1]).alias("stage"), F.col("o_orderkey").alias("ref_id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("hint"),
        F.struct(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("customer")).alias("payload"),
    )
    rows = gaps.pages(refs, STAGES, PAGE_SIZE)
    return rows.select("stage", F.substring_index("cursor", ":", -1).cast("long").alias("offset"), "next_cursor", F.col("ref_id").cast("string").alias("ref"), "hint", "payload")


def _delivered(rows: DataFrame) -> DataFrame:
    return rows.select("stage", "offset", "ref", "hint", F.get_json_object("payload", "$.customer").cast("long").alias("customer"), F.col("error").isNotNull().alias("failed"))


def paged_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders behind cursors, read up to the first broken page; a tenth of the records can't be read."""
    at = scratch(spark, "stream")
    paged.write_pages(_order_pages(spark, sf_dir), at, (F.col("stage") == STAGES[1]) & (F.col("offset") == 2 * PAGE_SIZE), F.col("ref").cast("long") % 10 == 0)
    spark.dataSource.register(paged.PagedSource)
    return _delivered(spark.read.format("pages").options(path=at, stages=",".join(STAGES)).load())


def paged_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as a stream of two runs: the first ends at a broken page of the first stage, which is mended before the second."""
    at = scratch(spark, "stream")
    pages = _order_pages(spark, sf_dir)
    broken = F.col("ref").cast("long") % 10 == 0
    last = (F.col("stage") == STAGES[1]) & (F.col("offset") == 2 * PAGE_SIZE)
    spark.dataSource.register(paged.PagedSource)
    mended = (F.col("stage") == STAGES[0]) & (F.col("offset") == PAGE_SIZE)
    for rows, bad, mode in ((pages, last | mended, "overwrite"), (pages.where(mended), last, "append")):
        paged.write_pages(rows, f"{at}/pages", bad, broken, mode)
        stream = spark.readStream.format("pages").options(path=f"{at}/pages", stages=",".join(STAGES)).load()
        writer = stream.writeStream.foreachBatch(lambda batch, n: batch.write.mode("overwrite").parquet(f"{at}/out/batch={n}"))
        query = writer.option("checkpointLocation", f"{at}/checkpoint").start()
        query.processAllAvailable()
        query.stop()
    return _delivered(spark.read.schema(stream.schema).parquet(f"{at}/out"))


PAGED = f"""WITH r AS (SELECT CASE WHEN o_orderkey % 3 > 0 THEN '{STAGES[0]}' ELSE '{STAGES[1]}' END AS stage, o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS hint, o_custkey FROM orders),
p AS (SELECT *, CAST(floor((row_number() OVER (PARTITION BY stage ORDER BY o_orderkey) - 1) / {PAGE_SIZE}) * {PAGE_SIZE} AS BIGINT) AS "offset", o_orderkey % 10 = 0 AS failed FROM r)
SELECT stage, "offset", CASE WHEN NOT failed THEN CAST(o_orderkey AS VARCHAR) END AS ref, CASE WHEN NOT failed THEN hint END AS hint, CASE WHEN NOT failed THEN o_custkey END AS customer, failed
FROM p WHERE stage = '{STAGES[0]}' OR "offset" < {2 * PAGE_SIZE}"""

QUERIES = {f.__name__: f for f in (stream_ingest, stream_watermarks, stream_fitness, paged_batch, paged_stream)}
ORACLE = {"stream_ingest": INGEST, "stream_watermarks": WATERMARKS, "stream_fitness": FITNESS, "paged_batch": PAGED, "paged_stream": PAGED}
