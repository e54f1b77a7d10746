"""Views of the driver's tables in the shapes that the metric operators read, and the same views as SQL.

Thresholds are sized to the tables: they hold no recordings of activities.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table with its zone-less timestamps read as UTC."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.withColumns({c: F.col(c).cast("timestamp") for c, t in df.dtypes if t == "timestamp_ntz"})


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))


def short_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(key, t, power, hr)``: one sample for each event of a user; large values are gaps."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return events(spark, sf_dir).select(
        F.col("user_id").alias("key"), (F.row_number().over(order) - 1).alias("t"), F.when(F.col("value") <= 200, F.col("value") * 5).alias("power"), (100 + F.col("k")).cast("double").alias("hr")
    )


SHORT = """short AS (SELECT user_id AS key, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS t,
  CASE WHEN value <= 200 THEN value * 5 END AS power, 100 + CAST(regexp_extract(props, '[0-9]+') AS DOUBLE) AS hr FROM events)"""


def long_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(key, t, power)``: one sample for each line item of a supplier, in shipping order."""
    order = Window.partitionBy("l_suppkey").orderBy("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    return table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("key"), (F.row_number().over(order) - 1).alias("t"), (F.col("l_quantity") * 10).alias("power"))


LONG = """long AS (SELECT l_suppkey AS key, row_number() OVER (PARTITION BY l_suppkey
  ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice) - 1 AS t, l_quantity * 10 AS power FROM lineitem)"""


def irregular_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(key, pos, t, v)``: seconds since a user's first event at a ten-thousandth of the pace, so that short and long gaps occur."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    first = F.min(F.unix_timestamp("ts")).over(Window.partitionBy("user_id"))
    seconds = F.floor((F.unix_timestamp("ts") - first) / 10_000)
    return events(spark, sf_dir).select(F.col("user_id").alias("key"), F.row_number().over(order).alias("pos"), seconds.cast("long").alias("t"), F.when(F.col("value") <= 200, F.col("value")).alias("v"))


IRREGULAR = """irregular AS (SELECT user_id AS key, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos,
  CAST(floor((floor(epoch(ts)) - min(floor(epoch(ts))) OVER (PARTITION BY user_id)) / 10000) AS BIGINT) AS t,
  CASE WHEN value <= 200 THEN value END AS v FROM events)"""


def daily_loads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(key, day, load, substituted)``: an activity each event; a day whose events all lack a load has a null one."""
    load = F.when(F.col("value") <= 100, F.col("value"))
    return events(spark, sf_dir).groupBy(F.col("user_id").alias("key"), F.to_date("ts").alias("day")).agg(F.sum(load).alias("load"), F.bool_or(F.col("event_type") == "click").alias("substituted"))


DAILY = """daily AS (SELECT user_id AS key, CAST(ts AS DATE) AS day, sum(CASE WHEN value <= 100 THEN value END) AS load,
  bool_or(event_type = 'click') AS substituted FROM events GROUP BY 1, 2)"""


def signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(key, effective_date, ftp_w, fit_r2)``: the order of the largest key of each customer and day."""
    o = table(spark, sf_dir, "orders")
    return o.groupBy(F.col("o_custkey").alias("key"), F.to_date("o_orderdate").alias("effective_date")).agg(
        F.max_by(F.col("o_totalprice") / 1000, "o_orderkey").alias("ftp_w"), F.max_by((F.col("o_orderkey") % 100) / 100, "o_orderkey").alias("fit_r2")
    )


SIGNATURES = """signatures AS (SELECT o_custkey AS key, CAST(o_orderdate AS DATE) AS effective_date, max_by(o_totalprice / 1000, o_orderkey) AS ftp_w,
  max_by((o_orderkey % 100) / 100.0, o_orderkey) AS fit_r2 FROM orders GROUP BY 1, 2)"""


def activities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(activity_id, athlete, start, sport, duration_s)`` from orders."""
    o = table(spark, sf_dir, "orders")
    sport = F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "cycling").when(F.col("o_orderpriority") == "3-MEDIUM", "running").otherwise("other")
    return o.select(F.col("o_orderkey").alias("activity_id"), F.col("o_custkey").alias("athlete"), F.col("o_orderdate").alias("start"), sport.alias("sport"), (F.col("o_totalprice") / 100).alias("duration_s"))


ACTIVITIES = """activities AS (SELECT o_orderkey AS activity_id, o_custkey AS athlete, o_orderdate AS start,
  CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'cycling' WHEN o_orderpriority = '3-MEDIUM' THEN 'running' ELSE 'other' END AS sport,
  o_totalprice / 100 AS duration_s FROM orders)"""


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(key, line, tier, confidence, observed, source, field)``: several sources' values for one field of one record."""
    tier = F.when(F.col("l_returnflag") == "R", "raw_stream").when(F.col("l_returnflag") == "A", "platform_computed").otherwise("summary_only")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("key"), F.col("l_linenumber").alias("line"), tier.alias("tier"), F.round(1 - F.col("l_discount"), 2).alias("confidence"), F.col("l_shipdate").alias("observed"),
        F.col("l_suppkey").alias("source"), F.col("l_partkey").alias("native"), F.col("l_quantity").alias("value"), F.col("l_extendedprice").alias("price"),
    )


CANDIDATES = """candidates AS (SELECT l_orderkey AS key, l_linenumber AS line,
  CASE WHEN l_returnflag = 'R' THEN 'raw_stream' WHEN l_returnflag = 'A' THEN 'platform_computed' ELSE 'summary_only' END AS tier,
  round(1 - l_discount, 2) AS confidence, l_shipdate AS observed, l_suppkey AS source, l_partkey AS native, l_quantity AS value, l_extendedprice AS price FROM lineitem)"""
