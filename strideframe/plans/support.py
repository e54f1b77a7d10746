"""Queries of smaller rules of metrics, records and exports, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strideframe.functions import scalars
from strideframe.operators import heart, lifecycle, serve
from strideframe.sources import blobs
from strideframe.sources import fixtures as fx


def hrv_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with beats, with a device's summary that may be empty, or with both."""
    c = fx.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("v"))
    key, v = F.col("key"), F.col("v")
    series = c.where(key % 3 == 0).select("key", *(F.when(key % 6 == 0, v * k).alias(n) for n, k in (("rmssd", 1), ("sdnn", 2), ("pnn50", 3), ("mean_nn", 4))), F.when(key % 6 > 0, "insufficient_data").alias("reason"))
    summary = c.select("key", F.when((key % 5 > 0) & (key % 7 > 0), v + 1).alias("rmssd"), F.lit(None).cast("double").alias("sdnn"), F.lit(None).cast("double").alias("pnn50"), F.lit(None).cast("double").alias("mean_nn"))
    return heart.with_summary(series, summary)


FALLBACK = """WITH c AS (SELECT c_custkey AS key, c_acctbal AS v, c_custkey % 3 = 0 AS beats, c_custkey % 5 > 0 AND c_custkey % 7 > 0 AS given FROM customer)
SELECT key, CASE WHEN beats THEN CASE WHEN key % 6 = 0 THEN v END WHEN given THEN v + 1 END AS rmssd, CASE WHEN beats AND key % 6 = 0 THEN v * 2 END AS sdnn, CASE WHEN beats AND key % 6 = 0 THEN v * 3 END AS pnn50,
CASE WHEN beats AND key % 6 = 0 THEN v * 4 END AS mean_nn, CASE WHEN beats THEN 'beats' WHEN given THEN 'summary' END AS source,
CASE WHEN beats THEN CASE WHEN key % 6 > 0 THEN 'insufficient_data' END WHEN NOT given THEN 'missing_required_input' END AS reason FROM c"""


def hrv_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, v = F.col("p_partkey"), F.col("p_retailprice")
    low, high = F.when(key % 3 > 0, v), F.when(key % 4 == 1, float("inf")).when(key % 4 > 1, v + 10)
    return fx.table(spark, sf_dir, "part").select(key, heart.baseline(low, high).alias("baseline"))


BASELINE = """SELECT p_partkey, CASE WHEN p_partkey % 3 > 0 AND p_partkey % 4 > 1 THEN (p_retailprice + (p_retailprice + 10)) / 2 WHEN p_partkey % 3 > 0 THEN p_retailprice WHEN p_partkey % 4 > 1 THEN p_retailprice + 10 END AS baseline FROM part"""


def beats_of_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as recordings; those of even value carry beats."""
    e = fx.events(spark, sf_dir)
    rr = F.when(F.floor("value") % 2 == 0, F.array(F.col("value"), F.lit(800.0)))
    out = heart.beats_of_day(e.select(F.col("user_id").alias("key"), F.to_date("ts").alias("day"), F.col("event_id").alias("recording_id"), rr.alias("rr")))
    return out.select("key", "day", "recording_id", F.round(F.col("rr")[0], 6).alias("first_rr"))


BEATS = """SELECT user_id AS key, CAST(ts AS DATE) AS day, min(event_id) AS recording_id, round(min_by(value, event_id), 6) AS first_rr FROM events WHERE floor(value) % 2 = 0 GROUP BY 1, 2"""


def hr_load_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, v = F.col("c_custkey"), F.col("c_acctbal")
    rows = fx.table(spark, sf_dir, "customer").select(key.alias("key"), (key % 4 > 0).alias("has_hr"), F.when(key % 3 > 0, v).alias("zonal"), F.when(key % 5 > 0, v + 1).alias("banister"))
    return heart.hr_load(rows, "banister")


HR_LOAD = """WITH c AS (SELECT c_custkey AS key, CASE WHEN c_custkey % 4 > 0 THEN CASE WHEN c_custkey % 5 > 0 THEN 'banister' WHEN c_custkey % 3 > 0 THEN 'zonal' END END AS load_model, c_acctbal AS v FROM customer)
SELECT key, CASE load_model WHEN 'banister' THEN v + 1 WHEN 'zonal' THEN v END AS load, load_model, CASE WHEN load_model = 'zonal' THEN 'banister' END AS requested_load_model, coalesce(load_model = 'zonal', false) AS load_model_substituted FROM c"""


def identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Policy versions, job ids, wall clocks and chart places of orders, among them those around the clocks' changes."""
    o, key = fx.table(spark, sf_dir, "orders"), F.col("o_orderkey")
    policy = F.struct(F.col("o_orderpriority").alias("class"), F.col("o_custkey").alias("owner"))
    return o.select(
        key, scalars.policy_version(policy).alias("policy_version"), scalars.job_id(F.concat(F.lit("order-"), key.cast("string"))).alias("job_id"),
        scalars.wall_clock(F.col("o_orderdate") + F.make_dt_interval(hours=(key % 24).cast("int")), F.lit("Europe/Berlin")).alias("wall"), scalars.base_axis("distance", key, F.when(key % 2 == 0, F.col("o_totalprice"))).alias("place"),
    )


IDENTIFIERS = """WITH o AS (SELECT *, sha256('order-' || o_orderkey) AS h FROM orders)
SELECT o_orderkey, 'v1:' || substr(sha256('{"class":"' || o_orderpriority || '","owner":' || o_custkey || '}'), 1, 16) AS policy_version,
substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-8' || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS job_id,
strftime((o_orderdate + to_hours(CAST(o_orderkey % 24 AS INTEGER))) AT TIME ZONE 'UTC' AT TIME ZONE 'Europe/Berlin', '%Y-%m-%dT%H:%M:%S') AS wall, CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice ELSE CAST(o_orderkey AS DOUBLE) END AS place FROM o"""


def suite_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as trials of the cases that orders are, in suites by return flag."""
    t = fx.table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("suite"), F.col("l_orderkey").alias("case_id"), (F.col("l_quantity") > 5).alias("passed"))
    return serve.pass_rates(t, ["suite"]).select("suite", "cases", "trials", F.round("pass_all", 6).alias("pass_all"), F.round("pass_rate", 6).alias("pass_rate"), "passed")


SUITES = """WITH c AS (SELECT l_returnflag AS suite, l_orderkey, bool_and(l_quantity > 5) AS a, count(*) AS n, count(*) FILTER (WHERE l_quantity > 5) AS ok FROM lineitem GROUP BY 1, 2)
SELECT suite, count(*) AS cases, CAST(sum(n) AS BIGINT) AS trials, round(count(*) FILTER (WHERE a) / count(*), 6) AS pass_all, round(sum(ok) / sum(n), 6) AS pass_rate, bool_and(a) AS passed FROM c GROUP BY 1"""


def readiness_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, v = F.col("c_custkey"), F.col("c_acctbal")
    rows = fx.table(spark, sf_dir, "customer").select(
        key.alias("key"), F.when(key % 8 > 0, v / 100 - 20).alias("form"), (key % 50 + 30).cast("double").alias("hrv_rmssd"), F.when(key % 3 > 0, 60.0).alias("hrv_baseline"),
        F.when(key % 4 == 0, "GO").when(key % 4 == 1, "MAINTAIN").when(key % 4 == 2, "EASE").otherwise("REST").alias("verdict"),
    )
    return serve.readiness_consistent(rows)


CONSISTENT = """WITH c AS (SELECT c_custkey AS key, CASE WHEN c_custkey % 8 > 0 THEN c_acctbal / 100 - 20 END AS f, c_custkey % 3 > 0 AND c_custkey % 50 + 30 < 54 AS low, c_custkey % 4 AS given FROM customer)
SELECT key, coalesce(given = least(CASE WHEN f > 5 THEN 0 WHEN f >= -10 THEN 1 WHEN f >= -20 THEN 2 WHEN f IS NOT NULL THEN 3 END + CAST(low AS INT), CASE WHEN f IS NOT NULL THEN 3 END), false) AS consistent FROM c"""


def ensured_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as stored rows; orders name them, and some that aren't there yet."""
    stored = fx.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"))
    wanted = fx.table(spark, sf_dir, "orders").select((F.col("o_custkey") + F.when(F.col("o_orderkey") % 10 == 0, 500_000).otherwise(0)).alias("key"), F.col("o_orderpriority").alias("name"))
    return lifecycle.ensured(stored, wanted, ["key"])


ENSURED = """SELECT c_custkey AS key, c_name AS name FROM customer UNION ALL SELECT o_custkey + 500000, min(o_orderpriority) FROM orders WHERE o_orderkey % 10 = 0 AND o_custkey + 500000 NOT IN (SELECT c_custkey FROM customer) GROUP BY 1
UNION ALL SELECT o_custkey, min(o_orderpriority) FROM orders WHERE o_orderkey % 10 <> 0 AND o_custkey NOT IN (SELECT c_custkey FROM customer) GROUP BY 1"""


def polymorphic_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as children of orders or of parts; those of one customer's orders and of one brand's parts."""
    li = fx.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_extendedprice", F.when(F.col("l_linenumber") % 2 == 0, "order").otherwise("part").alias("parent_kind"))
    orders = fx.table(spark, sf_dir, "orders").where("o_custkey % 20 = 7")
    parts = fx.table(spark, sf_dir, "part").where("p_brand = 'Brand#11'")
    return lifecycle.owned_by_either(li, [(orders, "order", "o_orderkey", "l_orderkey"), (parts, "part", "p_partkey", "l_partkey")])


CHILDREN = """SELECT DISTINCT l_orderkey, l_partkey, l_linenumber, l_extendedprice, CASE WHEN l_linenumber % 2 = 0 THEN 'order' ELSE 'part' END AS parent_kind FROM lineitem
WHERE (l_linenumber % 2 = 0 AND l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_custkey % 20 = 7)) OR (l_linenumber % 2 = 1 AND l_partkey IN (SELECT p_partkey FROM part WHERE p_brand = 'Brand#11'))"""


def blob_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files; equal texts are one blob."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("path"), F.coalesce("text", F.lit("")).cast("binary").alias("content"))
    return blobs.manifest(d)


MANIFEST = """WITH d AS (SELECT lpad(CAST(doc_id AS VARCHAR), 12, '0') AS path, coalesce(text, '') AS t FROM documents)
SELECT sha256(t) AS ref, substr(sha256(t), 1, 2) AS shard, CAST(max(octet_length(encode(t))) AS BIGINT) AS n_bytes, count(*) AS copies, min(path) AS path FROM d GROUP BY 1, 2"""

QUERIES = {f.__name__: f for f in (hrv_fallback, hrv_baseline, beats_of_day, hr_load_model, identifiers, suite_rates, readiness_check, ensured_rows, polymorphic_children, blob_manifest)}
ORACLE = {
    "hrv_fallback": FALLBACK, "hrv_baseline": BASELINE, "beats_of_day": BEATS, "hr_load_model": HR_LOAD, "identifiers": IDENTIFIERS, "suite_rates": SUITES, "readiness_check": CONSISTENT, "ensured_rows": ENSURED,
    "polymorphic_children": CHILDREN, "blob_manifest": MANIFEST,
}
