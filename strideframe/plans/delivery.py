"""Queries of incremental delivery, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strideframe.operators import gaps
from strideframe.sources import fixtures as fx


def _refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as references of suppliers; every fifth part has no hint of its last change."""
    return fx.table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("scope"), F.when(F.col("l_returnflag") == "R", "wellness").otherwise("activities").alias("stage"), F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice").alias("ref_id"),
        F.when(F.col("l_partkey") % 5 > 0, F.col("l_shipdate")).alias("hint"),
    )


REFS = """refs AS (SELECT l_suppkey AS scope, CASE WHEN l_returnflag = 'R' THEN 'wellness' ELSE 'activities' END AS stage, concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS ref_id,
  CASE WHEN l_partkey % 5 > 0 THEN l_shipdate END AS hint FROM lineitem)"""


def _marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """High waters of suppliers by return flag, a thousand days back from their last shipment; some have none."""
    li = fx.table(spark, sf_dir, "lineitem").where("l_suppkey % 4 > 0 AND (l_suppkey % 3 > 0 OR l_returnflag <> 'A')")
    return li.groupBy(F.col("l_suppkey").alias("scope"), F.col("l_returnflag").alias("gbo_type")).agg((F.max("l_shipdate") - F.expr("interval 1000 days")).alias("high_water_at"))


MARKS = """marks AS (SELECT l_suppkey AS scope, l_returnflag AS gbo_type, max(l_shipdate) - INTERVAL 1000 DAYS AS high_water_at FROM lineitem WHERE l_suppkey % 4 > 0 AND (l_suppkey % 3 > 0 OR l_returnflag <> 'A') GROUP BY 1, 2)"""


def discovery_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = _marks(spark, sf_dir).groupBy("scope").agg(F.min("high_water_at").alias("high_water_at"))
    return gaps.to_fetch(_refs(spark, sf_dir), marks, ["scope"]).select("scope", "stage", "ref_id")


DISCOVER = f"WITH {REFS}, {MARKS}, m AS (SELECT scope, min(high_water_at) AS mark FROM marks GROUP BY 1) SELECT r.scope, stage, ref_id FROM refs r LEFT JOIN m ON m.scope = r.scope WHERE hint IS NULL OR mark IS NULL OR hint > mark"


def discovery_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gaps.pages(_refs(spark, sf_dir), ("activities", "wellness"), 50).select("scope", "ref_id", "cursor", "next_cursor")


PAGES = f"""WITH {REFS}, p AS (SELECT scope, stage, ref_id, CAST(floor((row_number() OVER (PARTITION BY scope, stage ORDER BY ref_id) - 1) / 50) * 50 AS BIGINT) AS o FROM refs),
l AS (SELECT scope, stage, max(o) AS last FROM p GROUP BY 1, 2), n AS (SELECT scope, stage, last, lead(stage) OVER (PARTITION BY scope ORDER BY stage) AS ahead FROM l)
SELECT p.scope, ref_id, p.stage || ':' || o AS cursor, CASE WHEN o < last THEN p.stage || ':' || (o + 50) WHEN ahead IS NOT NULL THEN ahead || ':0' END AS next_cursor FROM p JOIN n ON n.scope = p.scope AND n.stage = p.stage"""


def _failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items, all of which failed: single ones by their token, or their whole week."""
    li, part = fx.table(spark, sf_dir, "lineitem"), F.col("l_partkey")
    day = F.date_trunc("week", "l_shipdate")
    return li.select(
        F.col("l_suppkey").alias("scope"), F.col("l_returnflag").alias("gbo_type"), F.when(part % 9 == 0, "schema_mismatch").otherwise("fetch_failed").alias("reason"), F.when(part % 2 == 0, F.concat_ws("-", "l_orderkey", "l_linenumber")).alias("token"),
        day.alias("window_start"), (day + F.expr("interval 7 days")).alias("window_end"), "l_orderkey", "l_linenumber", part,
    )


FAILURES = """failures AS (SELECT l_suppkey AS scope, l_returnflag AS gbo_type, CASE WHEN l_partkey % 9 = 0 THEN 'schema_mismatch' ELSE 'fetch_failed' END AS reason, CASE WHEN l_partkey % 2 = 0 THEN l_orderkey || '-' || l_linenumber END AS token,
  date_trunc('week', l_shipdate) AS a, date_trunc('week', l_shipdate) + INTERVAL 7 DAYS AS b FROM lineitem),
open AS (SELECT scope, gbo_type, reason, reason <> 'schema_mismatch' AS transient, CASE WHEN token IS NULL THEN CAST(epoch(a) AS BIGINT) END AS from_s, CASE WHEN token IS NULL THEN CAST(epoch(b) AS BIGINT) END AS to_s, token FROM failures)"""


def gaps_opened(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = gaps.open_gaps(_failures(spark, sf_dir))
    return out.select("scope", "gbo_type", "reason", "transient", F.unix_timestamp("range_start_at").alias("from_s"), F.unix_timestamp("range_end_at").alias("to_s"), F.col("start_token").alias("token"))


OPENED = f"WITH {FAILURES} SELECT * FROM open"


def gaps_closed_by_token(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What landed later: line items of every second order."""
    landed = fx.table(spark, sf_dir, "lineitem").where("l_orderkey % 2 = 0").select(F.col("l_suppkey").alias("scope"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("token"))
    out = gaps.close_by_token(gaps.open_gaps(_failures(spark, sf_dir)), landed)
    return out.select("scope", "gbo_type", "reason", F.col("start_token").alias("token"), "closed")


BY_TOKEN = f"""WITH {FAILURES}, l AS (SELECT DISTINCT l_suppkey AS scope, l_orderkey || '-' || l_linenumber AS token FROM lineitem WHERE l_orderkey % 2 = 0)
SELECT o.scope, gbo_type, reason, o.token, transient AND l.token IS NOT NULL AS closed FROM open o LEFT JOIN l ON l.scope = o.scope AND l.token = o.token"""


def window_narrowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each supplier's window from 1995 to mid-1997, with the range it covers once it is synced."""
    windows = fx.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("scope"), F.to_date(F.lit("1995-01-01")).alias("oldest"), F.to_date(F.lit("1997-06-30")).alias("newest"))
    out = gaps.narrowed(windows, _marks(spark, sf_dir), ["scope"])
    low, high = gaps.synced_range(F.col("oldest"), F.col("newest"))
    return out.select("scope", "oldest", "newest", F.unix_timestamp(low).alias("from_s"), F.unix_timestamp(high).alias("to_s"))


NARROWED = f"""WITH {MARKS}, m AS (SELECT scope, min(high_water_at) AS mark FROM marks GROUP BY 1), w AS (SELECT s_suppkey AS scope, least(greatest(DATE '1995-01-01', coalesce(CAST(mark AS DATE), DATE '1995-01-01')), DATE '1997-06-30') AS oldest,
DATE '1997-06-30' AS newest FROM supplier LEFT JOIN m ON m.scope = s_suppkey)
SELECT scope, oldest, newest, CAST(epoch(CAST(oldest AS TIMESTAMP)) AS BIGINT) AS from_s, CAST(epoch(CAST(newest + 1 AS TIMESTAMP)) AS BIGINT) - 1 AS to_s FROM w"""


def freshness_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.events(spark, sf_dir).select("user_id", F.when(F.col("user_id") % 10 > 0, F.col("ts")).alias("observed_at"))
    return gaps.freshness(rows, F.lit("2024-01-29").cast("timestamp"), ["user_id"])


LAG = """SELECT user_id, CASE WHEN user_id % 10 > 0 THEN greatest(0, CAST(epoch(TIMESTAMP '2024-01-29') AS BIGINT) - CAST(floor(epoch(max(ts))) AS BIGINT)) END AS lag_s FROM events GROUP BY 1"""


def backfill_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as chunks of customers' backfills: the oldest are committed, urgent ones fail."""
    o = fx.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("chunk"), (F.col("o_orderdate") < F.lit("1995-06-01").cast("timestamp")).alias("committed"), (F.col("o_orderpriority") != "1-URGENT").alias("ok"))
    return gaps.backfill_state(o.drop("ok"), o.select("key", "chunk", "ok"))


BACKFILL = """WITH o AS (SELECT o_custkey AS key, o_orderkey AS chunk, o_orderdate < TIMESTAMP '1995-06-01' AS committed, o_orderdate < TIMESTAMP '1995-06-01' OR o_orderpriority <> '1-URGENT' AS ok FROM orders),
s AS (SELECT *, coalesce(bool_or(NOT ok) OVER (PARTITION BY key ORDER BY chunk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS stopped FROM o)
SELECT key, chunk, committed, CASE WHEN committed THEN 'skipped' WHEN stopped THEN 'pending' WHEN ok THEN 'done' ELSE 'failed' END AS status FROM s"""


def run_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*(F.lit(x) for x in ("persisted", "failed", "quarantined", "advanced", "closed")))
    rows = fx.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("run_id"), F.get(names, F.pmod("l_partkey", F.lit(9)).cast("int") % 5).alias("outcome"))
    return gaps.run_counters(rows)


COUNTERS = """WITH r AS (SELECT l_orderkey AS run_id, l_partkey % 9 % 5 AS o FROM lineitem), c AS (SELECT run_id, count(*) FILTER (WHERE o = 0) AS persisted, count(*) FILTER (WHERE o = 1) AS failed, count(*) FILTER (WHERE o = 2) AS quarantined,
count(*) FILTER (WHERE o = 3) AS advanced, count(*) FILTER (WHERE o = 4) AS closed FROM r GROUP BY 1) SELECT *, failed > 0 OR quarantined > 0 AS degraded FROM c"""


def retry_waits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as attempts of their order's request."""
    li = fx.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("request_id"), F.col("l_linenumber").alias("attempt")).agg(F.min("l_partkey").alias("p"), F.min("l_discount").alias("draw"))
    rows = li.select("request_id", "attempt", F.when(F.col("p") % 4 == 0, 200).when(F.col("p") % 4 == 1, 404).when(F.col("p") % 4 == 2, 429).otherwise(503).alias("status"), F.when(F.col("p") % 8 == 2, 3.0).alias("retry_after_s"), (F.col("draw") * 10).alias("draw"))
    return gaps.retry_waits(rows, 0.5, 30.0, 20.0, 6).select("request_id", "attempt", "status", F.round("wait_s", 6).alias("wait_s"))


RETRY = """WITH a AS (SELECT l_orderkey AS request_id, l_linenumber AS attempt, min(l_partkey) AS p, min(l_discount) * 10 AS draw FROM lineitem GROUP BY 1, 2),
w AS (SELECT request_id, attempt, CASE p % 4 WHEN 0 THEN 200 WHEN 1 THEN 404 WHEN 2 THEN 429 ELSE 503 END AS status,
CASE WHEN p % 4 >= 2 AND attempt + 1 < 6 THEN CASE WHEN p % 8 = 2 THEN 3.0 ELSE least(0.5 * 2.0 ** attempt, 30.0) * draw END END AS w FROM a),
s AS (SELECT *, sum(w) OVER (PARTITION BY request_id ORDER BY attempt) AS so_far FROM w) SELECT request_id, attempt, status, CASE WHEN so_far <= 20 THEN round(w, 6) END AS wait_s FROM s"""

QUERIES = {f.__name__: f for f in (discovery_refs, discovery_pages, gaps_opened, gaps_closed_by_token, window_narrowing, freshness_lag, backfill_run, run_counters, retry_waits)}
ORACLE = {
    "discovery_refs": DISCOVER, "discovery_pages": PAGES, "gaps_opened": OPENED, "gaps_closed_by_token": BY_TOKEN, "window_narrowing": NARROWED, "freshness_lag": LAG, "backfill_run": BACKFILL, "run_counters": COUNTERS, "retry_waits": RETRY,
}
