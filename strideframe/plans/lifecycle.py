"""Queries of record lifecycles and scalar rules, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strideframe.functions import scalars
from strideframe.operators import lifecycle, load, power
from strideframe.plans import metrics
from strideframe.sources import fixtures as fx


def session_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items of a supplier on one day as recordings: sessions by the ordered matching rule."""
    li = fx.table(spark, sf_dir, "lineitem")
    start = (F.unix_timestamp("l_shipdate") + F.col("l_partkey") % 900).cast("timestamp")
    rows = li.select(F.col("l_suppkey").alias("athlete"), F.col("l_returnflag").alias("sport"), F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice").alias("id"), start.alias("start"), (F.col("l_quantity") * 10).alias("duration_s"), F.when(F.col("l_partkey") % 40 == 0, F.col("l_orderkey")).alias("fingerprint"))
    return lifecycle.identities(rows).select("athlete", "sport", "id", "session_id")


#: Recordings one after the other, with the openers within reach carried as a list.
IDENTITY = """WITH RECURSIVE r AS (SELECT l_suppkey AS athlete, l_returnflag AS sport, concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS id, CAST(epoch(l_shipdate) AS BIGINT) + l_partkey % 900 AS s, l_quantity * 10 AS d,
  CASE WHEN l_partkey % 40 = 0 THEN l_orderkey END AS fp FROM lineitem),
f AS (SELECT *, CASE WHEN fp IS NULL THEN id ELSE first_value(id) OVER (PARTITION BY athlete, sport, fp ORDER BY s, id) END AS head FROM r),
h AS (SELECT *, row_number() OVER (PARTITION BY athlete, sport ORDER BY s, id) AS n FROM f WHERE head = id),
w AS (SELECT athlete, sport, n, id, id AS session, [{'s': s, 'd': d, 'id': id}] AS opened FROM h WHERE n = 1
  UNION ALL SELECT athlete, sport, n, id, coalesce(m, id), CASE WHEN m IS NULL THEN list_append(near, {'s': s, 'd': d, 'id': id}) ELSE near END FROM
    (SELECT *, list_filter(near, lambda x: abs(x.d - d) <= greatest(60, 0.05 * greatest(x.d, d)))[1].id AS m FROM
      (SELECT h.athlete, h.sport, h.n, h.id, h.s, h.d, list_filter(w.opened, lambda x: h.s - x.s <= 120) AS near FROM w JOIN h ON h.athlete = w.athlete AND h.sport = w.sport AND h.n = w.n + 1)))
SELECT f.athlete, f.sport, f.id, w.session AS session_id FROM f JOIN w ON w.athlete = f.athlete AND w.sport = f.sport AND w.id = f.head"""


def never_regress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored against incoming channels of each order."""
    c = fx.candidates(spark, sf_dir)
    pick = lambda keep: c.where(keep).groupBy("key").agg(F.max_by("tier", F.struct("price", "native")).alias("tier"), F.max_by("source", F.struct("price", "native")).alias("source"))
    return lifecycle.kept_channels(pick("line <= 3"), pick("line > 3"), ["key"])


REGRESS = f"""WITH {fx.CANDIDATES}, r AS (SELECT *, CASE tier WHEN 'raw_stream' THEN 0 WHEN 'platform_computed' THEN 2 ELSE 4 END AS k FROM candidates),
a AS (SELECT DISTINCT ON (key) key, tier, source, k FROM r WHERE line <= 3 ORDER BY key, price DESC, native DESC), b AS (SELECT DISTINCT ON (key) key, tier, source, k FROM r WHERE line > 3 ORDER BY key, price DESC, native DESC)
SELECT coalesce(a.key, b.key) AS key, CASE WHEN b.key IS NULL OR b.k > a.k THEN a.tier ELSE b.tier END AS tier, CASE WHEN b.key IS NULL OR b.k > a.k THEN a.source ELSE b.source END AS source FROM a FULL JOIN b ON a.key = b.key"""


def erasure_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that stay and go in each table when the customers of one nation are erased."""
    t = lambda n: spark.read.parquet(f"{sf_dir}/{n}.parquet")
    tables = {"customer": t("customer").select("c_custkey", "c_nationkey"), "orders": t("orders").select("o_orderkey", "o_custkey"), "lineitem": t("lineitem").select("l_orderkey", "l_linenumber")}
    parents = {"orders": ("customer", "o_custkey", "c_custkey"), "lineitem": ("orders", "l_orderkey", "o_orderkey")}
    out = None
    for name, (stay, go) in lifecycle.erased(tables, parents, t("nation").where("n_nationkey % 25 = 7").select(F.col("n_nationkey").alias("c_nationkey")), "c_nationkey").items():
        one = stay.select(F.lit(name).alias("table"), F.lit(0).alias("gone")).unionByName(go.select(F.lit(name).alias("table"), F.lit(1).alias("gone")))
        out = one if out is None else out.unionByName(one)
    return out.groupBy("table").agg(F.count_if(F.col("gone") == 0).alias("kept"), F.count_if(F.col("gone") == 1).alias("erased"))


ERASURE = """WITH c AS (SELECT c_custkey FROM customer WHERE c_nationkey = 7), o AS (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM c))
SELECT 'customer' AS "table", count(*) FILTER (c_nationkey <> 7) AS kept, count(*) FILTER (c_nationkey = 7) AS erased FROM customer
UNION ALL SELECT 'orders', count(*) FILTER (o_custkey NOT IN (SELECT c_custkey FROM c)), count(*) FILTER (o_custkey IN (SELECT c_custkey FROM c)) FROM orders
UNION ALL SELECT 'lineitem', count(*) FILTER (l_orderkey NOT IN (SELECT o_orderkey FROM o)), count(*) FILTER (l_orderkey IN (SELECT o_orderkey FROM o)) FROM lineitem"""


def retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = lifecycle.purged(fx.table(spark, sf_dir, "events"), "ts", F.to_timestamp(F.lit("2024-01-31")), 10)
    return kept.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_id"))


RETENTION = "SELECT event_type, count(*) AS n, min(event_id) AS first_id FROM events WHERE ts >= TIMESTAMP '2024-01-21' GROUP BY 1"


def recent_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = fx.events(spark, sf_dir)
    out = lifecycle.recent_summary(e, ["event_type"], "value", [F.desc("ts"), F.desc("event_id")], 128)
    return out.select("event_type", "n", F.round("total", 4).alias("total"), "p50", "p95")


SUMMARY = """WITH w AS (SELECT DISTINCT event_type, count(*) OVER k AS n, round(sum(value) OVER k, 4) AS total FROM events WINDOW k AS (PARTITION BY event_type)),
l AS (SELECT event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) <= 128),
q AS (SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95 FROM l GROUP BY 1) SELECT w.event_type, n, total, p50, p95 FROM w JOIN q ON w.event_type = q.event_type"""


def metric_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = fx.events(spark, sf_dir)
    return lifecycle.metric_lines(lifecycle.recent_summary(e, ["event_type"], "value", [F.desc("ts"), F.desc("event_id")], 128), "event_value", "event_type")


METRIC_TEXT = f"""WITH s AS ({SUMMARY}) SELECT 'event_value{{event_type="' || event_type || '",quantile="0.5"}} ' || printf('%.3f', p50) AS line FROM s
UNION ALL SELECT 'event_value{{event_type="' || event_type || '",quantile="0.95"}} ' || printf('%.3f', p95) FROM s UNION ALL SELECT 'event_value_sum{{event_type="' || event_type || '"}} ' || printf('%.3f', total) FROM s UNION ALL SELECT 'event_value_count{{event_type="' || event_type || '"}} ' || n FROM s"""


def rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user as requests of a bucket that refills one in six hours."""
    e = fx.events(spark, sf_dir).select("user_id", F.col("event_id").alias("id"), F.unix_timestamp("ts").cast("double").alias("at"))
    return lifecycle.token_bucket(e, ["user_id"], "at", 1 / 21600, 3.0).select("user_id", "id", "admitted")


LIMIT = """WITH RECURSIVE e AS (SELECT user_id, event_id AS id, CAST(floor(epoch(ts)) AS DOUBLE) AS s, row_number() OVER (PARTITION BY user_id ORDER BY floor(epoch(ts)), event_id) AS i FROM events),
b AS (SELECT user_id, CAST(0 AS BIGINT) AS id, CAST(0 AS DOUBLE) AS s, CAST(0 AS BIGINT) AS i, CAST(3 AS DOUBLE) AS level, false AS admitted FROM (SELECT DISTINCT user_id FROM e)
UNION ALL SELECT user_id, id, s, i, CASE WHEN room >= 1 THEN room - 1 ELSE room END, room >= 1
FROM (SELECT e.user_id, e.id, e.s, e.i, CASE WHEN b.i = 0 THEN 3.0::DOUBLE ELSE least(3.0::DOUBLE, level + (e.s - b.s) * (1.0::DOUBLE / 21600)) END AS room FROM b JOIN e ON e.user_id = b.user_id AND e.i = b.i + 1))
SELECT user_id, id, admitted FROM b WHERE i > 0"""


def context_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of a conversation, the longest words first, within a budget of characters."""
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", F.col("turn").alias("id"), (F.length("text") % 97).cast("double").alias("relevance"), F.length("text").cast("long").alias("tokens"))
    return lifecycle.greedy_context(c, ["conv_id"], 600)


PICK = """WITH RECURSIVE c AS (SELECT conv_id, turn AS id, CAST(length(text) % 97 AS DOUBLE) AS relevance, length(text) AS tokens, row_number() OVER (PARTITION BY conv_id ORDER BY length(text) % 97 DESC, turn) AS i FROM conversations),
p AS (SELECT conv_id, CAST(0 AS BIGINT) AS id, CAST(0 AS DOUBLE) AS relevance, CAST(0 AS BIGINT) AS tokens, CAST(0 AS BIGINT) AS i, CAST(600 AS BIGINT) AS room, false AS taken FROM (SELECT DISTINCT conv_id FROM c)
UNION ALL SELECT c.conv_id, c.id, c.relevance, c.tokens, c.i, CASE WHEN c.tokens <= room THEN room - c.tokens ELSE room END, c.tokens <= room FROM p JOIN c ON c.conv_id = p.conv_id AND c.i = p.i + 1)
SELECT conv_id, id, relevance, tokens FROM p WHERE taken"""


def scalar_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = fx.events(spark, sf_dir)
    k = F.col("k").cast("double")
    return e.select(
        "event_id", F.round(scalars.rpe(k * 1.5, F.col("user_id") % 2 == 0), 6).alias("rpe"), scalars.feel(k / 2).alias("feel"), scalars.sport_code(F.concat(F.lit(" "), F.when(F.col("k") % 3 == 0, "Run").when(F.col("k") % 3 == 1, "RIDE"))).alias("sport"),
        scalars.duration_label(F.col("k") * 30).alias("label"), scalars.trend_word(F.lit(50.0), k + 0.01).alias("trend"), scalars.day_label(F.to_date("ts")).alias("day"), F.round(scalars.step_target(k, F.when(F.col("k") % 4 > 0, F.col("value"))), 5).alias("target"),
        F.round(scalars.backoff(k % 8, 0.5, 30.0), 6).alias("backoff"), F.round(scalars.closeness(k * 100), 6).alias("closeness"), scalars.finite_or_null(F.when(F.col("k") % 5 > 0, F.col("k").cast("string")).otherwise("NaN")).alias("number"),
    )


SCALARS = """WITH e AS (SELECT *, CAST(regexp_extract(props, '[0-9]+') AS INT) AS k FROM events)
SELECT event_id, round(CASE WHEN user_id % 2 = 0 THEN CASE WHEN k = 0 THEN 0.0 WHEN k * 1.5 BETWEEN 10 AND 100 THEN k * 1.5 / 10 END WHEN k * 1.5 <= 10 THEN k * 1.5 END, 6)::DOUBLE AS rpe,
CASE WHEN k % 2 = 0 AND k BETWEEN 2 AND 10 THEN CAST(k // 2 AS INT) END AS feel, CASE k % 3 WHEN 0 THEN 'running' WHEN 1 THEN 'cycling' ELSE 'other' END AS sport,
CASE WHEN k % 2 = 0 AND k > 0 THEN (k // 2) || ' min' ELSE (k * 30) || ' sec' END AS label, CASE WHEN abs(k + 0.01 - 50) < 0.05 THEN 'steady' WHEN k + 0.01 > 50 THEN 'rising' ELSE 'falling' END AS trend,
strftime(ts, '%b %-d') AS day, round(CASE WHEN k % 4 > 0 THEN k * value / 100 END, 5) AS target, CAST(least(0.5 * pow(2, k % 8), 30) AS DOUBLE) AS backoff, round(greatest(0, 1 - k * 100 / 7200.0)::DOUBLE, 6) AS closeness,
CASE WHEN k % 5 > 0 THEN CAST(k AS DOUBLE) END AS number FROM e"""


def coverage_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily coverage of the load, and the coverage state of each user's normalized power."""
    np_ = power.normalized_power(fx.short_stream(spark, sf_dir)).select("key", scalars.coverage_state(F.col("reason")).alias("state"))
    days = load.daily_grid(fx.daily_loads(spark, sf_dir)).groupBy("key").agg(F.round(100 * F.count("load") / F.count(F.lit(1)), 1).alias("load_pct"), F.count_if("loaded").alias("loaded_days"))
    return np_.join(days, "key")


COVERAGE = f"""WITH {fx.DAILY}, {metrics._NP}, s AS (SELECT key, CAST(max(day) - min(day) + 1 AS DOUBLE) AS n, count(*) FILTER (load IS NULL) AS miss, count(*) AS days FROM daily GROUP BY 1)
SELECT np.key, CASE WHEN reason IS NULL THEN 'present' ELSE 'absent_true' END AS state, round(100 * (n - miss) / n, 1) AS load_pct, days AS loaded_days FROM np JOIN s ON np.key = s.key"""

QUERIES = {f.__name__: f for f in (session_identity, never_regress, erasure_counts, retention, recent_summary, metric_text, rate_limit, context_pick, scalar_rules, coverage_states)}
ORACLE = {
    "session_identity": IDENTITY, "never_regress": REGRESS, "erasure_counts": ERASURE, "retention": RETENTION, "recent_summary": SUMMARY, "metric_text": METRIC_TEXT, "rate_limit": LIMIT, "context_pick": PICK, "scalar_rules": SCALARS, "coverage_states": COVERAGE,
}
