"""Queries of time joins and of conflict resolution, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strideframe.functions import scalars
from strideframe.operators import resolve, temporal
from strideframe.sources import fixtures as fx


def signature_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line item with its customer's threshold in effect on the shipping day, unless its fit is rejected."""
    items = fx.table(spark, sf_dir, "lineitem").join(fx.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("key")), "l_orderkey")
    probes = items.select("key", "l_orderkey", "l_linenumber", "l_partkey", F.to_date("l_shipdate").alias("day"))
    out = temporal.as_of(probes, fx.signatures(spark, sf_dir), ["key"], "day", "effective_date", ["ftp_w"], F.col("fit_r2") >= 0.2)
    return out.select("key", "l_orderkey", "l_linenumber", "l_partkey", "day", "effective_date", F.round("ftp_w", 6).alias("ftp_w"))


ASOF = f"""WITH {fx.SIGNATURES}, p AS (SELECT o_custkey AS key, l_orderkey, l_linenumber, l_partkey, CAST(l_shipdate AS DATE) AS day FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT p.key, l_orderkey, l_linenumber, l_partkey, day, CASE WHEN fit_r2 >= 0.2 THEN effective_date END AS effective_date, round(CASE WHEN fit_r2 >= 0.2 THEN ftp_w END, 6) AS ftp_w
FROM p ASOF LEFT JOIN signatures s ON p.key = s.key AND p.day >= s.effective_date"""


def identity_band_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of one customer's orders within seven days."""
    a = fx.activities(spark, sf_dir)
    out = temporal.band_join(a, a, ["athlete"], F.unix_timestamp("start"), F.unix_timestamp("start"), 7 * 86400, F.col("l.activity_id") < F.col("r.activity_id"))
    return out.select("athlete", F.col("l.activity_id").alias("left_id"), F.col("r.activity_id").alias("right_id"), (F.col("l.sport") == F.col("r.sport")).alias("same_sport"))


BAND = f"""WITH {fx.ACTIVITIES} SELECT a.athlete, a.activity_id AS left_id, b.activity_id AS right_id, a.sport = b.sport AS same_sport FROM activities a
JOIN activities b ON a.athlete = b.athlete AND a.activity_id < b.activity_id AND abs(floor(epoch(a.start)) - floor(epoch(b.start))) <= 604800"""


def session_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items of one supplier taken as recordings that may be one session."""
    li = fx.table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("athlete"), F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey").alias("id"), F.col("l_shipdate").alias("start"), F.col("l_returnflag").alias("sport"),
        (F.col("l_quantity") * 100).alias("duration_s"), F.when(F.col("l_partkey") % 50 == 0, F.col("l_partkey")).alias("fingerprint"),
    )
    out = temporal.band_join(li, li, ["athlete"], F.unix_timestamp("start"), F.unix_timestamp("start"), 7200, (F.col("l.id") < F.col("r.id")) & temporal.same_session())
    return out.select("athlete", F.col("l.id").alias("left_id"), F.col("r.id").alias("right_id"))


SESSIONS = """WITH r AS (SELECT l_suppkey AS athlete, concat_ws('-', l_orderkey, l_linenumber, l_partkey) AS id, floor(epoch(l_shipdate)) AS start, l_returnflag AS sport, l_quantity * 100 AS d,
CASE WHEN l_partkey % 50 = 0 THEN l_partkey END AS f FROM lineitem)
SELECT a.athlete, a.id AS left_id, b.id AS right_id FROM r a JOIN r b ON a.athlete = b.athlete AND a.id < b.id AND abs(a.start - b.start) <= 7200 AND a.sport = b.sport
AND (coalesce(a.f = b.f, false) OR (abs(a.start - b.start) <= 120 AND abs(a.d - b.d) <= greatest(60, 0.05 * greatest(a.d, b.d))))"""


def gap_self_heal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps (line items of a supplier, two days each) that a synced range (three days from other shipments) covers."""
    li = fx.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("scope"), "l_orderkey", "l_linenumber", "l_partkey", F.to_date("l_shipdate").alias("day"))
    gaps = li.where("l_partkey % 4 = 0").select("scope", "l_orderkey", "l_linenumber", "l_partkey", F.col("day").alias("gap_start"), F.date_add("day", 2).alias("gap_end"))
    ranges = li.where("l_partkey % 4 <> 0").select("scope", F.date_sub("day", 1).alias("range_start"), F.date_add("day", 2).alias("range_end"))
    out = temporal.contained(gaps, ranges, ["scope"])
    return out.select("scope", "l_orderkey", "l_linenumber", "l_partkey", "gap_start", "closed", "closed_by")


HEAL = """WITH li AS (SELECT l_suppkey AS scope, l_orderkey, l_linenumber, l_partkey, CAST(l_shipdate AS DATE) AS day FROM lineitem),
r AS (SELECT scope, day - 1 AS a, day + 2 AS b FROM li WHERE l_partkey % 4 <> 0), m AS (SELECT *, CASE WHEN a <= max(b) OVER (PARTITION BY scope ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS o FROM r),
s AS (SELECT *, sum(o) OVER (PARTITION BY scope ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS k FROM m), i AS (SELECT scope, min(a) AS a, max(b) AS b FROM s GROUP BY scope, k)
SELECT g.scope, l_orderkey, l_linenumber, l_partkey, g.day AS gap_start, i.scope IS NOT NULL AS closed, i.a AS closed_by FROM li g LEFT JOIN i ON g.scope = i.scope AND i.a <= g.day AND i.b >= g.day + 2 WHERE l_partkey % 4 = 0"""


def local_day_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Activity and load by athlete-local day, with the bounds of the day in UTC."""
    zone = F.when(F.col("user_id") % 3 == 0, "America/New_York").when(F.col("user_id") % 3 == 1, "Asia/Tokyo").otherwise("Europe/Berlin")
    rows = fx.events(spark, sf_dir).withColumn("zone", zone)
    days = rows.groupBy("user_id", "zone", temporal.local_day(F.col("ts"), F.col("zone")).alias("day")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("load"))
    low, high = temporal.day_bounds(F.col("day"), F.col("zone"))
    return days.select("user_id", "day", "n", "load", F.unix_timestamp(low).alias("from_s"), F.unix_timestamp(high).alias("to_s"))


LOCAL = """WITH e AS (SELECT *, CASE WHEN user_id % 3 = 0 THEN 'America/New_York' WHEN user_id % 3 = 1 THEN 'Asia/Tokyo' ELSE 'Europe/Berlin' END AS zone,
CASE WHEN user_id % 3 = 0 THEN -5 WHEN user_id % 3 = 1 THEN 9 ELSE 1 END AS shift FROM events), d AS (SELECT user_id, shift, CAST(ts + to_hours(shift) AS DATE) AS day, count(*) AS n, round(sum(value), 4) AS load FROM e GROUP BY 1, 2, 3)
SELECT user_id, day, n, load, CAST(epoch(CAST(day AS TIMESTAMP)) AS BIGINT) - 3600 * shift AS from_s, CAST(epoch(CAST(day + 1 AS TIMESTAMP)) AS BIGINT) - 3600 * shift AS to_s FROM d"""


def backfill_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's span of orders in pieces of 90 days."""
    spans = fx.activities(spark, sf_dir).groupBy(F.col("athlete").alias("key")).agg(F.min(F.to_date("start")).alias("first"), F.max(F.to_date("start")).alias("last"))
    return temporal.chunks(spans, 90)


CHUNKS = f"""WITH {fx.ACTIVITIES}, s AS (SELECT athlete AS key, min(CAST(start AS DATE)) AS a, max(CAST(start AS DATE)) AS b FROM activities GROUP BY 1)
SELECT key, CAST(i AS BIGINT) AS chunk, a + CAST(i * 90 AS INT) AS chunk_from, least(a + CAST(i * 90 + 89 AS INT), b) AS chunk_through FROM s, range(0, 200) r(i) WHERE a + CAST(i * 90 AS INT) <= b"""


def signature_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = temporal.intervals(fx.signatures(spark, sf_dir), ["key"], "effective_date")
    return out.select("key", "effective_date", "effective_to", F.round("ftp_w", 6).alias("ftp_w"))


INTERVALS = f"WITH {fx.SIGNATURES} SELECT key, effective_date, lead(effective_date) OVER (PARTITION BY key ORDER BY effective_date) AS effective_to, round(ftp_w, 6) AS ftp_w FROM signatures"


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.candidates(spark, sf_dir).withColumn("completeness", F.when(F.col("value") > 25, 2.0).otherwise(1.0))


def field_winner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The winning source of each (order, line), the rule that decided and whether sources disagree."""
    out = resolve.winners(_candidates(spark, sf_dir), ["key", "line"], ("native", "price"))
    return out.select("key", "line", F.col("w.source").alias("source"), F.col("w.tier").alias("tier"), F.round("w.value", 6).alias("value"), "rule", "n", "disputed")


WINNER = f"""WITH {fx.CANDIDATES}, c AS (SELECT *, CASE WHEN value > 25 THEN 2.0 ELSE 1.0 END AS comp, CASE tier WHEN 'raw_stream' THEN 0 WHEN 'platform_computed' THEN 2 ELSE 4 END AS rk FROM candidates),
r AS (SELECT *, row_number() OVER w AS rn, lead(rk) OVER w AS rk2, lead(confidence) OVER w AS c2, lead(observed) OVER w AS o2, lead(comp) OVER w AS p2, lead(source) OVER w AS s2 FROM c
  WINDOW w AS (PARTITION BY key, line ORDER BY rk, confidence DESC, observed DESC, comp DESC, source, native, price)),
g AS (SELECT key, line, count(*) AS n, max(value) AS hi, min(value) AS lo FROM c GROUP BY 1, 2)
SELECT r.key, r.line, source, tier, round(value, 6) AS value, CASE WHEN n = 1 THEN 'sole_contributor' WHEN rk <> rk2 THEN 'trust_tier' WHEN confidence <> c2 THEN 'confidence' WHEN observed <> o2 THEN 'recency'
WHEN comp <> p2 THEN 'completeness' ELSE 'stable_tiebreak' END AS rule, n, n >= 2 AND (hi - lo) / greatest(1.0, abs(hi)) > 0.05 AS disputed
FROM r JOIN g ON r.key = g.key AND r.line = g.line WHERE rn = 1"""


def field_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Value and price of each (order, line), each from the best source that has it."""
    rows = _candidates(spark, sf_dir).withColumns({"value": F.when(F.col("source") % 3 > 0, F.col("value")), "price": F.when(F.col("source") % 4 > 0, F.col("price"))})
    rows = rows.withColumn("ship", F.col("observed").cast("long"))
    out = resolve.resolve_fields(rows, ["key", "line"], ["value", "price"], ("native", "ship"))
    return out.select("key", "line", F.round("value", 4).alias("value"), "value_source", F.round("price", 4).alias("price"), "price_source")


def _field_sql(f: str, condition: str) -> str:
    return f"""SELECT key, line, {f}, source FROM c WHERE {condition} QUALIFY row_number() OVER (PARTITION BY key, line ORDER BY rk, confidence DESC, observed DESC, comp DESC, source, native, {f}) = 1"""


RESOLUTION = f"""WITH {fx.CANDIDATES}, c AS (SELECT *, CASE WHEN value > 25 THEN 2.0 ELSE 1.0 END AS comp, CASE tier WHEN 'raw_stream' THEN 0 WHEN 'platform_computed' THEN 2 ELSE 4 END AS rk FROM candidates),
v AS ({_field_sql('value', 'source % 3 > 0')}), p AS ({_field_sql('price', 'source % 4 > 0')}), k AS (SELECT DISTINCT key, line FROM c)
SELECT k.key, k.line, round(v.value, 4) AS value, v.source AS value_source, round(p.price, 4) AS price, p.source AS price_source FROM k LEFT JOIN v USING (key, line) LEFT JOIN p USING (key, line)"""


def effective_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each supplier's tier for two channels under layered preferences."""
    s = fx.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("source"), F.explode(F.array(F.lit("power"), F.lit("hr"))).alias("channel"))
    own = F.when((F.col("source") % 5 == 0) & (F.col("channel") == "power"), "raw_stream")
    wild = F.when(F.col("source") % 7 == 0, "summary_only")
    profile = F.when(F.col("source") % 2 == 0, F.when(F.col("source") % 4 == 0, "absent_true").otherwise("device_computed"))
    return s.select("source", "channel", resolve.effective_tier(own, wild, profile).alias("tier"))


TIER = """SELECT s_suppkey AS source, channel, CASE WHEN s_suppkey % 5 = 0 AND channel = 'power' THEN 'raw_stream' WHEN s_suppkey % 7 = 0 THEN 'summary_only'
WHEN s_suppkey % 2 = 0 AND s_suppkey % 4 <> 0 THEN 'device_computed' ELSE 'platform_computed' END AS tier FROM supplier, (VALUES ('power'), ('hr')) c(channel)"""


def current_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resolve.current_version(_candidates(spark, sf_dir), ["key", "source"], [F.desc("observed"), F.col("line"), F.col("native"), F.col("price")])
    return out.select("key", "source", "line", "native", F.round("value", 6).alias("value"))


CURRENT = f"""WITH {fx.CANDIDATES} SELECT key, source, line, native, round(value, 6) AS value FROM candidates QUALIFY row_number() OVER (PARTITION BY key, source ORDER BY observed DESC, line, native, price) = 1"""


def quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sound and rejected candidates by the first rule that each breaks."""
    rules = [resolve.out_of_range("value", 2, 45), ("MONOTONIC:line", F.col("line") > 5), resolve.out_of_range("price", 1000, 90000), resolve.out_of_range("confidence", 0.92, 1)]
    rows = _candidates(spark, sf_dir).withColumn("rule", resolve.first_violation(rules))
    return rows.groupBy("rule").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("value"))


QUARANTINE = f"""WITH {fx.CANDIDATES} SELECT CASE WHEN value NOT BETWEEN 2 AND 45 THEN 'RANGE:value' WHEN line > 5 THEN 'MONOTONIC:line' WHEN price NOT BETWEEN 1000 AND 90000 THEN 'RANGE:price'
WHEN confidence NOT BETWEEN 0.92 AND 1 THEN 'RANGE:confidence' END AS rule, count(*) AS n, round(sum(value), 4) AS value FROM candidates GROUP BY 1"""


def tombstones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders that still have a contributor after tombstones, superseding, quarantine and inactive sources."""
    rows = _candidates(spark, sf_dir).withColumns({"is_superseded": F.col("native") % 11 == 0, "is_tombstone": F.lit(False), "quarantine_rule": F.when(F.col("value") > 45, F.lit("RANGE:value"))})
    sources = fx.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("source"), (F.col("s_acctbal") > 0).alias("is_active"))
    dead = fx.table(spark, sf_dir, "orders").where("o_orderstatus = 'F' AND o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("key"))
    left = resolve.contributing(resolve.without_tombstones(rows, dead, ["key"]), sources)
    return left.groupBy("key").agg(F.count(F.lit(1)).alias("contributors"), F.round(F.sum("value"), 4).alias("value"))


TOMBSTONES = f"""WITH {fx.CANDIDATES} SELECT key, count(*) AS contributors, round(sum(value), 4) AS value FROM candidates WHERE native % 11 <> 0 AND value <= 45
AND source IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0) AND key NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 3 = 0) GROUP BY 1"""


def upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer balances after an upsert of the totals of their orders; the last order of a batch counts."""
    stored = fx.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("balance"))
    batch = fx.table(spark, sf_dir, "orders").select((F.col("o_custkey") + F.when(F.col("o_orderkey") % 25 == 0, 1_000_000).otherwise(0)).alias("key"), F.col("o_totalprice").alias("balance"), F.col("o_orderkey").alias("pos"))
    return resolve.upserted(stored, batch, ["key"], "pos").select("key", F.round("balance", 4).alias("balance"))


UPSERT = """WITH b AS (SELECT o_custkey + CASE WHEN o_orderkey % 25 = 0 THEN 1000000 ELSE 0 END AS key, max_by(o_totalprice, o_orderkey) AS balance FROM orders GROUP BY 1)
SELECT key, round(balance, 4) AS balance FROM b UNION ALL SELECT c_custkey, round(c_acctbal, 4) FROM customer WHERE c_custkey NOT IN (SELECT key FROM b)"""

def candidate_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items of an order and supplier as versions of one record; equal line and part numbers are one version."""
    rows = fx.candidates(spark, sf_dir).select("key", "source", "line", "native", F.concat_ws("-", "key", "source").alias("native_id"), scalars.content_hash("line", "native").alias("digest"))
    return resolve.versions(rows, ["key", "source"], [F.desc("line"), F.desc("native")], "native_id", "digest").select("key", "source", "line", "native", "native_id", "is_superseded")


VERSIONS = f"""WITH {fx.CANDIDATES}, v AS (SELECT DISTINCT key, source, line, native FROM candidates), r AS (SELECT *, row_number() OVER (PARTITION BY key, source ORDER BY line DESC, native DESC) > 1 AS is_superseded FROM v)
SELECT key, source, line, native, key || '-' || source || CASE WHEN is_superseded THEN '#superseded:' || substr(sha256('{{"line":' || line || ',"native":' || native || '}}'), 1, 16) ELSE '' END AS native_id, is_superseded FROM r"""

QUERIES = {
    f.__name__: f
    for f in (candidate_versions, signature_asof, identity_band_join, session_match, gap_self_heal, local_day_bucket, backfill_chunks, signature_intervals, field_winner, field_resolution, effective_tier, current_candidates, quarantine, tombstones, upsert)
}
ORACLE = {
    "candidate_versions": VERSIONS, "signature_asof": ASOF, "identity_band_join": BAND, "session_match": SESSIONS, "gap_self_heal": HEAL, "local_day_bucket": LOCAL, "backfill_chunks": CHUNKS, "signature_intervals": INTERVALS, "field_winner": WINNER, "field_resolution": RESOLUTION,
    "effective_tier": TIER, "current_candidates": CURRENT, "quarantine": QUARANTINE, "tombstones": TOMBSTONES, "upsert": UPSERT,
}
