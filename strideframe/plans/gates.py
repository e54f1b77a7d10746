"""Queries of the power metrics' gates: sport, missing input, domain, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strideframe.functions import constants as C
from strideframe.operators import heart, listing, power
from strideframe.plans import metrics
from strideframe.sources import fixtures as fx

CP, W_PRIME = metrics.CP, metrics.W_PRIME
DURATIONS = (1, 5, 30, 3600)


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The users' streams; every thirteenth user's holds no power at all."""
    return fx.short_stream(spark, sf_dir).withColumn("power", F.when(F.col("key") % 13 > 0, F.col("power")))


STREAM = f"{fx.SHORT}, stream AS (SELECT key, t, CASE WHEN key % 13 > 0 THEN power END AS power FROM short)"


def _settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each user: every seventh runs, every fifth has no threshold, every eleventh one of zero."""
    key = F.col("key")
    return fx.short_stream(spark, sf_dir).select("key").distinct().select(
        "key", F.when(key % 7 == 0, "running").otherwise("cycling").alias("sport"), F.when(key % 11 == 0, 0.0).when(key % 5 > 0, CP).alias("cp_w"), F.lit(W_PRIME).alias("w_prime_j")
    )


def w_balance_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = power.w_balance_summary(_stream(spark, sf_dir), _settings(spark, sf_dir))
    return out.select("key", *(F.round(c, 4).alias(c) for c in ("start_j", "end_j", "least_j")), "valid_s", "gap_s", "reason")


BALANCE = f"""WITH RECURSIVE {STREAM}, w AS (SELECT key, CAST(-1 AS BIGINT) AS t, CAST({W_PRIME} AS DOUBLE) AS b FROM (SELECT DISTINCT key FROM stream)
UNION ALL SELECT s.key, s.t, CASE WHEN power IS NULL THEN b WHEN power >= {CP} THEN b - (power - {CP}) ELSE b + ({W_PRIME} - b) * (1 - exp(-1 / (546 * exp(-0.01 * ({CP} - power)) + 316))) END
FROM w JOIN stream s ON s.key = w.key AND s.t = w.t + 1), e AS (SELECT key, min_by(b, t) AS a, max_by(b, t) AS z, min(b) AS low FROM w WHERE t >= 0 GROUP BY 1),
c AS (SELECT key, count(power) AS valid_s, count(*) - count(power) AS gap_s FROM stream GROUP BY 1),
r AS (SELECT c.*, a, z, low, CASE WHEN c.key % 7 = 0 THEN 'not_applicable_for_sport' WHEN valid_s = 0 THEN 'missing_required_input' WHEN c.key % 11 = 0 THEN 'out_of_domain' WHEN c.key % 5 = 0 THEN 'missing_required_input' END AS reason
FROM c JOIN e ON e.key = c.key)
SELECT key, CASE WHEN reason IS NULL THEN round(a, 4) END AS start_j, CASE WHEN reason IS NULL THEN round(z, 4) END AS end_j, CASE WHEN reason IS NULL THEN round(low, 4) END AS least_j, valid_s, gap_s, reason FROM r"""


def effort_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best efforts of users by duration, or why there is none; customers without events have no samples."""
    stream = _stream(spark, sf_dir)
    sports = _settings(spark, sf_dir).select("key", "sport").unionByName(fx.table(spark, sf_dir, "customer").select((F.col("c_custkey") + 1_000_000).alias("key"), F.lit("cycling").alias("sport")))
    out = power.best_efforts(stream, power.mean_maximal_power(stream, DURATIONS[:3]), sports, DURATIONS)
    return out.select("key", "duration_s", F.round("best_w", 6).alias("best_w"), "reason")


EFFORTS = f"""WITH {STREAM}, {metrics._curve_sql('stream', DURATIONS[:3])}, k AS (SELECT DISTINCT key, key % 7 = 0 AS runs, true AS has FROM stream UNION ALL SELECT c_custkey + 1000000, false, false FROM customer),
m AS (SELECT key, d, max(m) AS m FROM legs GROUP BY 1, 2), g AS (SELECT k.*, CAST(d AS BIGINT) AS d FROM k CROSS JOIN (VALUES {', '.join(f'({d})' for d in DURATIONS)}) v(d))
SELECT g.key, g.d AS duration_s, CASE WHEN NOT runs AND has THEN round(m, 6) END AS best_w, CASE WHEN runs THEN 'not_applicable_for_sport' WHEN NOT has THEN 'missing_required_input' WHEN m IS NULL THEN 'insufficient_data' END AS reason
FROM g LEFT JOIN m ON m.key = g.key AND m.d = g.d"""


def durability_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The suppliers' durability, every third of them a runner."""
    metric = metrics.durability(spark, sf_dir)
    sports = fx.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"), F.when(F.col("s_suppkey") % 3 == 0, "running").otherwise("cycling").alias("sport"))
    return power.gated(metric, sports)


_GATED = ", ".join(f"CASE WHEN key % 3 <> 0 THEN {c} END AS {c}" for c in ("fresh_w", "fatigued_w", "decrement_pct", "split_t"))
GATED = f"SELECT key, {_GATED}, CASE WHEN key % 3 = 0 THEN 'not_applicable_for_sport' ELSE reason END AS reason FROM ({metrics.DURABILITY})"

def _supplier_sports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh supplier runs; so do some without a recording."""
    key = F.col("s_suppkey")
    return fx.table(spark, sf_dir, "supplier").select(key.alias("key"), F.when(key % 7 == 0, "running").otherwise("cycling").alias("sport"))


def _fits(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    curve = power.mean_maximal_power(fx.long_stream(spark, sf_dir), metrics.CP_POINTS)
    return curve, power.gated(power.critical_power(curve, least_ratio=1.5, bias_s=LONG_S), _supplier_sports(spark, sf_dir))


def critical_power_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fits of suppliers' curves behind the sport gate, flagged where a long duration bears on them."""
    out = _fits(spark, sf_dir)[1]
    return out.select("key", F.round("cp_w", 5).alias("cp_w"), F.round("w_prime_j", 3).alias("w_prime_j"), "long_bias", "reason")


def critical_power_chart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted beside observed power for some durations, of which two were never looked at."""
    curve, fits = _fits(spark, sf_dir)
    out = listing.critical_power_points(fits, curve, CHART_S)
    return out.select("key", "duration_s", F.round("predicted_w", 4).alias("predicted_w"), F.round("observed_w", 4).alias("observed_w"))


LONG_S = metrics.CP_POINTS[-1] - 1
CHART_S = (*metrics.CP_POINTS[:2], 60, 7200)
_FIT = metrics.CRITICAL.split("\nSELECT key, round(CASE", 1)[0] + f""",
x AS (SELECT e.key, CASE WHEN e.key % 7 = 0 THEN 'not_applicable_for_sport' ELSE reason END AS reason, cp, wp, long FROM e JOIN (SELECT key, max(x) > {LONG_S} AS long FROM pts GROUP BY 1) l ON l.key = e.key)"""
CP_GATES = f"{_FIT} SELECT key, CASE WHEN reason IS NULL THEN round(cp, 5) END AS cp_w, CASE WHEN reason IS NULL THEN round(wp, 3) END AS w_prime_j, CASE WHEN reason IS NULL THEN long END AS long_bias, reason FROM x"
CP_CHART = f"""{_FIT} SELECT x.key, CAST(v.d AS BIGINT) AS duration_s, round(wp / v.d + cp, 4) AS predicted_w, round(p, 4) AS observed_w
FROM x CROSS JOIN (VALUES {', '.join(f'({d})' for d in CHART_S)}) v(d) LEFT JOIN pts ON pts.key = x.key AND pts.x = v.d WHERE reason IS NULL"""


def decoupling_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drift of power for those who ride, of speed for those who run; those who swim have neither."""
    stream = fx.short_stream(spark, sf_dir).withColumn("speed", F.when(F.col("t") % 17 > 0, F.col("power") / 100 + 1 + F.col("t") % 3))
    key = F.col("key")
    sports = stream.select("key").distinct().withColumn("sport", F.when(key % 3 == 0, "cycling").when(key % 3 == 1, "running").otherwise("swimming"))
    drift = heart.decoupling(heart.output_stream(stream, sports), least_s=40, smooth=10, least_half=10, most_cv=1.0)
    out = power.gated(drift, sports, C.POWER_SPORTS + C.PACE_SPORTS)
    return out.select("key", F.round("drift_pct", 6).alias("drift_pct"), "included_s", "reason")


CHANNELS = f"""WITH {fx.SHORT}, channel AS (SELECT key, t, CASE key % 3 WHEN 0 THEN power WHEN 1 THEN CASE WHEN t % 17 > 0 THEN power / 100 + 1 + t % 3 END END AS power, hr FROM short)""" + metrics.DECOUPLING.split(fx.SHORT, 1)[1].replace("FROM short", "FROM channel").replace(
    "CASE WHEN np = 0 THEN", "CASE WHEN g.key % 3 = 2 THEN 'not_applicable_for_sport' WHEN np = 0 THEN"
)

QUERIES = {f.__name__: f for f in (w_balance_gates, effort_gaps, durability_gates, critical_power_gates, critical_power_chart, decoupling_channels)}
ORACLE = {"w_balance_gates": BALANCE, "effort_gaps": EFFORTS, "durability_gates": GATED, "critical_power_gates": CP_GATES, "critical_power_chart": CP_CHART, "decoupling_channels": CHANNELS}
