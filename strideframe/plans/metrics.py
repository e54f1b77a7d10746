"""Queries of the load, stream, power and heart-rate metrics, with the SQL that gives the same rows."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strideframe.operators import heart, load, power, series
from strideframe.sources import fixtures as fx

CP, W_PRIME = 250.0, 2000.0
CURVE_SHORT = (1, 5, 15, 30)
CURVE_LONG = (5, 30, 60, 120)
CP_POINTS = (120, 180, 240)


def _r(*names: str, digits: int = 6):
    return [F.round(n, digits).alias(n) for n in names]


def pmc_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = load.pmc(load.daily_grid(fx.daily_loads(spark, sf_dir), "2024-01-31"))
    return out.select("key", "day", *_r("load", "ctl", "atl", "tsb"), "provisional", "substituted", *_r("confidence"))


_C, _A = math.exp(-1 / 42), math.exp(-1 / 7)
PMC = f"""WITH RECURSIVE {fx.DAILY}, span AS (SELECT key, min(day) AS d0 FROM daily GROUP BY 1),
grid AS (SELECT key, d0 + CAST(i AS INT) AS day, i FROM span, range(0, 400) r(i) WHERE d0 + CAST(i AS INT) <= DATE '2024-01-31'),
g AS (SELECT grid.key, grid.day, grid.i, CASE WHEN daily.key IS NULL THEN 0.0 ELSE daily.load END AS load, coalesce(daily.substituted, false) AS substituted
  FROM grid LEFT JOIN daily ON grid.key = daily.key AND grid.day = daily.day),
p AS (SELECT key, day, i, load, substituted, {1 - _C!r} * coalesce(load, 0) AS ctl, {1 - _A!r} * coalesce(load, 0) AS atl, CAST(0 AS DOUBLE) AS tsb FROM g WHERE i = 0
  UNION ALL SELECT g.key, g.day, g.i, g.load, g.substituted, {_C!r} * p.ctl + {1 - _C!r} * coalesce(g.load, 0), {_A!r} * p.atl + {1 - _A!r} * coalesce(g.load, 0), p.ctl - p.atl
  FROM p JOIN g ON g.key = p.key AND g.i = p.i + 1)
SELECT key, day, round(load, 6) AS load, round(ctl, 6) AS ctl, round(atl, 6) AS atl, round(tsb, 6) AS tsb, load IS NULL AS provisional, substituted,
  round(CAST(CASE WHEN load IS NULL THEN 0.5 ELSE 1 END * CASE WHEN substituted THEN 0.7 ELSE 1 END AS DOUBLE), 6) AS confidence FROM p"""


def resample_1hz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.resample_1hz(fx.irregular_stream(spark, sf_dir)).select("key", "t", *_r("v"))


RESAMPLE = f"""WITH {fx.IRREGULAR}, f AS (SELECT key, t, min_by(v, pos) AS v0, count(*) AS n FROM (SELECT key, t, pos, v FROM irregular) GROUP BY 1, 2),
firsts AS (SELECT i.key, i.t, i.v FROM irregular i JOIN (SELECT key, t, min(pos) AS pos FROM irregular GROUP BY 1, 2) m ON i.key = m.key AND i.pos = m.pos),
grid AS (SELECT key, unnest(range(0, max(t) + 1)) AS t FROM irregular GROUP BY key),
j AS (SELECT g.key, g.t, h.v, h.t IS NOT NULL AS hit FROM grid g LEFT JOIN firsts h ON g.key = h.key AND g.t = h.t),
n AS (SELECT *, last_value(CASE WHEN v IS NOT NULL THEN t END IGNORE NULLS) OVER b AS t0, last_value(v IGNORE NULLS) OVER b AS v0,
  first_value(CASE WHEN v IS NOT NULL THEN t END IGNORE NULLS) OVER a AS t1, first_value(v IGNORE NULLS) OVER a AS v1 FROM j
  WINDOW b AS (PARTITION BY key ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY key ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT key, t, round(CASE WHEN hit THEN v WHEN t1 - t0 <= 3 THEN v0 + (v1 - v0) * (t - t0) / (t1 - t0) END, 6) AS v FROM n"""


CHANNELS = ("power", "hr", "cadence")


def channel_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's values as sets of channels: each at 1 Hz, every second one at 0.5 Hz, all but the last ten at 2 Hz; some
    samples are no numbers, and a second kind of sets doesn't count. Every seventh user has no cadence."""
    e = fx.events(spark, sf_dir)
    rows = e.groupBy(F.col("user_id").alias("key")).agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "value"))).alias("a"))
    every = F.transform("a", lambda x: F.when(x["value"] <= 200, x["value"].cast("string")).otherwise("gap"))
    second = F.filter(every, lambda x, i: i % 2 == 0)
    head = F.slice(every, 1, F.greatest(F.size(every) - 10, F.lit(1)))
    sets = [
        F.struct(F.lit(c).alias("channel"), F.lit(kind).alias("set_kind"), F.lit(rate).cast("double").alias("rate"), values.alias("values"))
        for c, kind, rate, values in (("power", "activity", None, every), ("hr", "activity", 0.5, second), ("cadence", "activity", 2.0, head), ("hr", "recovery", 1.0, every))
    ]
    channels = rows.select("key", F.explode(F.array(*sets)).alias("s")).select("key", "s.*").where("key % 7 > 0 OR channel <> 'cadence'")
    out = series.aligned_channels(series.channel_samples(channels), CHANNELS)
    return out.select("key", F.col("t").cast("long").alias("t"), *_r(*CHANNELS))


GRID = """WITH e AS (SELECT user_id AS key, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n, CASE WHEN value <= 200 THEN value END AS v FROM events),
s AS (SELECT key, 'power' AS c, CAST(i AS DOUBLE) AS t, v FROM e UNION ALL SELECT key, 'hr', CAST(i AS DOUBLE), v FROM e WHERE i % 2 = 0 UNION ALL SELECT key, 'cadence', i / 2.0, v FROM e WHERE key % 7 > 0 AND i < greatest(n - 10, 1)),
l AS (SELECT key, c, CAST(floor(max(t)) AS BIGINT) AS z FROM s GROUP BY 1, 2), z AS (SELECT key, min(z) AS z FROM l GROUP BY 1), g AS (SELECT key, c, CAST(unnest(range(0, z + 1)) AS DOUBLE) AS t FROM l),
j AS (SELECT coalesce(g.key, s.key) AS key, coalesce(g.c, s.c) AS c, coalesce(g.t, s.t) AS t, s.v, s.t IS NOT NULL AS hit FROM g FULL JOIN s ON g.key = s.key AND g.c = s.c AND g.t = s.t),
n AS (SELECT *, last_value(CASE WHEN v IS NOT NULL THEN t END IGNORE NULLS) OVER b AS t0, last_value(v IGNORE NULLS) OVER b AS v0, first_value(CASE WHEN v IS NOT NULL THEN t END IGNORE NULLS) OVER a AS t1, first_value(v IGNORE NULLS) OVER a AS v1 FROM j
  WINDOW b AS (PARTITION BY key, c ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY key, c ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
r AS (SELECT n.key, c, t, CASE WHEN hit THEN v WHEN t1 - t0 <= 3 THEN v0 + (v1 - v0) * (t - t0) / (t1 - t0) END AS v FROM n JOIN z ON z.key = n.key AND t <= z.z WHERE t = floor(t))
SELECT key, CAST(t AS BIGINT) AS t, round(max(v) FILTER (c = 'power'), 6) AS power, round(max(v) FILTER (c = 'hr'), 6) AS hr, round(max(v) FILTER (c = 'cadence'), 6) AS cadence FROM r GROUP BY 1, 2"""


def seeded_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.seeded_mean(fx.short_stream(spark, sf_dir), "power", 30).select("key", "t", *_r("mean"))


SEEDED = f"""WITH {fx.SHORT} SELECT key, t, round(CASE WHEN count(power) OVER w = 30 THEN avg(power) OVER w END, 6) AS mean FROM short
WINDOW w AS (PARTITION BY key ORDER BY t ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)"""


def stream_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.runs(fx.short_stream(spark, sf_dir), "power")


RUNS = f"""WITH {fx.SHORT}, m AS (SELECT key, t, power IS NOT NULL AS ok, t - sum(CASE WHEN power IS NOT NULL THEN 1 ELSE 0 END) OVER w AS island,
  power IS NULL AND coalesce(lag(power IS NOT NULL) OVER w, true) AS opens FROM short WINDOW w AS (PARTITION BY key ORDER BY t)),
s AS (SELECT key, island, count(*) AS n, count(*) FILTER (ok) AS v, count(*) FILTER (opens) AS o FROM m GROUP BY 1, 2)
SELECT key, CAST(sum(n) AS BIGINT) AS samples, CAST(sum(v) AS BIGINT) AS valid, max(v) AS longest_run, CAST(sum(o) AS BIGINT) AS gap_runs FROM s GROUP BY 1"""


def normalized_power(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = power.normalized_power(fx.short_stream(spark, sf_dir))
    return out.select("key", *_r("np_w", "avg_power_w"), "duration_s", "window_s", "reason", *_r("coverage_fraction"), "gap_count")


_NP = f"""{fx.SHORT}, r AS (SELECT *, CASE WHEN count(power) OVER w = 30 THEN avg(power) OVER w END AS m FROM short
  WINDOW w AS (PARTITION BY key ORDER BY t ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)),
np AS (SELECT key, pow(avg(pow(m, 4)), 0.25) AS raw, avg(power) AS avg_p, count(power) AS duration_s, count(m) AS window_s, count(*) AS samples,
  CASE WHEN count(power) = 0 THEN 'missing_required_input' WHEN count(m) = 0 THEN 'insufficient_data' END AS reason, avg(hr) AS hr FROM r GROUP BY key)"""
NORMALIZED = f"""WITH {_NP} SELECT key, round(CASE WHEN reason IS NULL THEN raw END, 6) AS np_w, round(CASE WHEN reason IS NULL THEN avg_p END, 6) AS avg_power_w, duration_s, window_s, reason,
round(duration_s / samples, 6) AS coverage_fraction, samples - duration_s AS gap_count FROM np"""


def load_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    stream = fx.short_stream(spark, sf_dir)
    rates = stream.groupBy("key").agg(F.avg("hr").alias("avg_hr_bpm"))
    ftp = F.when(F.col("key") % 10 == 0, F.lit(None)).when(F.col("key") % 10 == 1, F.lit(0.0)).otherwise(200.0 + F.col("key"))
    powers = power.normalized_power(stream).join(rates, "key").withColumn("ftp_w", ftp)
    out = power.load_bundle(powers)
    return out.select("key", *_r("if_", "tss", "tss_per_hour", "ef", "vi"), "intensity_class", "if_reason", "tss_reason", "ef_reason", "vi_reason")


LOAD_METRICS = f"""WITH {_NP}, f AS (SELECT key, CASE WHEN reason IS NULL THEN raw END AS np_w, CASE WHEN reason IS NULL THEN avg_p END AS avg_p, duration_s, reason, hr,
  CASE WHEN key % 10 = 0 THEN NULL WHEN key % 10 = 1 THEN 0.0 ELSE 200.0 + key END AS ftp FROM np),
g AS (SELECT *, coalesce(reason, CASE WHEN ftp IS NULL THEN 'missing_required_input' WHEN ftp <= 0 THEN 'out_of_domain' END) AS if_reason,
  coalesce(reason, CASE WHEN avg_p IS NULL THEN 'missing_required_input' WHEN avg_p <= 0 THEN 'out_of_domain' END) AS vi_reason FROM f),
h AS (SELECT *, CASE WHEN if_reason IS NULL THEN np_w / ftp END AS x, CASE WHEN if_reason IS NULL THEN CAST(duration_s AS DOUBLE) * np_w * np_w / (ftp * ftp * 3600) * 100 END AS y FROM g)
SELECT key, round(x, 6) AS if_, round(y, 6) AS tss, round(y / (duration_s / 3600), 6) AS tss_per_hour, round(np_w / hr, 6) AS ef, round(CASE WHEN vi_reason IS NULL THEN np_w / avg_p END, 6) AS vi,
CASE WHEN x IS NULL THEN NULL WHEN x >= 1.05 THEN 'vo2' WHEN x >= 0.9 THEN 'threshold' WHEN x >= 0.75 THEN 'tempo' WHEN x >= 0.55 THEN 'endurance' ELSE 'recovery' END AS intensity_class,
if_reason, if_reason AS tss_reason, reason AS ef_reason, vi_reason FROM h"""


def mmp_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return power.mean_maximal_power(fx.short_stream(spark, sf_dir), CURVE_SHORT).select("key", "duration_s", *_r("best_w"))


def _curve_sql(view: str, durations: tuple[int, ...]) -> str:
    legs = " UNION ALL ".join(f"SELECT a.key, {d} AS d, b.i - a.i AS n, a.t, (b.c - a.c) / (b.i - a.i) AS m FROM pre a JOIN pre b ON a.key = b.key AND b.i BETWEEN a.i + {d} AND a.i + {2 * d - 1} AND b.s - a.s = b.i - a.i" for d in durations)
    return f"""pre AS (SELECT key, t + 1 AS i, t + 1 AS t, sum(coalesce(power, 0)) OVER w AS c, sum(CASE WHEN power IS NULL THEN 0 ELSE 1 END) OVER w AS s FROM {view} WINDOW w AS (PARTITION BY key ORDER BY t)
  UNION ALL SELECT DISTINCT key, 0, 0, 0, 0 FROM {view}), legs AS ({legs}),
best AS (SELECT key, d, m, n, t, row_number() OVER (PARTITION BY key, d ORDER BY m DESC, n, t) AS k FROM legs)"""


MMP = f"WITH {fx.SHORT}, {_curve_sql('short', CURVE_SHORT)} SELECT key, CAST(d AS BIGINT) AS duration_s, round(max(m), 6) AS best_w FROM legs GROUP BY 1, 2"


def mmp_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return power.mean_maximal_power(fx.long_stream(spark, sf_dir), CURVE_LONG).select("key", "duration_s", *_r("best_w"), "window_s", "start_t")


MMP_LONG = f"WITH {fx.LONG}, {_curve_sql('long', CURVE_LONG)} SELECT key, CAST(d AS BIGINT) AS duration_s, round(m, 6) AS best_w, CAST(n AS BIGINT) AS window_s, CAST(t AS BIGINT) AS start_t FROM best WHERE k = 1"


def power_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best power of the users of each group of ten, by the user it comes from."""
    curves = power.mean_maximal_power(fx.short_stream(spark, sf_dir), CURVE_SHORT).withColumn("best_w", F.round("best_w", 6))
    users = fx.events(spark, sf_dir).groupBy(F.col("user_id").alias("activity_id")).agg((F.first("user_id") % 10).alias("athlete"), F.min("ts").alias("start"))
    return power.power_curve(curves, users)


POWER_CURVE = f"""WITH {fx.SHORT}, {_curve_sql('short', CURVE_SHORT)}, u AS (SELECT user_id, user_id % 10 AS athlete, min(ts) AS start FROM events GROUP BY 1, 2),
b AS (SELECT key, d, round(max(m), 6) AS m FROM legs GROUP BY 1, 2)
SELECT athlete, CAST(d AS BIGINT) AS duration_s, m AS best_w, key AS activity_id, CAST(start AS DATE) AS on_date FROM b JOIN u ON key = user_id QUALIFY row_number() OVER (PARTITION BY athlete, d ORDER BY m DESC, start, key) = 1"""


def critical_power(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = power.mean_maximal_power(fx.long_stream(spark, sf_dir), CP_POINTS)
    out = power.critical_power(points, least_ratio=1.5)
    return out.select("key", *_r("cp_w", "r2", digits=5), *_r("w_prime_j", digits=3), *_r("se_cp", digits=5), *_r("se_w_prime", digits=3), "n", "reason")


CRITICAL = f"""WITH {fx.LONG}, {_curve_sql('long', CP_POINTS)}, pts AS (SELECT key, CAST(d AS DOUBLE) AS x, m AS p, m * d AS w FROM best WHERE k = 1),
fit AS (SELECT key, count(*) AS n, max(x) / min(x) AS ratio, (max(p) - min(p)) / max(p) AS spread, regr_slope(w, x) AS cp, regr_intercept(w, x) AS wp, regr_r2(w, x) AS r2, regr_sxx(w, x) AS sxx,
  regr_syy(w, x) AS syy, avg(x) AS xm FROM pts GROUP BY 1), rest AS (SELECT pts.key, sum(pow(w - cp * x - wp, 2)) AS ssr FROM pts JOIN fit ON pts.key = fit.key GROUP BY 1),
e AS (SELECT fit.*, ssr, CASE WHEN n < 3 OR ratio < 1.5 OR spread < 1e-6 THEN 'insufficient_data' WHEN syy <= 0 OR r2 < 0.95 OR cp <= 0 OR wp <= 0 THEN 'poor_fit' END AS reason FROM fit JOIN rest ON fit.key = rest.key)
SELECT key, round(CASE WHEN reason IS NULL THEN cp END, 5) AS cp_w, round(CASE WHEN reason IS NULL THEN r2 END, 5) AS r2, round(CASE WHEN reason IS NULL THEN wp END, 3) AS w_prime_j,
round(CASE WHEN reason IS NULL THEN CASE WHEN n <= 2 THEN 0 ELSE sqrt(ssr / (n - 2) / sxx) END END, 5) AS se_cp,
round(CASE WHEN reason IS NULL THEN CASE WHEN n <= 2 THEN 0 ELSE sqrt(ssr / (n - 2) * (1.0 / n + xm * xm / sxx)) END END, 3) AS se_w_prime, n, reason FROM e"""


def w_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return power.w_balance(fx.short_stream(spark, sf_dir), CP, W_PRIME).select("key", "t", *_r("w_bal_j", digits=4))


WBAL = f"""WITH RECURSIVE {fx.SHORT}, w AS (SELECT key, CAST(-1 AS BIGINT) AS t, CAST({W_PRIME} AS DOUBLE) AS b FROM (SELECT DISTINCT key FROM short)
UNION ALL SELECT s.key, s.t, CASE WHEN power IS NULL THEN b WHEN power >= {CP} THEN b - (power - {CP}) ELSE b + ({W_PRIME} - b) * (1 - exp(-1 / (546 * exp(-0.01 * ({CP} - power)) + 316))) END
FROM w JOIN short s ON s.key = w.key AND s.t = w.t + 1) SELECT key, t, round(b, 4) AS w_bal_j FROM w WHERE t >= 0"""


def work_above_cp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return power.work_above(fx.short_stream(spark, sf_dir), CP).select("key", "t", *_r("work_j"))


WORK = f"WITH {fx.SHORT} SELECT key, t, round(sum(greatest(0, coalesce(power, {CP}) - {CP})) OVER (PARTITION BY key ORDER BY t), 6) AS work_j FROM short"


def durability(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = power.durability(fx.long_stream(spark, sf_dir), 200.0, 1000.0, target=120, multiple=20.0)
    return out.select("key", *_r("fresh_w", "fatigued_w", "decrement_pct"), "split_t", "reason")


DURABILITY = f"""WITH {fx.LONG}, w AS (SELECT *, sum(greatest(0, power - 200)) OVER (PARTITION BY key ORDER BY t) >= 20000 AS side FROM long),
m AS (SELECT *, CASE WHEN count(power) OVER x = 120 THEN avg(power) OVER x END AS m FROM w WINDOW x AS (PARTITION BY key, side ORDER BY t ROWS BETWEEN 119 PRECEDING AND CURRENT ROW)),
b AS (SELECT key, min(t) FILTER (side) AS split_t, max(m) FILTER (NOT side) AS f, max(m) FILTER (side) AS g FROM m GROUP BY 1),
c AS (SELECT *, CASE WHEN split_t IS NULL OR f IS NULL OR g IS NULL THEN 'insufficient_data' WHEN f <= 0 THEN 'out_of_domain' END AS reason FROM b)
SELECT key, round(CASE WHEN reason IS NULL THEN f END, 6) AS fresh_w, round(CASE WHEN reason IS NULL THEN g END, 6) AS fatigued_w, round(CASE WHEN reason IS NULL THEN 100 * (1 - g / f) END, 6) AS decrement_pct, split_t, reason FROM c"""


def trimp(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = heart.banister_load(fx.short_stream(spark, sf_dir), 110.0, 180.0)
    return out.select("key", *_r("trimp", "clamped_fraction", "confidence"), "reason")


TRIMP = f"""WITH {fx.SHORT}, r AS (SELECT key, hr, (hr - 110) / 70 AS raw FROM short)
SELECT key, round(sum(least(greatest(raw, 0), 1) * 0.75 * exp(1.795 * least(greatest(raw, 0), 1)) / 60), 6) AS trimp,
round(count(*) FILTER (raw < 0 OR raw > 1) / count(hr), 6) AS clamped_fraction, CAST(0.7 AS DOUBLE) AS confidence, CAST(NULL AS VARCHAR) AS reason FROM r GROUP BY 1"""


def trimp_zonal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return heart.zonal_load(fx.short_stream(spark, sf_dir), [120, 140, 160, 180], [1, 2, 3, 4, 5]).select("key", *_r("zonal"), "reason")


ZONAL = f"""WITH {fx.SHORT} SELECT key, round(sum(CAST(1 + CASE WHEN hr >= 120 THEN 1 ELSE 0 END + CASE WHEN hr >= 140 THEN 1 ELSE 0 END + CASE WHEN hr >= 160 THEN 1 ELSE 0 END
+ CASE WHEN hr >= 180 THEN 1 ELSE 0 END AS DOUBLE)) / 60, 6) AS zonal, CAST(NULL AS VARCHAR) AS reason FROM short GROUP BY 1"""


def _beats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.short_stream(spark, sf_dir).select("key", F.col("t").alias("i"), (700 + F.col("hr")).alias("rr"))


def hrv_time_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = heart.hrv_time_domain(_beats(spark, sf_dir), least_s=40.0)
    return out.select("key", *_r("rmssd", "sdnn", "pnn50", "mean_nn", "corrected_fraction"), "reason")


HRV = f"""WITH {fx.SHORT}, b AS (SELECT key, t AS i, 700 + hr AS rr FROM short), n AS (SELECT *, list_sort(list_filter([lag(rr, 2) OVER w, lag(rr) OVER w, lead(rr) OVER w, lead(rr, 2) OVER w], lambda x: x IS NOT NULL)) AS near
  FROM b WINDOW w AS (PARTITION BY key ORDER BY i)), m AS (SELECT *, (near[CAST((len(near) + 1) // 2 AS INT)] + near[CAST((len(near) + 2) // 2 AS INT)]) / 2 AS med FROM n),
c AS (SELECT key, i, rr, coalesce(abs(rr - med) > 0.2 * med, false) AS off, CASE WHEN coalesce(abs(rr - med) > 0.2 * med, false) THEN med ELSE rr END AS nn FROM m),
d AS (SELECT *, nn - lag(nn) OVER (PARTITION BY key ORDER BY i) AS d FROM c),
s AS (SELECT key, count(*) AS n, avg(CASE WHEN off THEN 1.0 ELSE 0.0 END) AS corrected, sum(nn) AS total, sqrt(avg(d * d)) AS rmssd, stddev_pop(nn) AS sdnn, 100 * avg(CASE WHEN d IS NULL THEN NULL WHEN abs(d) > 50 THEN 1.0 ELSE 0.0 END) AS pnn50, avg(nn) AS mean_nn FROM d GROUP BY 1),
r AS (SELECT *, CASE WHEN corrected > 0.05 OR n < 2 OR total < 40000 THEN 'insufficient_data' END AS reason FROM s)
SELECT key, round(CASE WHEN reason IS NULL THEN rmssd END, 6) AS rmssd, round(CASE WHEN reason IS NULL THEN sdnn END, 6) AS sdnn, round(CASE WHEN reason IS NULL THEN pnn50 END, 6) AS pnn50,
round(CASE WHEN reason IS NULL THEN mean_nn END, 6) AS mean_nn, round(corrected, 6) AS corrected_fraction, reason FROM r"""


def hrv_frequency_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return heart.hrv_frequency_domain(_beats(spark, sf_dir)).select("key", *_r("lf", "hf", "lf_hf"), "reason")


#: Spectra by sums of cosines and sines over each segment.
SPECTRUM = HRV.split("d AS (SELECT *, nn - lag", 1)[0] + """g AS (SELECT key, CASE WHEN count(*) < 4 OR avg(CASE WHEN off THEN 1.0 ELSE 0.0 END) > 0.05 THEN 'insufficient_data' END AS why FROM c GROUP BY 1),
a AS (SELECT c.key, i, nn, sum(nn) OVER o / 1000 - first_value(nn) OVER o / 1000 AS tm FROM c JOIN g ON g.key = c.key AND why IS NULL WINDOW o AS (PARTITION BY c.key ORDER BY i)),
x AS (SELECT *, lead(nn) OVER o AS nx, lead(tm) OVER o AS til FROM a WINDOW o AS (PARTITION BY key ORDER BY i)),
s AS (SELECT *, unnest(range(CAST(ceil(tm * 4) AS BIGINT), CAST(ceil(til * 4) AS BIGINT))) AS k FROM x WHERE til IS NOT NULL),
v AS (SELECT key, k, nn + (nx - nn) / (til - tm) * (k / 4.0 - tm) AS v, count(*) OVER (PARTITION BY key) AS n FROM s),
z AS (SELECT *, least(n, 256) AS size, least(n, 256) - least(n, 256) // 2 AS step FROM v WHERE n >= 4),
e AS (SELECT *, unnest(range(0, (n - size) // step + 1)) AS seg FROM z), f AS (SELECT key, seg, size, k - seg * step AS j, v FROM e WHERE k >= seg * step AND k < seg * step + size),
h AS (SELECT *, (v - avg(v) OVER (PARTITION BY key, seg)) * (0.5 - 0.5 * cos(2 * pi() * j / size)) AS y, 0.5 - 0.5 * cos(2 * pi() * j / size) AS win FROM f),
q AS (SELECT key, seg, size, m, (pow(sum(y * cos(2 * pi() * m * j / size)), 2) + pow(sum(y * sin(2 * pi() * m * j / size)), 2)) / (4 * sum(win * win)) * CASE WHEN m = 0 OR 2 * m = size THEN 1 ELSE 2 END AS p, m * (CAST(1 AS DOUBLE) / (size * CAST(0.25 AS DOUBLE))) AS hz
  FROM (SELECT *, unnest(range(0, CAST(ceil(0.4 * size / 4.0) AS BIGINT) + 1)) AS m FROM h) GROUP BY 1, 2, 3, 4),
t AS (SELECT key, seg, hz >= 0.15 AS high, (p + lead(p) OVER o) / 2 * (lead(hz) OVER o - hz) AS area FROM q WHERE hz >= 0.04 AND hz < 0.4 WINDOW o AS (PARTITION BY key, seg, hz >= 0.15 ORDER BY m)),
l AS (SELECT key, seg, coalesce(sum(area) FILTER (NOT high), 0) AS lf, coalesce(sum(area) FILTER (high), 0) AS hf FROM t GROUP BY 1, 2), r AS (SELECT key, avg(lf) AS lf, avg(hf) AS hf FROM l GROUP BY 1)
SELECT g.key, CASE WHEN hf > 0 THEN round(lf, 6) END AS lf, CASE WHEN hf > 0 THEN round(hf, 6) END AS hf, CASE WHEN hf > 0 THEN round(lf / hf, 6) END AS lf_hf, coalesce(why, CASE WHEN coalesce(hf, 0) = 0 THEN 'insufficient_data' END) AS reason FROM g LEFT JOIN r ON r.key = g.key"""


def decoupling(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = heart.decoupling(fx.short_stream(spark, sf_dir), least_s=40, smooth=10, least_half=10, most_cv=1.0)
    return out.select("key", *_r("drift_pct"), "included_s", "reason")


DECOUPLING = f"""WITH {fx.SHORT}, b AS (SELECT *, min(t) OVER (PARTITION BY key) AS t0, max(t) OVER (PARTITION BY key) AS t1 FROM short WHERE power IS NOT NULL AND hr IS NOT NULL),
m AS (SELECT *, count(*) OVER w AS c, avg(power) OVER w AS o FROM b WHERE power <> 0 WINDOW w AS (PARTITION BY key ORDER BY t ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)),
s AS (SELECT *, t <= (t0 + t1) / 2 AS f FROM m WHERE c = 10),
k AS (SELECT key, count(*) AS n, avg(o) AS mean, stddev_pop(o) AS sd, count(*) FILTER (f) AS n1, count(*) FILTER (NOT f) AS n2, avg(o) FILTER (f) / avg(hr) FILTER (f) AS e1, avg(o) FILTER (NOT f) / avg(hr) FILTER (NOT f) AS e2 FROM s GROUP BY 1),
g AS (SELECT key, count(power) AS np, min(t) FILTER (power IS NOT NULL) AS a, max(t) FILTER (power IS NOT NULL) AS b FROM short GROUP BY 1),
r AS (SELECT g.key, n, e1, e2, CASE WHEN np = 0 THEN 'missing_required_input' WHEN b - a + 1 < 40 OR coalesce(n, 0) = 0 THEN 'insufficient_data' WHEN mean <= 0 THEN 'out_of_domain'
  WHEN sd / mean > 1 OR n1 < 10 OR n2 < 10 THEN 'insufficient_data' WHEN e1 = 0 THEN 'out_of_domain' END AS reason FROM g LEFT JOIN k ON g.key = k.key)
SELECT key, round(CASE WHEN reason IS NULL THEN 100 * (e1 - e2) / e1 END, 6) AS drift_pct, CASE WHEN reason IS NULL THEN n END AS included_s, reason FROM r"""


def session_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = fx.events(spark, sf_dir).select("event_id", F.when(F.col("k") < 95, F.col("k") / 8.0).alias("rpe"), F.when(F.col("k") % 3 > 0, F.col("value") * 60).alias("moving_s"), (F.col("k") * 60.0).alias("elapsed_s"))
    return heart.session_load(e).select("event_id", *_r("srpe", "foster_au", digits=10), "reason")


SRPE = """WITH e AS (SELECT event_id, CASE WHEN k < 95 THEN k / 8.0 END AS rpe, coalesce(CASE WHEN k % 3 > 0 THEN value * 60 END, k * 60.0) AS dur
  FROM (SELECT *, CAST(regexp_extract(props, '[0-9]+') AS INT) AS k FROM events)),
r AS (SELECT *, CASE WHEN rpe IS NULL THEN 'missing_required_input' WHEN rpe NOT BETWEEN 0 AND 10 OR dur <= 0 THEN 'out_of_domain' END AS reason FROM e)
SELECT event_id, round(CASE WHEN reason IS NULL THEN pow(rpe / 10, 2) * (dur / 3600) * 100 END, 10) AS srpe, round(CASE WHEN reason IS NULL THEN rpe * dur / 60 END, 10) AS foster_au, reason FROM r"""


def load_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Load of each day by the first model that could be computed, and its share of days with a load."""
    stream = fx.short_stream(spark, sf_dir)
    tss = power.load_bundle(power.normalized_power(stream).withColumns({"ftp_w": F.when(F.col("key") % 3 > 0, 250.0), "avg_hr_bpm": F.lit(150.0)})).select("key", "tss")
    hr = heart.banister_load(stream.where("key % 3 <> 1"), 100.0, 200.0, "female").select("key", "trimp")
    rows = stream.select("key").distinct().join(tss, "key", "left").join(hr, "key", "left").withColumn("srpe", F.when(F.col("key") % 2 == 0, F.col("key") * 1.5))
    value, model, substituted = heart.load_chain(F.col("tss"), F.col("trimp"), F.col("srpe"))
    return rows.select("key", F.round(value, 6).alias("load"), model.alias("load_model"), substituted.alias("substituted"))


CHAIN = f"""WITH {_NP}, h AS (SELECT key, sum(least(greatest((hr - 100) / 100, 0), 1) * 0.86 * exp(1.67 * least(greatest((hr - 100) / 100, 0), 1)) / 60) AS x FROM short WHERE key % 3 <> 1 GROUP BY 1),
j AS (SELECT np.key, CASE WHEN reason IS NULL AND np.key % 3 > 0 THEN CAST(duration_s AS DOUBLE) * raw * raw / (250.0 * 250.0 * 3600) * 100 END AS a, x AS b, CASE WHEN np.key % 2 = 0 THEN np.key * 1.5 END AS c FROM np LEFT JOIN h ON np.key = h.key)
SELECT key, round(CAST(coalesce(a, b, c) AS DOUBLE), 6) AS load, CASE WHEN a IS NOT NULL THEN 'power_tss' WHEN b IS NOT NULL THEN 'hr_trimp' WHEN c IS NOT NULL THEN 'srpe_load' END AS load_model,
a IS NULL AND (b IS NOT NULL OR c IS NOT NULL) AS substituted FROM j"""

QUERIES = {
    f.__name__: f
    for f in (
        pmc_daily, resample_1hz, channel_grid, seeded_mean, stream_runs, normalized_power, load_metrics, mmp_curve, mmp_long, power_curve, critical_power, w_balance, work_above_cp, durability, trimp, trimp_zonal, hrv_time_domain,
        hrv_frequency_domain, decoupling, session_load, load_chain,
    )
}
ORACLE = {
    "pmc_daily": PMC, "resample_1hz": RESAMPLE, "channel_grid": GRID, "seeded_mean": SEEDED, "stream_runs": RUNS, "normalized_power": NORMALIZED, "load_metrics": LOAD_METRICS, "mmp_curve": MMP, "mmp_long": MMP_LONG, "power_curve": POWER_CURVE,
    "critical_power": CRITICAL, "w_balance": WBAL, "work_above_cp": WORK, "durability": DURABILITY, "trimp": TRIMP, "trimp_zonal": ZONAL, "hrv_time_domain": HRV, "hrv_frequency_domain": SPECTRUM, "decoupling": DECOUPLING,
    "session_load": SRPE, "load_chain": CHAIN,
}
