"""Queries of the serving and text-checking operators, with the SQL that gives the same rows."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strideframe.operators import load, power, serve, series, text
from strideframe.plans import metrics
from strideframe.sources import fixtures as fx

ON = "2024-01-25"


def keyset_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page of fifty orders after a cursor, the dearest first."""
    o = fx.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", F.to_date("o_orderdate").alias("day"))
    return serve.keyset_page(o, [("o_totalprice", True), ("day", True), ("o_orderkey", False)], 50, (300000.0, date(1996, 1, 1), 0))


PAGE = """SELECT o_orderkey, o_custkey, o_totalprice, CAST(o_orderdate AS DATE) AS day FROM orders WHERE o_totalprice < 300000 OR (o_totalprice = 300000 AND (CAST(o_orderdate AS DATE) < DATE '1996-01-01'
OR (CAST(o_orderdate AS DATE) = DATE '1996-01-01' AND o_orderkey > 0))) ORDER BY o_totalprice DESC, day DESC, o_orderkey LIMIT 51"""


def nullable_sort_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = fx.table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, F.to_date("o_orderdate")).alias("target"))
    return serve.keyset_page(o.withColumn("axis", serve.nullable_axis("target")), [("axis", True), ("o_orderkey", False)], 100)


NULLABLE = """SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderdate AS DATE) END AS target, coalesce(CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderdate AS DATE) END, DATE '0001-01-01') AS axis
FROM orders ORDER BY axis DESC, o_orderkey LIMIT 101"""


def topk_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "text")
    out = serve.ranked_recall(c, ["thea", "ingth", "restha"], "text", "turn", "conv_id", 25)
    return out.select("conv_id", "turn", "hits")


RECALL = """SELECT conv_id, turn, CAST(contains(lower(text), 'thea') AS INT) + CAST(contains(lower(text), 'ingth') AS INT) + CAST(contains(lower(text), 'restha') AS INT) AS hits
FROM conversations ORDER BY hits DESC, turn DESC, conv_id LIMIT 25"""


def decimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serve.decimated(fx.short_stream(spark, sf_dir), ["power", "hr"], 12).select("key", "t")


DECIMATE = f"""WITH {fx.SHORT}, n AS (SELECT key, count(*) AS n, arg_min(t, (power, t)) FILTER (power IS NOT NULL) AS a, arg_min(t, (-power, t)) FILTER (power IS NOT NULL) AS b, arg_min(t, (hr, t)) AS c, arg_min(t, (-hr, t)) AS d FROM short GROUP BY 1),
k AS (SELECT key, CAST(floor(j * n / least(12, n)) AS BIGINT) AS t FROM n, range(0, 12) r(j) WHERE j < least(12, n) UNION SELECT key, n - 1 FROM n UNION SELECT key, a FROM n UNION SELECT key, b FROM n UNION SELECT key, c FROM n UNION SELECT key, d FROM n)
SELECT key, t FROM k WHERE t IS NOT NULL"""


def track(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's walk of values and counters, simplified to ten points."""
    e = fx.short_stream(spark, sf_dir).where("power IS NOT NULL")
    walk = Window.partitionBy("key").orderBy("t")
    points = e.select("key", "t", (F.sum("power").over(walk) / 1e6).alias("lat"), (F.sum("hr").over(walk) / 1e6).alias("lng"))
    return serve.simplified_track(points, 10).select("key", "t")


#: A point's weight is the least of the distances at which it and the splits above it were made; a tolerance keeps what weighs more.
TRACK = f"""WITH RECURSIVE {fx.SHORT}, w AS (SELECT key, t, sum(power) OVER o / 1e6 AS x, sum(hr) OVER o / 1e6 AS y, row_number() OVER o - 1 AS i, count(*) OVER (PARTITION BY key) AS n FROM short WHERE power IS NOT NULL WINDOW o AS (PARTITION BY key ORDER BY t)),
s AS (SELECT key, CAST(0 AS BIGINT) AS a, n - 1 AS b, CAST('inf' AS DOUBLE) AS weight, 2 AS side FROM w WHERE i = 0
  UNION ALL SELECT key, CASE side WHEN 0 THEN a ELSE far END, CASE side WHEN 0 THEN far ELSE b END, weight, side FROM
    (SELECT key, a, b, -(f.i) AS far, least(weight, f.d) AS weight FROM
      (SELECT key, a, b, weight, max({{'d': d, 'i': -i}}) AS f FROM
        (SELECT s.key, s.a, s.b, s.weight, p.i, CASE WHEN l.x = r.x AND l.y = r.y THEN sqrt(pow(p.x - l.x, 2) + pow(p.y - l.y, 2)) ELSE abs((r.x - l.x) * (p.y - l.y) - (r.y - l.y) * (p.x - l.x)) / sqrt(pow(r.x - l.x, 2) + pow(r.y - l.y, 2)) END AS d
         FROM s JOIN w p ON p.key = s.key AND p.i > s.a AND p.i < s.b JOIN w l ON l.key = s.key AND l.i = s.a JOIN w r ON r.key = s.key AND r.i = s.b)
       GROUP BY 1, 2, 3, 4)) CROSS JOIN (VALUES (0), (1)) c(side) WHERE weight > 1e-6),
k AS (SELECT key, b AS i, weight FROM s WHERE side = 0), e AS (SELECT 1e-6 * pow(2, unnest(range(20))) AS e),
c AS (SELECT z.key, e, 2 + count(k.weight) AS m FROM (SELECT key FROM w WHERE i = 0) z CROSS JOIN e LEFT JOIN k ON k.key = z.key AND k.weight > e GROUP BY 1, 2),
b AS (SELECT key, coalesce(min(e) FILTER (m <= 10), max(e)) AS e FROM c GROUP BY 1)
SELECT w.key, w.t FROM w JOIN b ON b.key = w.key LEFT JOIN k ON k.key = w.key AND k.i = w.i WHERE n <= 10 OR w.i = 0 OR w.i = n - 1 OR k.weight > e"""


def dashboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = load.pmc(load.daily_grid(fx.daily_loads(spark, sf_dir), "2024-01-31")).select("key", "day", "load", "ctl", "atl", "tsb")
    out = serve.dashboard(days, F.to_date(F.lit(ON)))
    return out.select("key", "day", *(F.round(c, 5).alias(c) for c in ("ctl", "atl", "tsb", "ctl_change", "atl_change", "tsb_change", "week_load")), "known_days")


_PMC_HEAD, _PMC_TAIL = metrics.PMC.split("SELECT key, day, round(load, 6)")
DASHBOARD = f"""{_PMC_HEAD.rstrip()}, d AS (SELECT key, day, ctl, atl, tsb, ctl - lag(ctl, 7) OVER w AS c7, atl - lag(atl, 7) OVER w AS a7, tsb - lag(tsb, 7) OVER w AS t7,
sum(load) OVER k AS wl, count(load) OVER k AS known_days FROM p WINDOW w AS (PARTITION BY key ORDER BY day), k AS (PARTITION BY key ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW))
SELECT key, day, round(ctl, 5) AS ctl, round(atl, 5) AS atl, round(tsb, 5) AS tsb, round(c7, 5) AS ctl_change, round(a7, 5) AS atl_change, round(t7, 5) AS tsb_change, round(wl, 5) AS week_load, known_days FROM d WHERE day = DATE '{ON}'"""


def coverage_diagnosis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which inputs each user has: a load, a power curve, a normalized power, a heart-rate stream in range, a threshold."""
    smooth = series.seeded_mean(fx.short_stream(spark, sf_dir), "power", 30, "r")
    flags = smooth.groupBy("key").agg(
        (F.count("r") > 0).alias("power_curve"), (F.pow(F.avg(F.pow("r", F.lit(4.0))), F.lit(0.25)) > 300).alias("critical_power"), (F.max("hr") > 198).alias("hrv")
    )
    loads = fx.events(spark, sf_dir).where("value <= 100 AND user_id % 4 <> 0").select(F.col("user_id").alias("key")).distinct().withColumn("training_load", F.lit(True))
    signed = fx.table(spark, sf_dir, "customer").where("c_custkey % 5 = 0").select(F.col("c_custkey").alias("key"), F.lit(True).alias("signature"))
    flags = flags.join(loads, "key", "left").join(signed, "key", "left")
    return serve.coverage_of(flags, ("training_load", "power_curve", "critical_power", "hrv", "signature")).select("key", F.array_join("present", ",").alias("present"), F.array_join("missing", ",").alias("missing"), "status")


DIAGNOSIS = f"""WITH {metrics._NP}, runs AS (SELECT DISTINCT key FROM r WHERE m IS NOT NULL), i(input) AS (VALUES ('training_load'), ('power_curve'), ('critical_power'), ('hrv'), ('signature')),
f AS (SELECT DISTINCT user_id AS key, 'training_load' AS input FROM events WHERE value <= 100 AND user_id % 4 <> 0 UNION SELECT key, 'power_curve' FROM runs UNION SELECT key, 'critical_power' FROM np WHERE reason IS NULL AND raw > 300
UNION SELECT DISTINCT key, 'hrv' FROM short WHERE hr > 198 UNION SELECT c_custkey, 'signature' FROM customer WHERE c_custkey % 5 = 0),
k AS (SELECT DISTINCT key FROM short), x AS (SELECT k.key, i.input, f.input IS NOT NULL AS has FROM k CROSS JOIN i LEFT JOIN f ON f.key = k.key AND f.input = i.input)
SELECT key, coalesce(string_agg(input, ',' ORDER BY input) FILTER (has), '') AS present, coalesce(string_agg(input, ',' ORDER BY input) FILTER (NOT has), '') AS missing, CASE WHEN bool_or(has) THEN 'completed' ELSE 'degraded' END AS status FROM x GROUP BY 1"""


def coverage_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inputs of each user over the two weeks up to a day; orders of the customer of the same number are signatures."""
    e = fx.events(spark, sf_dir).withColumns({"key": F.col("user_id"), "day": F.to_date("ts")})
    on = F.to_date(F.lit(ON))
    order = Window.partitionBy("key").orderBy("ts", "event_id")
    lately = e.where(F.col("day").between(F.date_sub(on, 14), on))
    stream = lately.select("key", (F.row_number().over(order) - 1).alias("t"), F.when(F.col("value") <= 200, F.col("value") * 5).alias("power"))
    fits = power.critical_power(power.mean_maximal_power(stream, RECENT_POINTS), (2, 8), least_ratio=1.5)
    curve = e.where("event_type = 'purchase'").groupBy("key", "day").agg(F.max(F.when(F.col("value") > 60, F.col("value"))).alias("best_w"))
    hrv = e.select("key", "day", F.when(F.col("k") > 30, F.col("k").cast("double")).alias("value"))
    signed = fx.signatures(spark, sf_dir).select("key", "effective_date", F.when(F.col("ftp_w") > 250, F.col("ftp_w")).alias("ftp_w"), F.when(F.col("fit_r2") > 0.7, F.col("ftp_w") * 0.9).alias("cp_w"))
    days = load.pmc(load.daily_grid(fx.daily_loads(spark, sf_dir), ON))
    out = serve.recent_coverage(e.select("key"), on, days, curve, fits, hrv, signed, 14, 25.0)
    return out.select("key", F.array_join("present", ",").alias("present"), F.array_join("missing", ",").alias("missing"), "status")


RECENT_POINTS = (2, 4, 8)
RECENT = f"""{_PMC_HEAD.rstrip()}, {fx.SIGNATURES}, lately AS (SELECT user_id AS key, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS t, CASE WHEN value <= 200 THEN value * 5 END AS power
  FROM events WHERE CAST(ts AS DATE) BETWEEN DATE '{ON}' - 14 AND DATE '{ON}'), {metrics._curve_sql('lately', RECENT_POINTS)},
fit AS (SELECT key, count(*) AS n, max(d) / min(d) AS ratio, (max(m) - min(m)) / max(m) AS spread, regr_slope(m * d, CAST(d AS DOUBLE)) AS cp, regr_intercept(m * d, CAST(d AS DOUBLE)) AS wp, regr_r2(m * d, CAST(d AS DOUBLE)) AS r2 FROM best WHERE k = 1 GROUP BY 1),
latest AS (SELECT key, ftp_w, fit_r2 FROM signatures WHERE effective_date <= DATE '{ON}' QUALIFY row_number() OVER (PARTITION BY key ORDER BY effective_date DESC) = 1),
f AS (SELECT DISTINCT key, 'training_load' AS input FROM p WHERE ctl >= 25 AND day BETWEEN DATE '{ON}' - 14 AND DATE '{ON}'
  UNION SELECT DISTINCT user_id, 'power_curve' FROM events WHERE event_type = 'purchase' AND value > 60 AND CAST(ts AS DATE) BETWEEN DATE '{ON}' - 14 AND DATE '{ON}'
  UNION SELECT key, 'critical_power' FROM fit WHERE n >= 3 AND ratio >= 1.5 AND spread >= 1e-6 AND r2 >= 0.95 AND cp > 0 AND wp > 0
  UNION SELECT user_id, 'hrv' FROM events WHERE CAST(ts AS DATE) = DATE '{ON}' AND CAST(regexp_extract(props, '[0-9]+') AS INT) > 30
  UNION SELECT key, 'signature' FROM latest WHERE ftp_w > 250 OR fit_r2 > 0.7),
i(input) AS (VALUES ('training_load'), ('power_curve'), ('critical_power'), ('hrv'), ('signature')), k AS (SELECT DISTINCT user_id AS key FROM events),
x AS (SELECT k.key, i.input, f.input IS NOT NULL AS has FROM k CROSS JOIN i LEFT JOIN f ON f.key = k.key AND f.input = i.input)
SELECT key, coalesce(string_agg(input, ',' ORDER BY input) FILTER (has), '') AS present, coalesce(string_agg(input, ',' ORDER BY input) FILTER (NOT has), '') AS missing, CASE WHEN bool_or(has) THEN 'completed' ELSE 'degraded' END AS status FROM x GROUP BY 1"""


def readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = fx.events(spark, sf_dir).select(F.col("event_id").alias("key"), F.when(F.col("k") != 7, F.col("k") - 60.0).alias("form"), F.when(F.col("k") % 5 > 0, F.col("value")).alias("hrv_rmssd"), F.when(F.col("k") % 7 > 0, F.lit(50.0)).alias("hrv_baseline"))
    return serve.readiness(e)


READINESS = """WITH e AS (SELECT event_id AS key, CASE WHEN k <> 7 THEN k - 60.0 END AS form, CASE WHEN k % 5 > 0 THEN value END AS r, CASE WHEN k % 7 > 0 THEN 50.0 END AS b FROM (SELECT *, CAST(regexp_extract(props, '[0-9]+') AS INT) AS k FROM events)),
f AS (SELECT *, CASE WHEN form > 5 THEN 0 WHEN form >= -10 THEN 1 WHEN form >= -20 THEN 2 ELSE 3 END AS s, coalesce(r IS NOT NULL AND b > 0, false) AS u, coalesce(r < 0.9 * b, false) AS low FROM e)
SELECT key, CASE WHEN form IS NOT NULL THEN (['GO', 'MAINTAIN', 'EASE', 'REST'])[CAST(least(s + CAST(low AS INT), 3) + 1 AS INT)] END AS verdict,
CASE WHEN form IS NULL THEN 'form_unavailable' WHEN low THEN 'hrv_suppressed' ELSE 'form' END AS rationale, NOT u AS hrv_unavailable FROM f"""


def sufficiency(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = fx.events(spark, sf_dir).groupBy(F.col("user_id").alias("key")).agg(F.max(F.when(F.col("event_type") == "purchase", F.to_date("ts"))).alias("last_day"), F.bool_or(F.col("k") > 98).alias("suspect"))
    return serve.sufficiency(e, F.to_date(F.lit("2024-01-31")))


SUFFICIENCY = """WITH e AS (SELECT user_id AS key, max(CAST(ts AS DATE)) FILTER (event_type = 'purchase') AS d, bool_or(CAST(regexp_extract(props, '[0-9]+') AS INT) > 98) AS s FROM events GROUP BY 1),
f AS (SELECT key, greatest(0, DATE '2024-01-31' - d) AS n, d, coalesce(greatest(0, DATE '2024-01-31' - d) > 2 AND s, false) AS stale, d IS NULL OR coalesce(greatest(0, DATE '2024-01-31' - d) > 14 AND s, false) AS short FROM e)
SELECT key, CASE WHEN d IS NOT NULL THEN CAST(n AS INT) END AS staleness_days, stale, short AS insufficient, CASE WHEN short THEN 'degraded' WHEN stale THEN 'partial' ELSE 'full' END AS fidelity FROM f"""


def endurance_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = load.pmc(load.daily_grid(fx.daily_loads(spark, sf_dir), "2024-01-31")).where(f"day = DATE '{ON}'").select("key", "ctl")
    curve = power.mean_maximal_power(fx.short_stream(spark, sf_dir), (5, 30)).groupBy("key").agg((F.max(F.when(F.col("duration_s") == 30, F.col("best_w"))) / F.max(F.when(F.col("duration_s") == 5, F.col("best_w")))).alias("shape_ratio"))
    parts = days.join(curve, "key", "left").withColumn("decoupling_pct", F.when(F.col("key") % 3 > 0, (F.col("key") % 50 - 20) / 5.0))
    out = power.endurance_score(parts)
    return out.select("key", "reason", F.round("score", 5).alias("score"), F.round("confidence", 3).alias("confidence"))


ENDURANCE = f"""{_PMC_HEAD.rstrip()}, {fx.SHORT}, {metrics._curve_sql('short', (5, 30))}, c AS (SELECT key, max(m) FILTER (d = 30) / max(m) FILTER (d = 5) AS s FROM legs GROUP BY 1),
j AS (SELECT p.key, ctl, s, CASE WHEN p.key % 3 > 0 THEN (p.key % 50 - 20) / 5.0 END AS dc FROM p LEFT JOIN c ON p.key = c.key WHERE day = DATE '{ON}'),
w AS (SELECT key, 0.4 * least(greatest(ctl / 100, 0), 1) + CASE WHEN s IS NULL THEN 0 ELSE 0.3 * least(greatest((s - 0.5) / 0.5, 0), 1) END + CASE WHEN dc IS NULL THEN 0 ELSE 0.3 * least(greatest(1 - dc / 10, 0), 1) END AS t,
0.4 + CASE WHEN s IS NULL THEN 0 ELSE 0.3 END + CASE WHEN dc IS NULL THEN 0 ELSE 0.3 END AS v, s IS NOT NULL AND dc IS NOT NULL AS whole FROM j)
SELECT key, CAST(NULL AS VARCHAR) AS reason, round(CAST(100 * t / v AS DOUBLE), 5) AS score, round(CAST(CASE WHEN whole THEN 1.0 ELSE 0.7 END AS DOUBLE), 3) AS confidence FROM w"""


def quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = serve.quantiles(fx.events(spark, sf_dir), ["event_type"], "value")
    return out.select("event_type", "n", F.round("median", 6).alias("median"), F.round("p95", 6).alias("p95"))


QUANTILES = "SELECT event_type, count(*) AS n, round(median(value), 6) AS median, round(quantile_disc(value, 0.95), 6) AS p95 FROM events GROUP BY 1"


def conformal(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id")
    examples = d.select((F.col("doc_id") % 5).cast("string").alias("example_id"), F.col("lang").alias("group"), ((F.col("n_chars") % 1000) / 1000).alias("score"), (F.col("quality") == 1).alias("supported"))
    examples = examples.withColumn("example_id", F.concat_ws("-", "example_id", (F.col("score") * 10).cast("int")))
    return serve.conformal_thresholds(examples, 0.1).select("group", "n", F.round("threshold", 6).alias("threshold"))


CONFORMAL = """WITH e AS (SELECT concat_ws('-', documents.doc_id % 5, CAST(trunc((n_chars % 1000) / 1000.0 * 10) AS INT)) AS ex, lang AS g, (n_chars % 1000) / 1000.0 AS s, quality = 1 AS ok FROM documents JOIN labels ON documents.doc_id = labels.doc_id),
p AS (SELECT g, ex, coalesce(max(s) FILTER (NOT ok), 0) AS s FROM e GROUP BY 1, 2), r AS (SELECT g, s, row_number() OVER (PARTITION BY g ORDER BY s) AS k, count(*) OVER (PARTITION BY g) AS n FROM p)
SELECT g AS "group", n, round(CAST(coalesce(min(s) FILTER (k >= ceil((n + 1) * 0.9)), 1.0) AS DOUBLE), 6) AS threshold FROM r GROUP BY g, n"""


def label_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id")
    out = serve.rates(d, ["lang"], F.col("n_chars") > 2000, F.col("quality") == 1)
    return out.select("lang", "n", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"), "all_agree")


RATES = """SELECT lang, count(*) AS n, round(count(*) FILTER (n_chars > 2000 AND quality = 1) / nullif(count(*) FILTER (n_chars > 2000), 0), 6) AS precision,
round(count(*) FILTER (n_chars > 2000 AND quality = 1) / nullif(count(*) FILTER (quality = 1), 0), 6) AS recall, bool_and((n_chars > 2000) = (quality = 1)) AS all_agree FROM documents JOIN labels ON documents.doc_id = labels.doc_id GROUP BY 1"""


def regression_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = fx.events(spark, sf_dir)
    early = F.to_date("ts") < F.to_date(F.lit("2024-01-16"))
    run = lambda rows: rows.groupBy(F.col("user_id").alias("metric")).agg(F.avg("value").alias("value"))
    out = serve.regressions(run(e.where(early)), run(e.where(~early)), ["metric"])
    return out.select("metric", F.round("base", 6).alias("base"), F.round("now", 6).alias("now"), "status")


REGRESSION = """WITH a AS (SELECT user_id AS metric, avg(value) AS base FROM events WHERE CAST(ts AS DATE) < DATE '2024-01-16' GROUP BY 1),
b AS (SELECT user_id AS metric, avg(value) AS now FROM events WHERE CAST(ts AS DATE) >= DATE '2024-01-16' GROUP BY 1)
SELECT coalesce(a.metric, b.metric) AS metric, round(base, 6) AS base, round(now, 6) AS now, CASE WHEN base IS NULL THEN 'new' WHEN now IS NULL THEN 'gone' WHEN now < base - 1e-9 THEN 'regressed' ELSE 'kept' END AS status FROM a FULL JOIN b ON a.metric = b.metric"""


def export_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: spark.read.parquet(f"{sf_dir}/{n}.parquet")
    return serve.export_rows({"region": t("region"), "nation": t("nation"), "customer": t("customer").select("c_custkey", "c_name", "c_nationkey")})


EXPORT = """SELECT 'region' AS "table", '{"r_regionkey":' || r_regionkey || ',"r_name":"' || r_name || '"}' AS row FROM region
UNION ALL SELECT 'nation', '{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '","n_regionkey":' || n_regionkey || '}' FROM nation
UNION ALL SELECT 'customer', '{"c_custkey":' || c_custkey || ',"c_name":"' || c_name || '","c_nationkey":' || c_nationkey || '}' FROM customer"""


def number_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return text.numbers(d, "doc_id", "text").select("doc_id", "place", "token")


SWEEP = r"""WITH w AS (SELECT doc_id, generate_subscripts(p, 1) - 1 AS place, unnest(p) AS word FROM (SELECT doc_id, string_split_regex(regexp_replace(coalesce(text, ''), 'https?://[^\s<>"'')\]]+', ' ', 'g'), '[\t\n\x0B\f\r ]+') AS p FROM documents))
SELECT doc_id, CAST(place AS BIGINT) AS place, regexp_extract(word, '^[(\["'']*(-?[0-9]+(?:[.][0-9]+)?)[.,;:!?)\]"'']*$', 1) AS token FROM w WHERE token <> ''"""


def url_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return p.select("page_id", text.normal_link(F.col("url")).alias("url"), text.allowed_link(F.col("url"), ["m.ththth.example.net", "thther.example.org"]).alias("allowed"))


URLS = r"""WITH t AS (SELECT page_id, url, regexp_replace(regexp_replace(url, '^\s+|\s+$', '', 'g'), '/+$', '') AS u FROM pages), s AS (SELECT *, strpos(u, '://') AS p FROM t), h AS (SELECT *, strpos(substr(u, p + 3), '/') AS q FROM s)
SELECT page_id, CASE WHEN p = 0 OR q = 0 THEN lower(u) ELSE lower(left(u, p + q + 1)) || substr(u, p + q + 2) END AS url, coalesce(regexp_extract(lower(trim(url)), '^https://(?:[^/?#]*@)?([^/?#:@]*)', 1) IN ('m.ththth.example.net', 'thther.example.org'), false) AS allowed FROM h"""


def _claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = fx.events(spark, sf_dir)
    latest = Window.partitionBy("user_id").orderBy("ts", "event_id")
    canonical = F.lag("value").over(latest)
    return e.select(
        "event_id", "user_id", F.when(F.col("k") != 3, canonical * (1 + (F.col("k") - 50) / 2000)).alias("value"), (F.col("k") % 10 == 0).alias("prescriptive"), (F.col("k") % 20 == 0).alias("echo"), F.when(F.col("k") % 9 > 0, canonical).alias("canonical")
    )


_CLAIMS = """c AS (SELECT event_id, user_id, CASE WHEN k <> 3 THEN x * (1 + (k - 50) / 2000.0) END AS value, k % 10 = 0 AS pr, k % 20 = 0 AS ec, CASE WHEN k % 9 > 0 THEN x END AS canonical FROM
(SELECT *, CAST(regexp_extract(props, '[0-9]+') AS INT) AS k, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS x FROM events)),
v AS (SELECT *, CASE WHEN value IS NULL THEN 'ungrounded' WHEN pr OR canonical IS NULL THEN CASE WHEN ec THEN 'echo' ELSE 'ungrounded' END
WHEN abs(value - canonical) <= greatest(0.02 * greatest(abs(value), abs(canonical)), 0.05) THEN 'grounded' ELSE 'contradicted' END AS verdict FROM c)"""


def claim_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.verify_numbers(_claims(spark, sf_dir)).select("event_id", "verdict", "rewritten")


#: printf rounds the exact value of a double half to even.
VERIFY = f"""WITH {_CLAIMS} SELECT event_id, verdict, CASE WHEN verdict IN ('grounded', 'contradicted') THEN regexp_replace(regexp_replace(printf('%.1f', canonical), '\\.0$', ''), '^-0$', '0') END AS rewritten FROM v"""


def decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    claims = text.verify_numbers(_claims(spark, sf_dir)).withColumn("answer", F.floor(F.col("event_id") / 3))
    return text.decision(claims, ["answer"])


DECISION = f"""WITH {_CLAIMS}, d AS (SELECT CAST(floor(event_id / 3) AS BIGINT) AS answer, bool_or(verdict = 'contradicted') AS bad, bool_or(verdict IN ('grounded', 'echo')) AS good, bool_or(verdict = 'ungrounded') AS open,
bool_or(verdict = 'ungrounded' AND value IS NOT NULL AND NOT pr) AS gap, count(*) AS n FROM v GROUP BY 1)
SELECT answer, CASE WHEN bad THEN 'regenerate' WHEN NOT good THEN CASE WHEN gap THEN 'replan' ELSE 'abstain' END WHEN open THEN 'regenerate' ELSE 'proceed' END AS decision, n FROM d"""


def constraint_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.concat_ws("-", "conv_id", "turn").alias("id"), "text")
    return text.constraint_gate(c, "id", "text", ["heat", "hashe"], ["thea", "restre", "ha"], ["not", "that", "by"])


_GATE = r"""WITH s AS (SELECT conv_id || '-' || turn AS id, string_split(regexp_replace(regexp_replace(coalesce(text, ''), '([.!?])[ \t\n\x0B\f\r]+', '\1' || chr(1), 'g'), '\n+', chr(1), 'g'), chr(1)) AS ss FROM conversations),
p AS (SELECT id, generate_subscripts(ss, 1) - 1 AS place, unnest(ss) AS s FROM s), w AS (SELECT id, place, list_filter(string_split_regex(lower(s), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS ws FROM p),
u AS (SELECT id, place, generate_subscripts(ws, 1) AS i, unnest(ws) AS w FROM w), n AS (SELECT id, place, i FROM u WHERE w IN ('not', 'that', 'by')),
h AS (SELECT u.id, u.place, u.i, bool_or(u.w IN ('heat', 'hashe')) AS hard, count(n.i) AS negated FROM u LEFT JOIN n ON n.id = u.id AND n.place = u.place AND abs(n.i - u.i) <= 4
WHERE u.w IN ('heat', 'hashe', 'thea', 'restre', 'ha') GROUP BY 1, 2, 3)
SELECT id, CAST(place AS BIGINT) AS place, CASE WHEN bool_or(hard) THEN 'remove' ELSE 'caution' END AS action FROM h WHERE negated = 0 GROUP BY 1, 2"""


def day_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An addition to the reference's operators: events in tumbling windows of six hours."""
    w = fx.events(spark, sf_dir).groupBy(F.window("ts", "6 hours"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("value"))
    return w.select(F.unix_timestamp("window.start").alias("from_s"), "event_type", "n", "value")


TUMBLING = "SELECT CAST(epoch(time_bucket(INTERVAL 6 HOURS, ts)) AS BIGINT) AS from_s, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY 1, 2"


def user_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An addition to the reference's operators: sessions of a user's events, closed by eight hours without one."""
    w = fx.events(spark, sf_dir).groupBy("user_id", F.session_window("ts", "8 hours")).agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_event"))
    return w.select("user_id", F.floor(F.unix_timestamp("session_window.start")).alias("from_s"), "n", "first_event")


USER_SESSIONS = """WITH m AS (SELECT *, CASE WHEN ts < lag(ts) OVER w + INTERVAL 8 HOURS THEN 0 ELSE 1 END AS o FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(o) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM m)
SELECT user_id, CAST(floor(epoch(min(ts))) AS BIGINT) AS from_s, count(*) AS n, min(event_id) AS first_event FROM s GROUP BY user_id, k"""


def load_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An addition to the reference's operators: load by week and user group with subtotals."""
    e = fx.events(spark, sf_dir).select((F.col("user_id") % 10).alias("grp"), F.to_date(F.date_trunc("week", "ts")).alias("week"), "value")
    return e.rollup("grp", "week").agg(F.round(F.sum("value"), 3).alias("load"), F.count(F.lit(1)).alias("n"))


ROLLUP = "SELECT user_id % 10 AS grp, CAST(date_trunc('week', ts) AS DATE) AS week, round(sum(value), 3) AS load, count(*) AS n FROM events GROUP BY ROLLUP (1, 2)"

QUERIES = {
    f.__name__: f
    for f in (
        keyset_page, nullable_sort_page, topk_recall, decimate, track, dashboard, coverage_diagnosis, coverage_recent, readiness, sufficiency, endurance_score, quantiles, conformal, label_rates, regression_diff, export_union, number_sweep, url_normalize,
        claim_verify, decision, constraint_gate, day_tumbling, user_sessions, load_rollup,
    )
}
ORACLE = {
    "keyset_page": PAGE, "nullable_sort_page": NULLABLE, "topk_recall": RECALL, "decimate": DECIMATE, "track": TRACK, "dashboard": DASHBOARD, "coverage_diagnosis": DIAGNOSIS, "coverage_recent": RECENT, "readiness": READINESS, "sufficiency": SUFFICIENCY,
    "endurance_score": ENDURANCE, "quantiles": QUANTILES, "conformal": CONFORMAL, "label_rates": RATES, "regression_diff": REGRESSION, "export_union": EXPORT, "number_sweep": SWEEP, "url_normalize": URLS,
    "claim_verify": VERIFY, "decision": DECISION, "constraint_gate": _GATE, "day_tumbling": TUMBLING, "user_sessions": USER_SESSIONS, "load_rollup": ROLLUP,
}
