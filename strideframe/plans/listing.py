"""Queries of lists, histories, charts and setup state, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strideframe.operators import listing, load, temporal
from strideframe.sources import fixtures as fx


def _activities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as activities, their local day on the wall clock of New York."""
    a, key = fx.activities(spark, sf_dir), F.col("activity_id")
    return a.withColumns(
        {
            "start": F.col("start") + F.make_dt_interval(hours=(key % 24).cast("int")), "moving_time_s": F.col("duration_s"), "elapsed_time_s": F.col("duration_s") + key % 600, "distance_m": F.col("duration_s") * 8,
            "avg_power_w": F.when(key % 3 == 0, 150 + key % 100), "has_power": key % 3 == 0, "has_hr": key % 2 == 0, "has_gps": key % 5 > 0, "device_class": F.when(key % 2 == 0, "watch").otherwise("power_meter"),
        }
    ).withColumn("local_date", temporal.local_day(F.col("start"), F.lit("America/New_York")))


ACTIVITIES = f"""{fx.ACTIVITIES}, acts AS (SELECT activity_id, athlete, sport, duration_s, start + to_hours(CAST(activity_id % 24 AS INTEGER)) AS start, duration_s AS moving_time_s, duration_s + activity_id % 600 AS elapsed_time_s, duration_s * 8 AS distance_m,
  CASE WHEN activity_id % 3 = 0 THEN 150 + activity_id % 100 END AS avg_power_w, activity_id % 3 = 0 AS has_power, activity_id % 2 = 0 AS has_hr, activity_id % 5 > 0 AS has_gps, CASE WHEN activity_id % 2 = 0 THEN 'watch' ELSE 'power_meter' END AS device_class,
  CAST((start + to_hours(CAST(activity_id % 24 AS INTEGER))) AT TIME ZONE 'UTC' AT TIME ZONE 'America/New_York' AS DATE) AS local_date FROM activities)"""
FIELDS = "activity_id, local_date, sport, CAST(epoch(start) AS BIGINT) AS start_s, elapsed_time_s, moving_time_s, distance_m, avg_power_w, has_power, has_hr, has_gps"


def _summary(rows: DataFrame) -> DataFrame:
    return listing.summaries(rows).withColumn("start", F.unix_timestamp("start")).withColumnRenamed("start", "start_s")


def activity_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cycling with power of 1996 and 1997 that lasted half an hour, from a power meter."""
    rows = listing.filtered(_activities(spark, sf_dir), first="1996-01-01", last="1997-12-31", sport="cycling", least_moving_s=1800, has_power=True, device_class="power_meter")
    return _summary(rows)


LIST = f"""WITH {ACTIVITIES} SELECT {FIELDS} FROM acts WHERE start >= TIMESTAMP '1996-01-01' AND start < TIMESTAMP '1998-01-01' AND sport = 'cycling' AND moving_time_s >= 1800 AND has_power AND device_class = 'power_meter'"""


def local_day_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Activities of the local days around both changes of the clock in 1997."""
    rows = _activities(spark, sf_dir)
    return _summary(listing.in_local_days(rows, "1997-04-04", "1997-04-08").unionByName(listing.in_local_days(rows, "1997-10-24", "1997-10-28")))


LOCAL = f"WITH {ACTIVITIES} SELECT {FIELDS} FROM acts WHERE local_date BETWEEN DATE '1997-04-04' AND DATE '1997-04-08' OR local_date BETWEEN DATE '1997-10-24' AND DATE '1997-10-28'"


def lap_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as laps of their order."""
    laps = fx.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("activity_id"), F.concat_ws("-", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("lap_id"), F.col("l_shipdate").alias("start"), F.col("l_quantity").alias("avg_power_w"))
    return listing.lap_rows(laps, fx.activities(spark, sf_dir)).drop("lap_id")


OFFSETS = """SELECT l_orderkey AS activity_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, concat_ws('-', l_linenumber, l_partkey, l_suppkey, l_extendedprice)) - 1 AS lap_index,
CAST(epoch(l_shipdate) - epoch(o_orderdate) AS BIGINT) AS start_offset_s, l_quantity AS avg_power_w FROM lineitem JOIN orders ON o_orderkey = l_orderkey"""


def constraints_active(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as constraints; those in force on 20 January, in order."""
    e, key = fx.events(spark, sf_dir), F.col("event_id")
    rows = e.select(key.alias("constraint_id"), F.col("ts").alias("created_at"), F.when(key % 4 == 0, "hard").otherwise("soft").alias("severity"), F.when(key % 3 == 0, "active").when(key % 3 == 1, "retired").alias("status"), F.when(key % 2 == 0, F.col("ts") + F.expr("interval 9 days")).alias("until"))
    return listing.active_constraints(rows, F.lit("2024-01-20").cast("timestamp")).select("constraint_id", "severity")


CONSTRAINTS = """SELECT event_id AS constraint_id, CASE WHEN event_id % 4 = 0 THEN 'hard' ELSE 'soft' END AS severity FROM events WHERE event_id % 3 <> 1 AND (event_id % 2 <> 0 OR ts + INTERVAL 9 DAYS > TIMESTAMP '2024-01-20')"""


def _connections(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    key = F.col("s_suppkey")
    o = fx.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("athlete"), (F.col("o_orderkey") % 10).alias("source_descriptor_id"), "o_orderstatus", "o_orderdate", "o_orderkey")
    per = o.groupBy("athlete", "source_descriptor_id").agg(F.max_by("o_orderstatus", "o_orderkey").alias("s"), F.max("o_orderdate").alias("last"))
    status = F.when(F.col("s") == "F", "connected").when(F.col("s") == "O", "disconnected").otherwise("reauth_required")
    connections = per.select("athlete", "source_descriptor_id", status.alias("status"), F.when(F.col("athlete") % 6 > 0, F.col("last")).alias("last_synced_at"))
    return connections, fx.table(spark, sf_dir, "supplier").where("s_suppkey < 9").select(key.alias("source_descriptor_id"), F.col("s_name").alias("source_key"))


CONNECTIONS = """p AS (SELECT o_custkey AS athlete, o_orderkey % 10 AS d, max_by(o_orderstatus, o_orderkey) AS s, max(o_orderdate) AS last FROM orders GROUP BY 1, 2),
c AS (SELECT athlete, d, CASE s WHEN 'F' THEN 'connected' WHEN 'O' THEN 'disconnected' ELSE 'reauth_required' END AS status, CASE WHEN athlete % 6 > 0 THEN last END AS last_synced_at FROM p)"""


def connections_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    connections, descriptors = _connections(spark, sf_dir)
    return listing.usable_connections(connections, descriptors).select("athlete", "source_key")


DUE = f"WITH {CONNECTIONS} SELECT athlete, s_name AS source_key FROM c JOIN supplier ON s_suppkey = d AND s_suppkey < 9 WHERE status = 'connected'"


def source_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    connections, descriptors = _connections(spark, sf_dir)
    return listing.connected_sources(connections, descriptors).select("athlete", F.array_join("source_keys", ",").alias("source_keys"))


KEYS = f"WITH {CONNECTIONS} SELECT athlete, string_agg(DISTINCT s_name, ',' ORDER BY s_name) AS source_keys FROM c JOIN supplier ON s_suppkey = d AND s_suppkey < 9 GROUP BY 1"


def suspect_connections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.suspect(_connections(spark, sf_dir)[0], F.to_date(F.lit("1998-06-01")), 30)


SUSPECT = f"""WITH {CONNECTIONS} SELECT athlete, bool_or(status = 'reauth_required' OR (status = 'connected' AND (last_synced_at IS NULL OR DATE '1998-06-01' - CAST(last_synced_at AS DATE) > 30))) AS suspect FROM c GROUP BY 1"""


def goal_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.activities(spark, sf_dir).select(F.col("activity_id").alias("goal_id"), "athlete", "sport", F.when(F.col("activity_id") % 3 > 0, "open").otherwise("done").alias("status"), F.to_date("start").alias("target_date"))
    return listing.goals_in(rows, "open", "running", "1996-03-01", "1996-09-30")


GOALS = f"""WITH {fx.ACTIVITIES} SELECT activity_id AS goal_id, athlete, sport, 'open' AS status, CAST(start AS DATE) AS target_date FROM activities
WHERE activity_id % 3 > 0 AND sport = 'running' AND CAST(start AS DATE) BETWEEN DATE '1996-03-01' AND DATE '1996-09-30'"""


def plan_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as plans, their line items as days."""
    plans = fx.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("plan_id"), F.col("o_custkey").alias("athlete"), F.col("o_orderdate").alias("created_at"), F.when(F.col("o_orderstatus") == "O", "active").otherwise("draft").alias("status"))
    days = fx.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("plan_id"), F.to_date("l_shipdate").alias("day"), F.col("l_partkey").alias("workout"))
    return listing.schedule(plans, days, "1997-01-01", "1998-12-31").select("athlete", "plan_id", "day", "workout")


SCHEDULE = """WITH n AS (SELECT o_custkey AS athlete, max_by(o_orderkey, (o_orderdate, o_orderkey)) AS plan_id FROM orders WHERE o_orderstatus = 'O' GROUP BY 1)
SELECT athlete, plan_id, CAST(l_shipdate AS DATE) AS day, l_partkey AS workout FROM n JOIN lineitem ON l_orderkey = plan_id WHERE CAST(l_shipdate AS DATE) BETWEEN DATE '1997-01-01' AND DATE '1998-12-31'"""


def library(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as workouts of brands; brand-less ones are shared."""
    p = fx.table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_partkey") % 4 > 0, F.col("p_brand")).alias("athlete"), "p_name")
    return listing.owned_or_shared(p, "Brand#11")


LIBRARY = "SELECT p_partkey, CASE WHEN p_partkey % 4 > 0 THEN p_brand END AS athlete, p_name FROM part WHERE p_partkey % 4 = 0 OR p_brand = 'Brand#11'"


def threshold_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = fx.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("id"), F.to_date("o_orderdate").alias("effective_date"), F.col("o_totalprice").alias("ftp_w"))
    return listing.history(o, "1996-01-01", "1997-12-31")


HISTORY = """SELECT o_custkey AS key, o_orderkey AS id, CAST(o_orderdate AS DATE) AS effective_date, o_totalprice AS ftp_w, row_number() OVER (PARTITION BY o_custkey ORDER BY CAST(o_orderdate AS DATE), o_orderkey) AS place
FROM orders WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1996-01-01' AND DATE '1997-12-31'"""


def activity_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.span(_activities(spark, sf_dir))


SPAN = f"""WITH {ACTIVITIES} SELECT athlete, count(*) AS n, min_by(local_date, (start, activity_id)) AS first_day, max_by(local_date, (start, activity_id)) AS last_day, max_by(activity_id, (start, activity_id)) AS last_activity FROM acts GROUP BY 1"""


def _days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load.pmc(load.daily_grid(fx.daily_loads(spark, sf_dir)))


#: Fitness by recursion over the calendar grid.
_PMC = f"""{fx.DAILY}, span AS (SELECT key, min(day) AS a, max(day) AS b FROM daily GROUP BY 1), grid AS (SELECT key, CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS day FROM span),
g AS (SELECT grid.key, grid.day, CASE WHEN daily.key IS NULL THEN 0.0 ELSE daily.load END AS load, row_number() OVER (PARTITION BY grid.key ORDER BY grid.day) AS i FROM grid LEFT JOIN daily ON daily.key = grid.key AND daily.day = grid.day),
p AS (SELECT key, CAST(0 AS BIGINT) AS i, 0.0::DOUBLE AS ctl, 0.0::DOUBLE AS atl, 0.0::DOUBLE AS tsb FROM span UNION ALL
  SELECT g.key, g.i, ctl + (coalesce(load, 0) - ctl) * (1 - exp(-1 / 42.0)), atl + (coalesce(load, 0) - atl) * (1 - exp(-1 / 7.0)), ctl - atl FROM p JOIN g ON g.key = p.key AND g.i = p.i + 1),
days AS (SELECT g.key, g.day, g.load, ctl, atl, tsb FROM p JOIN g ON g.key = p.key AND g.i = p.i)"""


def latest_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.latest_form(_days(spark, sf_dir), 10.0).select("key", "day", F.round("form", 6).alias("form"))


FORM = f"WITH RECURSIVE {_PMC}, l AS (SELECT key, max(day) AS day, max_by(tsb, day) AS tsb, max_by(ctl, day) AS ctl FROM days GROUP BY 1) SELECT key, day, CASE WHEN ctl >= 10 THEN round(tsb, 6) END AS form FROM l"


def load_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.load_targets(_days(spark, sf_dir)).select("key", "day", F.round("weekly_target", 6).alias("weekly_target"), F.round("monthly_target", 6).alias("monthly_target"))


TARGETS = f"WITH RECURSIVE {_PMC} SELECT key, day, round(7 * ctl, 6) AS weekly_target, round(28 * ctl, 6) AS monthly_target FROM days"


def fitness_chart(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = listing.fitness_points(_days(spark, sf_dir), fx.daily_loads(spark, sf_dir))
    return points.select("key", "day", *(F.round(c, 6).alias(c) for c in ("ctl", "atl", "tsb", "day_load")), "provisional")


FITNESS = f"""WITH RECURSIVE {_PMC} SELECT d.key, d.day, round(ctl, 6) AS ctl, round(atl, 6) AS atl, round(tsb, 6) AS tsb, round(l.load, 6) AS day_load, l.load IS NULL AS provisional
FROM days d LEFT JOIN daily l ON l.key = d.key AND l.day = d.day"""


def seeded_pmc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """January 10 to 20, carried on from fitness 40 and fatigue 55."""
    grid = load.daily_grid(fx.daily_loads(spark, sf_dir))
    rows = listing.seeded_window(grid, "2024-01-10", "2024-01-20", 40.0, 55.0).withColumn("seed", F.lit("given"))
    bare = listing.seeded_window(grid, "2024-01-10", "2024-01-20").withColumn("seed", F.lit("none"))
    return rows.unionByName(bare).select("seed", "key", "day", *(F.round(c, 6).alias(c) for c in ("ctl", "atl", "tsb")), "reason")


SEEDED = f"""WITH RECURSIVE {_PMC.split("p AS (SELECT")[0]} w AS (SELECT key, day, load, row_number() OVER (PARTITION BY key ORDER BY day) AS j FROM g WHERE day BETWEEN DATE '2024-01-10' AND DATE '2024-01-20'),
s(seed, c0, a0) AS (VALUES ('given', 40.0::DOUBLE, 55.0::DOUBLE), ('none', 0.0::DOUBLE, 0.0::DOUBLE)),
q AS (SELECT seed, key, CAST(0 AS BIGINT) AS j, c0 AS ctl, a0 AS atl, 0.0::DOUBLE AS tsb FROM s, (SELECT DISTINCT key FROM w) UNION ALL
  SELECT seed, w.key, w.j, ctl + (coalesce(load, 0) - ctl) * (1 - exp(-1 / 42.0)), atl + (coalesce(load, 0) - atl) * (1 - exp(-1 / 7.0)), ctl - atl FROM q JOIN w ON w.key = q.key AND w.j = q.j + 1),
o AS (SELECT seed, w.key, w.day, ctl, atl, tsb, seed = 'none' AND a < DATE '2024-01-10' AS lacking FROM q JOIN w ON w.key = q.key AND w.j = q.j JOIN span ON span.key = w.key)
SELECT seed, key, day, CASE WHEN NOT lacking THEN round(ctl, 6) END AS ctl, CASE WHEN NOT lacking THEN round(atl, 6) END AS atl, CASE WHEN NOT lacking THEN round(tsb, 6) END AS tsb, CASE WHEN lacking THEN 'not_seeded' END AS reason FROM o"""


def data_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as checks of customers."""
    checks = fx.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderpriority").alias("input"), F.when(F.col("o_orderstatus") == "F", "present").when(F.col("o_orderstatus") == "O", "missing").otherwise("stale").alias("status"))
    return listing.completeness(checks)


HEALTH = """SELECT o_custkey AS key, round(count(*) FILTER (WHERE o_orderstatus = 'F') / count(*), 4) AS completeness, count(*) FILTER (WHERE o_orderstatus = 'F') AS present,
count(*) FILTER (WHERE o_orderstatus NOT IN ('F', 'O')) AS stale, count(*) FILTER (WHERE o_orderstatus = 'O') AS missing FROM orders GROUP BY 1"""


def onboarding_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = fx.table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("athlete")).agg(F.count_if(F.col("o_orderstatus") == "F").alias("n_activities"), F.max(F.when(F.col("o_orderpriority") == "1-URGENT", F.col("o_totalprice"))).alias("ftp_w"))
    c = fx.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("athlete"), F.when(F.col("c_custkey") % 3 > 0, F.col("c_custkey") % 3).alias("n_connections"))
    return listing.next_step(c.join(n, "athlete", "left"))


ONBOARDING = """WITH n AS (SELECT o_custkey AS k, count(*) FILTER (WHERE o_orderstatus = 'F') AS n, max(o_totalprice) FILTER (WHERE o_orderpriority = '1-URGENT') AS ftp FROM orders GROUP BY 1)
SELECT c_custkey AS athlete, CASE WHEN n > 0 AND ftp IS NOT NULL THEN 'all_set' WHEN n > 0 THEN 'set_ftp' WHEN c_custkey % 3 > 0 THEN 'run_first_sync' ELSE 'connect_a_source' END AS step FROM customer LEFT JOIN n ON k = c_custkey"""


def track_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.events(spark, sf_dir).select(F.col("user_id").alias("key"), (F.col("value") / 10).alias("lat"), F.when(F.col("value") < 400, F.col("value") / 5).alias("lng"))
    return listing.bounds(rows)


BOUNDS = """SELECT user_id AS key, min(value / 10) AS south, max(value / 10) AS north, min(value / 5) FILTER (WHERE value < 400) AS west, max(value / 5) FILTER (WHERE value < 400) AS east, count(value) AS n FROM events GROUP BY 1"""

QUERIES = {
    f.__name__: f
    for f in (
        activity_list, local_day_list, lap_offsets, constraints_active, connections_due, source_keys, suspect_connections, goal_list, plan_schedule, library, threshold_history, activity_span, latest_form, load_targets,
        fitness_chart, seeded_pmc, data_health, onboarding_step, track_bounds,
    )
}
ORACLE = {
    "activity_list": LIST, "local_day_list": LOCAL, "lap_offsets": OFFSETS, "constraints_active": CONSTRAINTS, "connections_due": DUE, "source_keys": KEYS, "suspect_connections": SUSPECT, "goal_list": GOALS, "plan_schedule": SCHEDULE,
    "library": LIBRARY, "threshold_history": HISTORY, "activity_span": SPAN, "latest_form": FORM, "load_targets": TARGETS, "fitness_chart": FITNESS, "seeded_pmc": SEEDED, "data_health": HEALTH, "onboarding_step": ONBOARDING,
    "track_bounds": BOUNDS,
}
