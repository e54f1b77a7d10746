"""Queries of the checks on delivered data, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strideframe.functions import constants as C
from strideframe.operators import validate
from strideframe.sources import fixtures as fx

#: What the orders' payloads may hold; every eleventh has a key besides.
KEYS = ("avg_power_w", "avg_hr_bpm", "avg_cadence_rpm", "distance_m", "avg_temp_c")
DEVICES = ("power_meter", "watch")


def candidate_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order as a candidate: payload from its fields, laps and time base from its line items."""
    items = fx.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.array_sort(F.collect_list(F.struct(F.col("l_linenumber").alias("lap_index"), F.col("l_quantity").alias("start_offset_s")))).alias("laps"),
        F.array_sort(F.collect_list(F.struct("l_linenumber", F.unix_timestamp("l_shipdate").alias("s")))).alias("ordered"),
    )
    key = F.col("o_orderkey")
    entry = lambda name, value: F.struct(F.lit(name).alias("k"), value.cast("double").alias("v"))
    payload = F.array(
        entry("avg_power_w", F.col("o_totalprice") / 50), entry("avg_hr_bpm", key % 300), entry("avg_cadence_rpm", key % 310),
        entry("distance_m", F.col("o_totalprice") * 10), F.when(key % 11 == 0, entry("icu_watts", key)).otherwise(entry("avg_temp_c", key % 80 - 5)),
    )
    device = F.when(key % 13 == 0, "toaster").when(key % 2 == 0, "watch")
    few = F.when(key % 3 == 0, F.col("laps")).otherwise(F.slice(F.col("laps"), 1, 1))
    times = F.when(key % 3 == 1, F.transform("ordered", lambda x: x["s"]))
    rows = fx.table(spark, sf_dir, "orders").join(items, "o_orderkey", "left").select("o_orderkey", payload.alias("payload"), device.alias("device_class"), times.alias("times"), few.alias("laps"))
    return rows.select("o_orderkey", validate.candidate_rule(KEYS, DEVICES).alias("rule"))


CANDIDATES = """WITH l AS (SELECT l_orderkey AS k, list({'i': l_linenumber, 'o': l_quantity} ORDER BY l_linenumber, l_quantity) AS laps,
  list(CAST(epoch(l_shipdate) AS BIGINT) ORDER BY l_linenumber, epoch(l_shipdate)) AS times FROM lineitem GROUP BY 1),
c AS (SELECT o_orderkey AS k, o_totalprice / 50 AS power, o_orderkey % 300 AS hr, o_orderkey % 310 AS cad, o_totalprice * 10 AS dist,
  CASE WHEN o_orderkey % 11 <> 0 THEN o_orderkey % 80 - 5 END AS temp, CASE WHEN o_orderkey % 3 = 0 THEN laps ELSE laps[1:1] END AS laps,
  CASE WHEN o_orderkey % 3 = 1 THEN times END AS times FROM orders LEFT JOIN l ON l.k = o_orderkey),
u AS (SELECT k, generate_subscripts(laps, 1) AS n, unnest(laps) AS lap FROM c), v AS (SELECT k, n, lap.i AS i, lap.o AS o, lag(lap.o) OVER (PARTITION BY k ORDER BY n) AS before FROM u),
laps AS (SELECT k, max(i) - min(i) + 1 <> count(*) OR count(DISTINCT i) <> count(*) AS holes, coalesce(bool_or(o < before), false) AS back FROM v GROUP BY 1),
w AS (SELECT k, generate_subscripts(times, 1) AS n, unnest(times) AS t FROM c), x AS (SELECT k, t < lag(t) OVER (PARTITION BY k ORDER BY n) AS back FROM w),
times AS (SELECT k, bool_or(coalesce(back, false)) AS back FROM x GROUP BY 1)
SELECT c.k AS o_orderkey, CASE WHEN c.k % 11 = 0 THEN 'MAP-R2:non-canonical-key:icu_watts' WHEN power > 3000 THEN 'MAP-R6:range:avg_power_w'
WHEN hr NOT BETWEEN 20 AND 260 THEN 'MAP-R6:range:avg_hr_bpm' WHEN cad > 300 THEN 'MAP-R6:range:avg_cadence_rpm' WHEN dist > 2000000 THEN 'MAP-R6:range:distance_m'
WHEN temp NOT BETWEEN -60 AND 70 THEN 'MAP-R6:range:avg_temp_c' WHEN c.k % 13 = 0 THEN 'MAP-R6:enum:device_class' WHEN times.back THEN 'MAP-R6:time-base-not-monotonic'
WHEN laps.holes THEN 'MAP-R6:lap-contiguity' WHEN laps.back THEN 'MAP-R6:lap-offsets-not-ordered' END AS rule
FROM c LEFT JOIN laps ON laps.k = c.k LEFT JOIN times ON times.k = c.k"""


def workout_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order's line items, in order, as the steps of a workout."""
    q, d = F.col("l_quantity"), F.col("l_discount")
    step = F.struct(
        F.when(F.col("l_returnflag") == "R", "power").when(F.col("l_returnflag") == "A", "hr").otherwise(F.when(F.col("l_partkey") % 7 > 0, "pace")).alias("target_type"),
        F.when(F.col("l_linestatus") == "O", "work").otherwise("rest").alias("intent"), q.alias("target_low"), (q + 5 - d * 60).alias("target_high"),
        F.when(F.col("l_partkey") % 3 > 0, q - 1).alias("duration_s"), F.when(F.col("l_partkey") % 4 == 0, q).alias("distance_m"),
    )
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    rows = fx.table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct(*order, step.alias("step")))).alias("s"))
    rows = rows.select("l_orderkey", F.transform("s", lambda x: x["step"]).alias("steps"))
    return rows.select("l_orderkey", validate.steps_rule("steps", ("power", "hr", "pace"), ("work", "rest")).alias("rule"))


STEPS = """WITH s AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS i, l_returnflag NOT IN ('R', 'A') AND l_partkey % 7 = 0 AS no_type,
  l_discount * 60 > 5 AS reversed, l_partkey % 3 > 0 AS timed, l_partkey % 4 = 0 AS long, l_quantity AS q, l_quantity + 5 - l_discount * 60 AS high FROM lineitem),
r AS (SELECT l_orderkey, i, CASE WHEN no_type THEN 'target_type' WHEN q > high THEN 'target_order' WHEN timed = long THEN 'one_extent' WHEN CASE WHEN timed THEN q - 1 ELSE q END <= 0 THEN 'positive_extent' END AS rule FROM s)
SELECT l_orderkey, min_by(i || ':' || rule, i) FILTER (WHERE rule IS NOT NULL) AS rule FROM r GROUP BY 1"""


def plan_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's orders as the days of a plan from its first to its 300th day."""
    o = fx.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("plan_id"), F.to_date("o_orderdate").alias("day"))
    key = F.col("plan_id")
    plans = o.groupBy("plan_id").agg(F.min("day").alias("first")).select(
        "plan_id", F.col("first").alias("start_date"), F.date_add("first", (F.when(key % 9 == 0, -1).otherwise(2000)).cast("int")).alias("end_date"),
        F.when(key % 5 > 0, "ftp").alias("basis"), F.when(key % 7 > 0, "v1").alias("model"),
    )
    return validate.plan_rule(plans, o, ("basis", "model"))


PLANS = """WITH o AS (SELECT o_custkey AS p, CAST(o_orderdate AS DATE) AS day FROM orders), f AS (SELECT p, min(day) AS a, min(day) + CASE WHEN p % 9 = 0 THEN -1 ELSE 2000 END AS b FROM o GROUP BY 1),
d AS (SELECT o.p, o.day, count(*) AS n, bool_or(o.day NOT BETWEEN a AND b) AS outside FROM o JOIN f ON f.p = o.p GROUP BY 1, 2),
x AS (SELECT p, bool_or(outside) AS outside, max(n) AS most FROM d GROUP BY 1)
SELECT f.p AS plan_id, CASE WHEN f.p % 5 = 0 OR f.p % 7 = 0 THEN 'lineage' WHEN b < a THEN 'span' WHEN outside THEN 'day_outside_span' WHEN most > 1 THEN 'day_repeated' END AS rule FROM f LEFT JOIN x ON x.p = f.p"""


def undeclared_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as batches, suppliers as sources, return flags as record types; sources declare what their key allows."""
    items = fx.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("batch"), F.col("l_suppkey").alias("source"), F.col("l_returnflag").alias("gbo_type"))
    s = fx.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("source"))
    allowed = F.when(F.col("source") % 3 == 0, F.array(F.lit("A"), F.lit("N"), F.lit("R"))).when(F.col("source") % 3 == 1, F.array(F.lit("A"), F.lit("N"))).otherwise(F.array(F.lit("N"), F.lit("R")))
    out = validate.undeclared_batches(items, s.select("source", F.explode(allowed).alias("gbo_type")), ("batch",))
    return out.select("batch", F.array_join("undeclared", ",").alias("undeclared"))


UNDECLARED = """SELECT l_orderkey AS batch, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS undeclared FROM lineitem JOIN supplier ON s_suppkey = l_suppkey
WHERE (l_suppkey % 3 = 1 AND l_returnflag = 'R') OR (l_suppkey % 3 = 2 AND l_returnflag = 'A') GROUP BY 1"""


def capability_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as adapters with a sync mode, declared record types and phases."""
    key = F.col("s_suppkey")
    lits = lambda *x: F.array(*(F.lit(v) for v in x))
    rows = fx.table(spark, sf_dir, "supplier").select(
        key.alias("source"), F.when(key % 4 == 0, "push").when(key % 4 == 1, "file").otherwise("poll").alias("sync_mode"),
        F.when(key % 5 == 0, lits("activity", "invoice")).when(key % 7 == 0, F.array().cast("array<string>")).otherwise(lits("activity")).alias("declared"),
        F.when(key % 3 == 0, lits("map")).otherwise(lits("discover", "fetch", "map")).alias("phases"),
    )
    return validate.capability_rule(rows, ("activity", "daily_wellness"), {"poll": ("discover", "fetch", "map"), "file": ("map",)})


CAPABILITY = """SELECT s_suppkey AS source, CASE WHEN s_suppkey % 5 <> 0 AND s_suppkey % 7 = 0 THEN 'nothing_declared' WHEN s_suppkey % 5 = 0 THEN 'not_writable' WHEN s_suppkey % 4 = 0 THEN 'sync_mode'
WHEN s_suppkey % 4 > 1 AND s_suppkey % 3 = 0 THEN 'phase_missing' END AS rule FROM supplier"""

QUERIES = {f.__name__: f for f in (candidate_gate, workout_steps, plan_guard, undeclared_types, capability_check)}
ORACLE = {"candidate_gate": CANDIDATES, "workout_steps": STEPS, "plan_guard": PLANS, "undeclared_types": UNDECLARED, "capability_check": CAPABILITY}
assert set(KEYS) <= set(C.FIELD_RANGES)
