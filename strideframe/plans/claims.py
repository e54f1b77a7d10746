"""Queries of claim checking, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strideframe.operators import claims, load
from strideframe.plans.listing import _PMC
from strideframe.sources import fixtures as fx

NAMES = ("ctl", "atl", "tsb", "tss")
ALIASES = {"Fitness": "ctl", "chronic  training load": "ctl", "fatigue": "atl", "form": "tsb", "click load": "tss", "weight": "kg"}
#: Words of the tables' invented language that stand for activities and negations.
GROUPS = (("heat", "hashe"), ("the", "thea", "ththe"), ("in", "ining"), ("er", "erer", "eren"))
NEGATIONS = ("not", "that", "by", "on")


def metric_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels made of part names, resolved or not."""
    key = F.col("p_partkey")
    label = (
        F.when(key % 7 == 0, F.concat(F.lit(" FITNESS ("), "p_name", F.lit(")"))).when(key % 7 == 1, F.concat("p_name", F.lit("  (Chronic training\tload)"))).when(key % 7 == 2, "CTL")
        .when(key % 7 == 3, "weight").when(key % 7 == 4, F.concat("p_name", F.lit(" (form"))).when(key % 7 == 5, "click  Load")
    )
    return fx.table(spark, sf_dir, "part").select(key, claims.metric_key(label, NAMES, ALIASES).alias("metric"))


LABELS = "SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN 'ctl' WHEN 1 THEN 'ctl' WHEN 2 THEN 'ctl' WHEN 4 THEN 'tsb' WHEN 5 THEN 'tss' END AS metric FROM part"


def canonical_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as claims about their user's daily load; some of no day, some of one that is no date."""
    e, key = fx.events(spark, sf_dir), F.col("event_id")
    as_of = F.when(key % 4 == 0, F.date_format("ts", "yyyy-MM-dd")).when(key % 4 == 1, " ").when(key % 4 == 2, "2024-13-45")
    rows = e.select(key, F.col("user_id").alias("key"), F.when(key % 5 > 0, "load").otherwise("other").alias("metric"), as_of.alias("as_of"))
    values = fx.daily_loads(spark, sf_dir).select("key", F.lit("load").alias("metric"), "day", F.col("load").alias("value"))
    out = claims.canonical_values(rows, values, ["key"], F.to_date(F.lit("2024-01-20")), 10)
    return out.select("event_id", "key", "metric", "as_of", F.round("canonical", 6).alias("canonical"))


CANONICAL = f"""WITH {fx.DAILY}, late AS (SELECT key, max_by(load, day) AS load FROM daily WHERE load IS NOT NULL AND day BETWEEN DATE '2024-01-10' AND DATE '2024-01-20' GROUP BY 1),
c AS (SELECT event_id, user_id AS key, CASE WHEN event_id % 5 > 0 THEN 'load' ELSE 'other' END AS metric, CASE event_id % 4 WHEN 0 THEN strftime(ts, '%Y-%m-%d') WHEN 1 THEN ' ' WHEN 2 THEN '2024-13-45' END AS as_of, CAST(ts AS DATE) AS day FROM events)
SELECT event_id, c.key, metric, as_of, CASE WHEN metric = 'load' THEN CASE WHEN event_id % 4 = 0 THEN round(daily.load, 6) WHEN event_id % 4 <> 2 THEN round(late.load, 6) END END AS canonical
FROM c LEFT JOIN daily ON daily.key = c.key AND daily.day = c.day LEFT JOIN late ON late.key = c.key"""


def constraint_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation's first turn as its constraint, hard in every second one, the other turns as prescriptions."""
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    constraints = c.where("turn = 0").select("conv_id", F.col("text").alias("content"), F.when(F.col("conv_id") % 2 == 0, "hard").otherwise("soft").alias("severity"))
    said = c.where("turn > 0").select("conv_id", F.col("turn").alias("sentence_id"), F.col("text").alias("sentence"))
    out = claims.conflicts(said, constraints, ["conv_id"], NEGATIONS, GROUPS)
    return out.select("conv_id", "sentence_id", "action", F.array_join("activities", ",").alias("activities"))


_GROUPS = ", ".join(f"('{w}', '{g[0]}')" for g in GROUPS for w in g)
CONFLICTS = rf"""WITH g(word, token) AS (VALUES {_GROUPS}), w AS (SELECT conv_id, turn, list_filter(string_split_regex(lower(text), '[^\p{{L}}]+'), lambda x: x <> '') AS ws FROM conversations),
u AS (SELECT conv_id, turn, generate_subscripts(ws, 1) AS i, unnest(ws) AS w FROM w),
n AS (SELECT conv_id, turn, i FROM u WHERE turn = 0 AND w IN ({', '.join(repr(x) for x in NEGATIONS)})),
f AS (SELECT DISTINCT u.conv_id, token FROM u JOIN g ON g.word = u.w JOIN n ON n.conv_id = u.conv_id AND abs(n.i - u.i) <= 4 WHERE u.turn = 0),
s AS (SELECT DISTINCT conv_id, turn, token FROM u JOIN g ON g.word = u.w WHERE turn > 0)
SELECT s.conv_id, s.turn AS sentence_id, CASE WHEN s.conv_id % 2 = 0 THEN 'remove' ELSE 'caution' END AS action, string_agg(s.token, ',' ORDER BY s.token) AS activities
FROM s JOIN f ON f.conv_id = s.conv_id AND f.token = s.token GROUP BY 1, 2"""


def fact_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return claims.fact_sheet(load.pmc(load.daily_grid(fx.daily_loads(spark, sf_dir))))


_TREND = "CASE WHEN abs(l.{0} - f.{0}) < 0.05 THEN 'steady' WHEN l.{0} > f.{0} THEN 'rising' ELSE 'falling' END"
SHEETS = f"""WITH RECURSIVE {_PMC}, r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY day DESC) - 1 AS back, row_number() OVER (PARTITION BY key ORDER BY day) AS i FROM days),
f AS (SELECT * FROM r WHERE i = 1), l AS (SELECT * FROM r WHERE back = 0),
t AS (SELECT key, string_agg('  ' || CASE WHEN back = 0 THEN 'latest' ELSE back || ' day(s) earlier' END || printf(': fitness %.1f, fatigue %.1f, form %.1f', ctl, atl, tsb), chr(10) ORDER BY back DESC) AS lines FROM r WHERE back < 7 GROUP BY 1)
SELECT l.key, 'current fitness (ctl) ' || printf('%.1f', l.ctl) || ' (' || {_TREND.format("ctl")} || '); current fatigue (atl) ' || printf('%.1f', l.atl) || ' (' || {_TREND.format("atl")} || '); current form (tsb) ' || printf('%.1f', l.tsb)
|| ' (' || {_TREND.format("tsb")} || ')' || chr(10) || 'recent days (most recent last):' || chr(10) || lines AS sheet FROM l JOIN f ON f.key = l.key JOIN t ON t.key = l.key"""

QUERIES = {f.__name__: f for f in (metric_labels, canonical_values, constraint_conflicts, fact_sheets)}
ORACLE = {"metric_labels": LABELS, "canonical_values": CANONICAL, "constraint_conflicts": CONFLICTS, "fact_sheets": SHEETS}
