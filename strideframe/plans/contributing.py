"""Queries of channels, laps, wellness days, re-resolution and effective-dated writes, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strideframe.operators import contribute, resolve
from strideframe.sources import fixtures as fx
from strideframe.sources.buckets import BucketedTable
from strideframe.sources.scratch import scratch

TOP = {"power_w": "raw_stream", "latlng": "platform_computed"}
_RANK = "CASE tier WHEN 'raw_stream' THEN 0 WHEN 'device_computed' THEN 1 WHEN 'platform_computed' THEN 2 WHEN 'modeled' THEN 3 WHEN 'summary_only' THEN 4 ELSE 5 END"


def _channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as channels that sources (suppliers) carry for an activity (order)."""
    c = fx.candidates(spark, sf_dir)
    channel = F.when(F.col("line") % 3 == 0, "power_w").when(F.col("line") % 3 == 1, "latlng").otherwise("hr_bpm")
    rows = c.select(F.col("key").alias("activity_id"), channel.alias("channel"), "source", "tier", "native", "price", (F.col("key") % 50).alias("athlete"))
    return rows.groupBy("activity_id", "channel", "source", "athlete").agg(F.min_by("tier", F.struct("native", "price")).alias("tier"), F.min("native").alias("native"))


CHANNELS = f"""{fx.CANDIDATES}, channels AS (SELECT key AS activity_id, CASE WHEN line % 3 = 0 THEN 'power_w' WHEN line % 3 = 1 THEN 'latlng' ELSE 'hr_bpm' END AS channel, source,
  key % 50 AS athlete, min_by(tier, (native, price)) AS tier, min(native) AS native FROM candidates GROUP BY 1, 2, 3, 4)"""


def channel_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contribute.resolve_channels(_channels(spark, sf_dir), TOP).select("activity_id", "channel", "source", "tier", "native", "n_sources", "fidelity", "from_fidelity")


RESOLVED = f"""WITH {CHANNELS}, r AS (SELECT *, row_number() OVER (PARTITION BY activity_id, channel ORDER BY {_RANK}, source) AS n, count(*) OVER (PARTITION BY activity_id, channel) AS n_sources,
  CASE WHEN channel = 'power_w' AND {_RANK} > 0 THEN 'raw_stream' WHEN channel = 'latlng' AND {_RANK} > 2 THEN 'platform_computed' END AS from_fidelity FROM channels)
SELECT activity_id, channel, source, tier, native, n_sources, CASE WHEN from_fidelity IS NULL THEN tier ELSE 'substituted' END AS fidelity, from_fidelity FROM r WHERE n = 1"""


def lap_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as laps of the candidates that (order, supplier) pairs are."""
    c = fx.candidates(spark, sf_dir)
    ident = F.concat_ws("-", "key", "source")
    laps = c.select(ident.alias("candidate_id"), "line", "native", "price")
    candidates = c.groupBy(F.col("key").alias("activity_id"), "source", ident.alias("candidate_id")).agg(F.min("tier").alias("adapter_tier"))
    return contribute.laps_of_best(laps, candidates).select("activity_id", "candidate_id", "line", "native", "price")


LAPS = f"""WITH {fx.CANDIDATES}, l AS (SELECT key || '-' || source AS candidate_id, line, native, price FROM candidates), c AS (SELECT key AS activity_id, source, key || '-' || source AS candidate_id, min(tier) AS tier FROM candidates GROUP BY 1, 2),
b AS (SELECT activity_id, candidate_id, row_number() OVER (PARTITION BY activity_id ORDER BY {_RANK}, source) AS n FROM c WHERE candidate_id IN (SELECT candidate_id FROM l))
SELECT b.activity_id, l.candidate_id, line, native, price FROM l JOIN b ON b.candidate_id = l.candidate_id AND n = 1"""


def _wellness_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.candidates(spark, sf_dir).withColumn("completeness", F.lit(1)).withColumn("price", F.when(F.col("tier") != "summary_only", F.col("price"))).withColumn("value", F.when(F.col("line") > 3, F.col("value")))


def wellness_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as stored wellness days, line items as what sources say of them; price is unknown to untrusted sources."""
    rows = _wellness_rows(spark, sf_dir)
    stored = fx.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), (F.col("o_totalprice") / 2).alias("price"), F.lit(-1.0).alias("value"))
    return contribute.resolve_wellness(rows, stored, ["key"], ["price", "value"])


_PICK = "row_number() OVER (PARTITION BY key ORDER BY " + _RANK + ", confidence DESC, observed DESC, source, {v}) AS n"
WELLNESS = f"""WITH {fx.CANDIDATES}, p AS (SELECT key, price, {_PICK.format(v="price")} FROM candidates WHERE tier <> 'summary_only'), v AS (SELECT key, value, {_PICK.format(v="value")} FROM candidates WHERE line > 3),
k AS (SELECT o_orderkey AS key FROM orders UNION SELECT key FROM candidates) SELECT k.key, coalesce(p.price, o_totalprice / 2) AS price, coalesce(v.value, CASE WHEN o_orderkey IS NOT NULL THEN -1.0 END) AS value
FROM k LEFT JOIN orders ON o_orderkey = k.key LEFT JOIN p ON p.key = k.key AND p.n = 1 LEFT JOIN v ON v.key = k.key AND v.n = 1"""


def source_switched_off(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical rows before and after supplier 3 is switched off: its orders are resolved again, those that only it contributed
    to keep their row. Canonical rows lie in buckets of the order; buckets without an affected order aren't read."""
    rows = fx.candidates(spark, sf_dir).withColumns({"completeness": F.lit(1), "is_superseded": F.col("native") % 17 == 0, "is_tombstone": F.lit(False), "quarantine_rule": F.lit(None).cast("string")})
    sources = fx.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("source"), F.lit(True).alias("is_active"))

    def canonical(candidates: DataFrame, s: DataFrame) -> DataFrame:
        won = resolve.winners(resolve.contributing(candidates, s), ["key"], ["native", "price"])
        return won.select("key", F.col("w.source").alias("source"), F.col("w.value").alias("value"), "n")

    table = BucketedTable(scratch(spark, "canonical"), ("key",), 16).write(canonical(rows, sources))
    keys = contribute.affected(rows, F.lit(3), ["key"])
    again = rows.join(keys, "key", "left_semi")
    table.refresh(keys, canonical(again, contribute.with_source_active(sources, F.lit(3), False)))
    return table.read(spark)


_WON = "row_number() OVER (PARTITION BY key ORDER BY " + _RANK + ", confidence DESC, observed DESC, source, native, price)"
SWITCHED = f"""WITH {fx.CANDIDATES}, live AS (SELECT * FROM candidates WHERE native % 17 <> 0 AND source IN (SELECT s_suppkey FROM supplier)), a AS (SELECT key, source, value, {_WON} AS r, count(*) OVER (PARTITION BY key) AS n FROM live),
b AS (SELECT key, source, value, {_WON} AS r, count(*) OVER (PARTITION BY key) AS n FROM live WHERE source <> 3), t AS (SELECT DISTINCT key FROM candidates WHERE source = 3), f AS (SELECT b.* FROM b JOIN t ON t.key = b.key WHERE r = 1)
SELECT key, source, value, n FROM f UNION ALL SELECT key, source, value, n FROM a WHERE r = 1 AND key NOT IN (SELECT key FROM f)"""


def wellness_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wellness days after sources took back every third part's line: days that others still cover are resolved again, and a
    field that these don't have keeps its value; days without any contributor go."""
    rows = _wellness_rows(spark, sf_dir)
    fields = ["price", "value"]
    table = BucketedTable(scratch(spark, "wellness"), ("key",), 16).write(resolve.resolve_fields(rows, ["key"], fields).select("key", *fields))
    gone = F.col("native") % 3 == 0
    keys = rows.where(gone).select("key").distinct()
    left = rows.where(~gone).join(keys, "key", "left_semi")
    covered = table.read(spark, table.touched(keys)).join(left.select("key").distinct(), "key", "left_semi")
    table.refresh(keys, contribute.resolve_wellness(left, covered, ["key"], fields), remove=True)
    return table.read(spark)


REMOVED = f"""WITH {fx.CANDIDATES}, c AS (SELECT *, native % 3 = 0 AS gone FROM candidates),
p0 AS (SELECT key, price, {_PICK.format(v="price")} FROM c WHERE tier <> 'summary_only'), v0 AS (SELECT key, value, {_PICK.format(v="value")} FROM c WHERE line > 3),
p1 AS (SELECT key, price, {_PICK.format(v="price")} FROM c WHERE tier <> 'summary_only' AND NOT gone), v1 AS (SELECT key, value, {_PICK.format(v="value")} FROM c WHERE line > 3 AND NOT gone)
SELECT k.key, coalesce(p1.price, p0.price) AS price, coalesce(v1.value, v0.value) AS value FROM (SELECT DISTINCT key FROM c WHERE NOT gone) k
LEFT JOIN p0 ON p0.key = k.key AND p0.n = 1 LEFT JOIN v0 ON v0.key = k.key AND v0.n = 1 LEFT JOIN p1 ON p1.key = k.key AND p1.n = 1 LEFT JOIN v1 ON v1.key = k.key AND v1.n = 1"""


def coverage_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four fields of each order as its line items give them; prices of every fifth order failed to arrive from some source."""
    c = fx.candidates(spark, sf_dir).withColumns({"candidate_id": F.concat_ws("-", "key", "line", "native", "source"), "has_streams": F.col("value") > 25, "start_time": F.unix_timestamp("observed")})
    rows = c.withColumns({
        "confidence": F.when(F.col("line") > 1, F.col("confidence")), "price": F.when((F.col("source") % 4 > 1) & (F.col("native") % 3 > 0), F.col("price")),
        "value": F.when(F.col("source") % 3 > 0, F.col("value")), "sport": F.when(F.col("native") % 2 == 0, F.concat(F.lit("s"), F.col("native") % 7)),
    })
    failures = c.where("key % 5 = 0").select("key", F.lit("price").alias("field"))
    return contribute.field_records(rows, ["key"], ["value", "price", "start_time"], ["sport"], {"value": "raw_stream"}, failures)


_FIELD = "SELECT key, tier, CASE WHEN line > 1 THEN confidence ELSE 1.0 END AS confidence, observed, CASE WHEN value > 25 THEN 2 ELSE 1 END AS comp, source, concat_ws('-', key, line, native, source) AS candidate_id, '{f}' AS field, {number} AS number, {word} AS word FROM candidates WHERE {has}"
RECORDS = f"""WITH {fx.CANDIDATES},
l AS ({_FIELD.format(f="value", number="CAST(value AS DOUBLE)", word="NULL::VARCHAR", has="source % 3 > 0")}
  UNION ALL {_FIELD.format(f="price", number="CAST(price AS DOUBLE)", word="NULL", has="source % 4 > 1 AND native % 3 > 0")}
  UNION ALL {_FIELD.format(f="start_time", number="CAST(epoch(observed) AS DOUBLE)", word="NULL", has="true")}
  UNION ALL {_FIELD.format(f="sport", number="NULL", word="'s' || (native % 7)", has="native % 2 = 0")}),
r AS (SELECT *, {_RANK} AS rk, row_number() OVER w AS place, count(*) OVER k AS n, max(number) OVER k AS hi, min(number) OVER k AS lo,
  lead({_RANK}) OVER w AS rk2, lead(confidence) OVER w AS c2, lead(observed) OVER w AS o2, lead(comp) OVER w AS p2 FROM l
  WINDOW k AS (PARTITION BY key, field), w AS (PARTITION BY key, field ORDER BY {_RANK}, confidence DESC, observed DESC, comp DESC, source, candidate_id)),
e AS (SELECT DISTINCT key, field FROM candidates, (VALUES ('value'), ('price'), ('start_time'), ('sport')) f(field))
SELECT e.key, e.field, number, word, source, candidate_id, coalesce(n, 0) AS n_considered, n IS NOT NULL AS present,
  CASE WHEN n = 1 THEN 'sole_contributor' WHEN rk <> rk2 THEN 'trust_tier' WHEN confidence <> c2 THEN 'confidence' WHEN observed <> o2 THEN 'recency' WHEN comp <> p2 THEN 'completeness' WHEN n > 1 THEN 'stable_tiebreak' END AS rule,
  CASE WHEN n IS NULL AND e.field = 'price' AND e.key % 5 = 0 THEN 'absent_failed' WHEN n IS NULL THEN 'absent_true' WHEN e.field = 'value' AND rk > 0 THEN 'substituted' ELSE tier END AS fidelity,
  CASE WHEN e.field = 'value' AND rk > 0 THEN 'raw_stream' END AS from_fidelity,
  coalesce(e.field IN ('value', 'price') AND n > 1 AND (hi - lo) / greatest(1.0, abs(hi)) > 0.05, false) AS disputed
FROM e LEFT JOIN r ON r.key = e.key AND r.field = e.field AND place = 1"""


def split_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates per activity after every 19th part is split off its order."""
    c = fx.candidates(spark, sf_dir).select(F.concat_ws("-", "key", "line", "native", "source").alias("candidate_id"), F.col("key").cast("string").alias("activity_id"), "native")
    splits = c.where("native % 19 = 0").select("candidate_id", F.concat(F.lit("new-"), "candidate_id").alias("new_activity_id"))
    return contribute.split_off(c, splits).groupBy("activity_id").agg(F.count(F.lit(1)).alias("n"), F.min("candidate_id").alias("first"))


SPLIT = f"""WITH {fx.CANDIDATES}, c AS (SELECT key || '-' || line || '-' || native || '-' || source AS candidate_id, CAST(key AS VARCHAR) AS activity_id, native FROM candidates)
SELECT CASE WHEN native % 19 = 0 THEN 'new-' || candidate_id ELSE activity_id END AS activity_id, count(*) AS n, min(candidate_id) AS first FROM c GROUP BY 1"""


def gps_opt_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Channels that stay, and originals that are withheld, where every fourth athlete keeps no positions."""
    channels = _channels(spark, sf_dir)
    athletes = channels.select("athlete").distinct().withColumn("keeps_gps", F.col("athlete") % 4 != 0)
    kept = contribute.without_positions(channels, athletes).groupBy("athlete").agg(F.count(F.lit(1)).alias("channels"), F.count_if(F.col("channel") == "latlng").alias("positions"))
    files = channels.select("activity_id", "athlete", "source", (F.col("channel") == "latlng").alias("has_gps"))
    held = contribute.withheld_originals(files, athletes).groupBy("athlete").agg(F.count_if("withheld").alias("withheld"))
    return kept.join(held, "athlete")


GPS = f"""WITH {CHANNELS} SELECT athlete, count(*) FILTER (WHERE channel <> 'latlng' OR athlete % 4 <> 0) AS channels, count(*) FILTER (WHERE channel = 'latlng' AND athlete % 4 <> 0) AS positions,
count(*) FILTER (WHERE channel = 'latlng' AND athlete % 4 = 0) AS withheld FROM channels GROUP BY 1"""


def _versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = fx.signatures(spark, sf_dir).select("key", "effective_date", "ftp_w")
    stored = s.where("effective_date < DATE '1997-01-01'")
    # What comes in: later rows, and every stored one whose day of the month is odd again, which comes too late.
    incoming = s.where("effective_date >= DATE '1997-01-01' OR day(effective_date) % 2 = 1")
    return contribute.record_versions(stored, incoming, ["key"])


_VERSIONS = f"""{fx.SIGNATURES}, st AS (SELECT key, effective_date, ftp_w FROM signatures WHERE effective_date < DATE '1997-01-01'), mx AS (SELECT key, max(effective_date) AS latest FROM st GROUP BY 1),
nw AS (SELECT key, effective_date, ftp_w FROM signatures WHERE effective_date >= DATE '1997-01-01' OR day(effective_date) % 2 = 1),
al AS (SELECT *, false AS refused FROM st UNION ALL SELECT nw.*, coalesce(nw.effective_date <= latest, false) FROM nw LEFT JOIN mx ON mx.key = nw.key),
ve AS (SELECT *, CASE WHEN NOT refused THEN lead(effective_date) OVER (PARTITION BY key, refused ORDER BY effective_date) END AS effective_to FROM al)"""


def signature_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _versions(spark, sf_dir).select("key", "effective_date", F.round("ftp_w", 6).alias("ftp_w"), "effective_to", "refused")


WRITES = f"WITH {_VERSIONS} SELECT key, effective_date, round(ftp_w, 6) AS ftp_w, effective_to, refused FROM ve"


def zones_in_force(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's version in force on 1 July 1997; versions that were refused don't count."""
    at = F.to_date(F.lit("1997-07-01"))
    return contribute.in_force(_versions(spark, sf_dir).where(~F.col("refused")), at, ["key"]).select("key", "effective_date", F.round("ftp_w", 6).alias("ftp_w"), "effective_to")


IN_FORCE = f"""WITH {_VERSIONS} SELECT key, effective_date, round(ftp_w, 6) AS ftp_w, effective_to FROM ve WHERE NOT refused AND effective_date <= DATE '1997-07-01' AND (effective_to IS NULL OR effective_to > DATE '1997-07-01')"""


QUERIES = {f.__name__: f for f in (channel_resolution, lap_choice, wellness_days, source_switched_off, wellness_removed, coverage_records, split_candidates, gps_opt_out, signature_writes, zones_in_force)}
ORACLE = {
    "channel_resolution": RESOLVED, "lap_choice": LAPS, "wellness_days": WELLNESS, "source_switched_off": SWITCHED, "wellness_removed": REMOVED, "coverage_records": RECORDS, "split_candidates": SPLIT, "gps_opt_out": GPS, "signature_writes": WRITES, "zones_in_force": IN_FORCE,
}
