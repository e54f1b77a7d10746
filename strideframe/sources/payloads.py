"""Recorded payloads of a training service as canonical rows: activities, daily wellness, streams.

Payloads are JSON, one object a line, read with an explicit schema. A row without an id, or whose start carries no zone,
is marked rejected and kept, so that nothing is lost between the source and the record.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strideframe.functions import scalars

ACTIVITY = (
    "id string, type string, sub_type string, start_date string, elapsed_time int, moving_time int, distance double, total_elevation_gain double, icu_joules double, icu_average_watts double, p_max double,"
    "average_heartrate double, max_heartrate double, average_cadence double, average_speed double, average_temp double, device_watts boolean, has_heartrate boolean, icu_rpe double, feel double,"
    "streams array<struct<type:string,data:array<double>>>"
)
WELLNESS = "id string, restingHR int, hrv double, hrvSDNN double, sleepScore double, sleepSecs int, steps int, weight double, readiness double, spO2 double, respiration double, vo2max double"

#: Payload fields and the canonical columns they become.
ACTIVITY_COLUMNS = {
    "elapsed_time": "elapsed_time_s", "moving_time": "moving_time_s", "distance": "distance_m", "icu_joules": "total_work_j", "icu_average_watts": "avg_power_w", "p_max": "max_power_w", "average_heartrate": "avg_hr_bpm",
    "max_heartrate": "max_hr_bpm", "average_cadence": "avg_cadence_rpm", "average_speed": "avg_speed_mps", "total_elevation_gain": "elevation_gain_m", "average_temp": "avg_temp_c",
}
WELLNESS_COLUMNS = {
    "restingHR": "resting_hr_bpm", "hrv": "hrv_rmssd_ms", "hrvSDNN": "hrv_sdnn_ms", "sleepScore": "sleep_score", "sleepSecs": "sleep_duration_s", "steps": "steps", "weight": "body_mass_kg", "readiness": "readiness_external",
    "spO2": "spo2_avg_pct", "respiration": "respiration_avg_rpm", "vo2max": "vo2max",
}
STREAM_COLUMNS = {"watts": "power_w", "heartrate": "hr_bpm", "cadence": "cadence_rpm", "velocity_smooth": "speed_mps", "distance": "distance_m", "altitude": "altitude_m", "temp": "temp_c"}
ZONED = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})$"


def instant(text: Column) -> Column:
    """An ISO instant with its zone; text without one is null."""
    return F.when(text.rlike(ZONED), F.try_to_timestamp(text))


def read_activities(spark: SparkSession, path: str) -> DataFrame:
    return activities(spark.read.schema(ACTIVITY).json(path))


def activities(raw: DataFrame) -> DataFrame:
    """Canonical activities, ``streams`` as a map from channel to its values; a channel without a value is left out."""
    names = F.create_map(*(F.lit(x) for pair in STREAM_COLUMNS.items() for x in pair))
    live = F.filter("streams", lambda s: names[s["type"]].isNotNull() & F.exists(s["data"], lambda v: v.isNotNull()))
    streams = F.map_from_entries(F.transform(F.coalesce(live, F.array().cast("array<struct<type:string,data:array<double>>>")), lambda s: F.struct(names[s["type"]], s["data"])))
    start = instant(F.col("start_date"))
    why = F.when(F.col("id").isNull(), "missing:id").when(start.isNull(), "invalid:start_date")
    rows = raw.withColumn("channels", streams)
    return rows.select(
        F.col("id").alias("native_id"), start.alias("start_time"), scalars.sport_code(F.col("type")).alias("sport"), *(F.col(a).alias(b) for a, b in ACTIVITY_COLUMNS.items()), (F.col("icu_joules") / 1000).alias("energy_kj"),
        scalars.rpe(F.col("icu_rpe"), F.lit(False)).alias("perceived_exertion"), scalars.feel(F.col("feel")).alias("feel"),
        (F.coalesce("device_watts", F.lit(False)) | F.col("icu_average_watts").isNotNull()).alias("has_power"), (F.coalesce("has_heartrate", F.lit(False)) | F.col("average_heartrate").isNotNull()).alias("has_hr"),
        (F.col("average_cadence").isNotNull() | F.map_contains_key("channels", "cadence_rpm")).alias("has_cadence"), F.col("channels").alias("streams"), why.alias("rejected"),
    )


def read_wellness(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.schema(WELLNESS).json(path)
    day = F.expr("try_cast(id AS DATE)")
    return raw.select(day.alias("local_date"), *(F.col(a).alias(b) for a, b in WELLNESS_COLUMNS.items()), F.when(day.isNull(), "invalid:id").alias("rejected"))


def stream_rows(rows: DataFrame) -> DataFrame:
    """``(native_id, channel, t, v)`` of every sample; a missing sample stays a null."""
    return rows.where("rejected IS NULL").select("native_id", F.explode("streams").alias("channel", "values")).select("native_id", "channel", F.posexplode("values").alias("t", "v"))
