"""The closed set of capabilities: a name and typed parameters to a frame, or a typed gap."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strideframe.functions.result import result
from strideframe.operators import heart, load, power

GAP = "capability string, reason string, detail string"


@dataclass(frozen=True)
class Inputs:
    """Canonical frames of all athletes: ``streams(key, t, power, hr)``, ``daily(key, day, load, substituted)``, ``beats(key, i, rr)``,
    ``signatures(key, ftp_w, cp_w, w_prime_j, rest_hr, max_hr)``; key is the activity, in ``daily`` the athlete."""

    streams: DataFrame
    daily: DataFrame
    beats: DataFrame
    signatures: DataFrame


def _days(df: DataFrame, first: str, last: str) -> DataFrame:
    return df.where(F.col("day").between(F.to_date(F.lit(first)), F.to_date(F.lit(last))))


def _load_metrics(x: Inputs) -> DataFrame:
    rates = x.streams.groupBy("key").agg(F.avg("hr").alias("avg_hr_bpm"))
    return power.load_bundle(power.normalized_power(x.streams).join(rates, "key").join(x.signatures.select("key", "ftp_w"), "key", "left"))


def enveloped(metric: DataFrame, value: str) -> DataFrame:
    """``(key, result)``: the value in its envelope, with confidence, coverage and gaps where the metric tells them."""
    told = {c: F.col(c) for c in ("confidence", "coverage_fraction", "gap_count") if c in metric.columns}
    made = result(F.col(value), F.col("reason"), told.get("confidence", 1.0), told.get("coverage_fraction", 1.0), told.get("gap_count", 0))
    return metric.select("key", made.alias("result"))


def _balance(x: Inputs, sport: str) -> DataFrame:
    return power.w_balance_summary(x.streams, x.signatures.select("key", F.lit(sport).alias("sport"), F.col("cp_w"), F.col("w_prime_j")))


CAPABILITIES: dict[str, Callable[..., DataFrame]] = {
    "weekly_load": lambda x, first, last: _days(load.pmc(load.daily_grid(x.daily, last)), first, last),
    "power_curve": lambda x: power.mean_maximal_power(x.streams),
    "critical_power": lambda x: power.critical_power(power.mean_maximal_power(x.streams)),
    "normalized_power": lambda x: enveloped(power.normalized_power(x.streams), "np_w"),
    "w_balance": lambda x, sport="cycling": _balance(x, sport),
    "load_metrics": lambda x: _load_metrics(x),
    "decoupling": lambda x: heart.decoupling(x.streams),
    "trimp": lambda x, rest, most, sex=None: heart.banister_load(x.streams, rest, most, sex),
    "durability": lambda x, cp, w_prime: power.durability(x.streams, cp, w_prime),
    "hrv": lambda x: heart.hrv_time_domain(x.beats),
}


def run(spark: SparkSession, capability: str, inputs: Inputs, **params) -> DataFrame:
    """The capability's frame. An unknown name or parameters that don't fit give one row that says so, never an error."""
    found = CAPABILITIES.get(capability)
    if found is None:
        return spark.createDataFrame([(capability, "missing_dependency", "unknown capability")], GAP)
    try:
        return found(inputs, **params)
    except TypeError as e:
        return spark.createDataFrame([(capability, "missing_required_input", str(e).partition(">() ")[2] or str(e))], GAP)
