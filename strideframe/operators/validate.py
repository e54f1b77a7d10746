"""Checks of what sources deliver: candidates, workout steps, plans, declared record types."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strideframe.functions import constants as C
from strideframe.operators.resolve import first_violation


def unknown_key(payload: str, allowed: Sequence[str]) -> Column:
    """Rule of the first payload key that isn't canonical, null where all are. ``payload`` is an array of (k, v)."""
    outside = F.filter(F.col(payload), lambda e: ~e["k"].isin(*allowed))
    return F.when(F.size(outside) > 0, F.concat(F.lit("MAP-R2:non-canonical-key:"), F.get(outside, 0)["k"]))


def broken_range(payload: str, ranges: Mapping[str, tuple[float, float]] = C.FIELD_RANGES) -> Column:
    """Rule of the first range, in the ranges' order, that a value of the payload lies outside of."""
    values = F.map_from_entries(F.col(payload))
    return F.coalesce(*(F.when(~F.element_at(values, name).between(low, high), F.lit(f"MAP-R6:range:{name}")) for name, (low, high) in ranges.items()))


def not_ascending(values: Column) -> Column:
    """Whether a value lies below the one before it; nulls are passed over."""
    known = F.filter(values, lambda x: x.isNotNull())
    pairs = F.zip_with(F.slice(known, 1, F.greatest(F.size(known) - 1, F.lit(0))), F.slice(known, 2, F.greatest(F.size(known) - 1, F.lit(0))), lambda a, b: b < a)
    return F.exists(pairs, lambda x: x)


def broken_laps(laps: str) -> Column:
    """Rule that an array of (lap_index, start_offset_s) breaks: each has an index, indexes are contiguous, offsets ascend."""
    index = F.transform(F.col(laps), lambda x: x["lap_index"])
    ordered = F.array_sort(F.col(laps), lambda a, b: F.when(a["lap_index"] < b["lap_index"], -1).when(a["lap_index"] > b["lap_index"], 1).otherwise(0))
    contiguous = (F.array_max(index) - F.array_min(index) + 1 == F.size(index)) & (F.size(F.array_distinct(index)) == F.size(index))
    return (
        F.when(F.coalesce(F.size(laps), F.lit(0)) <= 0, F.lit(None))
        .when(F.exists(index, lambda i: i.isNull()), "MAP-R6:lap-index-missing")
        .when(~contiguous, "MAP-R6:lap-contiguity")
        .when(not_ascending(F.transform(ordered, lambda x: x["start_offset_s"])), "MAP-R6:lap-offsets-not-ordered")
    )


def candidate_rule(allowed: Sequence[str], devices: Sequence[str], payload: str = "payload", device: str = "device_class", times: str = "times", laps: str = "laps") -> Column:
    """The first rule that a candidate breaks, null for a sound one.

    In order: keys that aren't canonical, ranges, the device class, a time base that runs backwards, laps.
    """
    return F.coalesce(
        unknown_key(payload, allowed),
        broken_range(payload),
        F.when(~F.col(device).isin(*devices), F.lit("MAP-R6:enum:device_class")),
        F.when(F.coalesce(not_ascending(F.col(times)), F.lit(False)), F.lit("MAP-R6:time-base-not-monotonic")),
        broken_laps(laps),
    )


def step_rule(step: Column, target_types: Sequence[str], intents: Sequence[str]) -> Column:
    """The first rule that a workout step (target_type, intent, target_low, target_high, duration_s, distance_m) breaks."""
    extent = F.coalesce(step["duration_s"], step["distance_m"])
    return first_violation(
        [
            ("target_type", ~F.coalesce(step["target_type"].isin(*target_types), F.lit(False))),
            ("intent", ~F.coalesce(step["intent"].isin(*intents), F.lit(False))),
            ("target_order", step["target_low"] > step["target_high"]),
            ("one_extent", step["duration_s"].isNull() == step["distance_m"].isNull()),
            ("positive_extent", extent <= 0),
        ]
    )


def steps_rule(steps: str, target_types: Sequence[str], intents: Sequence[str]) -> Column:
    """``index:rule`` of the first step of an array that breaks a rule, null for a sound workout."""
    found = F.transform(F.col(steps), lambda s, i: F.concat_ws(":", i.cast("string"), step_rule(s, target_types, intents)))
    return F.get(F.filter(found, lambda x: F.contains(x, F.lit(":"))), 0)


def plan_rule(plans: DataFrame, days: DataFrame, lineage: Sequence[str]) -> DataFrame:
    """``(plan_id, rule)``: the first rule that a plan and its days break.

    ``plans(plan_id, start_date, end_date, *lineage)``, ``days(plan_id, day)``: every lineage key is given, the span isn't
    reversed, every day lies inside it, no day is planned twice.
    """
    joined = days.join(plans.select("plan_id", "start_date", "end_date"), "plan_id")
    per_day = joined.groupBy("plan_id", "day").agg(F.count(F.lit(1)).alias("n"), F.bool_or(~F.col("day").between(F.col("start_date"), F.col("end_date"))).alias("outside"))
    found = per_day.groupBy("plan_id").agg(F.bool_or("outside").alias("outside"), F.max("n").alias("most"))
    rule = first_violation(
        [
            ("lineage", F.greatest(F.lit(False), *(F.col(c).isNull() for c in lineage))),
            ("span", F.col("end_date") < F.col("start_date")),
            ("day_outside_span", F.col("outside")),
            ("day_repeated", F.col("most") > 1),
        ]
    )
    return plans.join(found, "plan_id", "left").select("plan_id", rule.alias("rule"))


def undeclared_batches(candidates: DataFrame, declared: DataFrame, batch: Sequence[str]) -> DataFrame:
    """Batches that hold a record type their source hasn't declared: ``(*batch, undeclared)``, the types in order.

    Such a batch is refused whole and leaves a terminal ``schema_mismatch`` gap. ``declared(source, gbo_type)``.
    """
    outside = candidates.select(*batch, "source", "gbo_type").join(declared.select("source", "gbo_type"), ["source", "gbo_type"], "left_anti")
    # As many types as the model has.
    return outside.groupBy(*batch).agg(F.array_sort(F.collect_set("gbo_type")).alias("undeclared"))


def capability_rule(sources: DataFrame, writable: Sequence[str], phases: Mapping[str, Sequence[str]]) -> DataFrame:
    """``(source, rule)`` of ``sources(source, sync_mode, declared array, phases array)``: declared types must be writable, and
    the phases that the sync mode needs must be there."""
    missing = F.array_except(F.col("declared"), F.array(*(F.lit(w) for w in writable)))
    lacks = F.lit(False)
    for mode, needed in phases.items():
        lacks = lacks | ((F.col("sync_mode") == mode) & (F.size(F.array_except(F.array(*(F.lit(p) for p in needed)), F.col("phases"))) > 0))
    rule = first_violation([("nothing_declared", F.size("declared") == 0), ("not_writable", F.size(missing) > 0), ("sync_mode", ~F.col("sync_mode").isin(*phases)), ("phase_missing", lacks)])
    return sources.select("source", rule.alias("rule"))
