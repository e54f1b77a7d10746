"""Lists and charts: activity filters, summaries, libraries, histories, chart points, setup state."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strideframe.functions import constants as C
from strideframe.functions.result import ladder, ratio


def filtered(activities: DataFrame, athlete=None, first=None, last=None, sport=None, least_moving_s=None, has_power=None, device_class=None) -> DataFrame:
    """Activities that meet all filters given; days are whole days of UTC, the last one included."""
    keep = [(athlete, F.col("athlete") == F.lit(athlete)), (sport, F.col("sport") == F.lit(sport)), (device_class, F.col("device_class") == F.lit(device_class)), (has_power, F.col("has_power") == F.lit(has_power))]
    keep += [(first, F.col("start") >= F.to_timestamp(F.lit(first))), (last, F.col("start") < F.to_timestamp(F.date_add(F.to_date(F.lit(last)), 1))), (least_moving_s, F.col("moving_time_s") >= F.lit(least_moving_s))]
    for given, condition in keep:
        if given is not None:
            activities = activities.where(condition)
    return activities


def in_local_days(activities: DataFrame, first: str, last: str) -> DataFrame:
    """Activities of local days from ``first`` to ``last``: a padded filter on the instant, which reaches the files, then the
    exact one on ``local_date``."""
    low, high = F.to_timestamp(F.date_sub(F.to_date(F.lit(first)), 1)), F.to_timestamp(F.date_add(F.to_date(F.lit(last)), 2))
    return activities.where((F.col("start") >= low) & (F.col("start") < high) & F.col("local_date").between(F.to_date(F.lit(first)), F.to_date(F.lit(last))))


def summaries(activities: DataFrame) -> DataFrame:
    """The fields of an activity's entry in a list."""
    fields = ("activity_id", "local_date", "sport", "start", "elapsed_time_s", "moving_time_s", "distance_m", "avg_power_w", "has_power", "has_hr", "has_gps")
    return activities.select(*(f for f in fields if f in activities.columns))


def lap_rows(laps: DataFrame, sessions: DataFrame) -> DataFrame:
    """Laps with their start as seconds after the session's start, numbered from 0 in order of time."""
    joined = laps.join(sessions.select("activity_id", F.col("start").alias("session_start")), "activity_id")
    offset = F.unix_timestamp("start") - F.unix_timestamp("session_start")
    index = F.row_number().over(Window.partitionBy("activity_id").orderBy("start", "lap_id")) - 1
    return joined.select("activity_id", "lap_id", index.alias("lap_index"), offset.alias("start_offset_s"), *(c for c in laps.columns if c not in ("activity_id", "lap_id", "start")))


def active_constraints(constraints: DataFrame, now: Column) -> DataFrame:
    """Constraints in force, hard ones first, then the newest, then by id; never cut short."""
    live = constraints.where((F.col("status").isNull() | (F.col("status") == "active")) & (F.col("until").isNull() | (F.col("until") > now)))
    return live.orderBy(F.when(F.col("severity") == "hard", 0).otherwise(1), F.desc("created_at"), "constraint_id")


def usable_connections(connections: DataFrame, descriptors: DataFrame) -> DataFrame:
    """Connections that can be synced, with their source's key."""
    live = connections.where(~F.col("status").isin("reauth_required", "disconnected"))
    return live.join(descriptors.select("source_descriptor_id", "source_key"), "source_descriptor_id")


def connected_sources(connections: DataFrame, descriptors: DataFrame) -> DataFrame:
    """``(athlete, source_keys)``: each athlete's sources, once each and in order."""
    joined = connections.join(descriptors.select("source_descriptor_id", "source_key"), "source_descriptor_id")
    return joined.groupBy("athlete").agg(F.array_sort(F.collect_set("source_key")).alias("source_keys"))


def goals_in(goals: DataFrame, status=None, sport=None, first=None, last=None) -> DataFrame:
    """Goals of a status and sport whose day lies in a window; each filter is optional."""
    for given, condition in ((status, F.col("status") == F.lit(status)), (sport, F.col("sport") == F.lit(sport)), (first, F.col("target_date") >= F.to_date(F.lit(first))), (last, F.col("target_date") <= F.to_date(F.lit(last)))):
        if given is not None:
            goals = goals.where(condition)
    return goals


def schedule(plans: DataFrame, days: DataFrame, first: str, last: str) -> DataFrame:
    """Days in a window of each athlete's newest active plan; among plans made at one instant the larger id counts."""
    newest = plans.where(F.col("status") == "active").groupBy("athlete").agg(F.max_by("plan_id", F.struct("created_at", "plan_id")).alias("plan_id"))
    return days.join(newest, "plan_id").where(F.col("day").between(F.to_date(F.lit(first)), F.to_date(F.lit(last))))


def owned_or_shared(library: DataFrame, athlete) -> DataFrame:
    """Library entries of an athlete, and those that belong to nobody."""
    return library.where(F.col("athlete").isNull() | (F.col("athlete") == F.lit(athlete)))


def history(versions: DataFrame, first: str, last: str, on: Sequence[str] = ("key",), since: str = "effective_date", ident: str = "id") -> DataFrame:
    """Versions that took effect in a window, numbered in order of (date, id) for each key."""
    rows = versions.where(F.col(since).between(F.to_date(F.lit(first)), F.to_date(F.lit(last))))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*on).orderBy(since, ident)))


def latest_available(metric: DataFrame, order: str, value: str, on: Sequence[str] = ("key",)) -> DataFrame:
    """The newest row of each key whose metric was computed; keys without one have none."""
    return metric.where(F.col(value).isNotNull()).groupBy(*on).agg(F.max(order).alias(order), F.max_by(value, order).alias(value))


def latest_form(days: DataFrame, least_ctl: float = 1.0) -> DataFrame:
    """``(key, day, form)``: form of the latest computed day; null where fitness is still below ``least_ctl`` on that day."""
    latest = days.where(F.col("ctl").isNotNull()).groupBy("key").agg(F.max("day").alias("day"), F.max_by(F.struct("tsb", "ctl"), "day").alias("v"))
    return latest.select("key", "day", F.when(F.col("v.ctl") >= least_ctl, F.col("v.tsb")).alias("form"))


def span(activities: DataFrame) -> DataFrame:
    """First and last local day of each athlete, with the number of activities and the last one's id."""
    order = F.struct("start", "activity_id")
    return activities.groupBy("athlete").agg(F.count(F.lit(1)).alias("n"), F.min_by("local_date", order).alias("first_day"), F.max_by("local_date", order).alias("last_day"), F.max_by("activity_id", order).alias("last_activity"))


def suspect(connections: DataFrame, reference: Column, stale_days: int = C.SYNC_STALE_DAYS) -> DataFrame:
    """Whether any of an athlete's connections should deliver and doesn't: broken, never synced, or silent for longer than
    ``stale_days``. A deliberate disconnection isn't suspect."""
    silent = F.col("last_synced_at").isNull() | (F.datediff(reference, F.to_date("last_synced_at")) > stale_days)
    bad = F.col("status").isin("reauth_required", "error") | ((F.col("status") == "connected") & silent)
    return connections.groupBy("athlete").agg(F.bool_or(F.coalesce(bad, F.lit(False))).alias("suspect"))


def load_targets(days: DataFrame) -> DataFrame:
    """Weekly and four-weekly load that hold a day's fitness; null where fitness is unknown."""
    return days.select("key", "day", (7 * F.col("ctl")).alias("weekly_target"), (28 * F.col("ctl")).alias("monthly_target"))


def completeness(checks: DataFrame) -> DataFrame:
    """Present share of each key's checks ``(key, input, status)``, to four places, with counts by status."""
    count = lambda s: F.count_if(F.col("status") == s)
    return checks.groupBy("key").agg(F.round(ratio(count("present"), F.count(F.lit(1))), 4).alias("completeness"), count("present").alias("present"), count("stale").alias("stale"), count("missing").alias("missing"))


def next_step(setup: DataFrame) -> DataFrame:
    """``(athlete, step)`` from ``(athlete, n_connections, n_activities, ftp_w)``; the threshold is the one in force now."""
    has_data = F.coalesce(F.col("n_activities") > 0, F.lit(False))
    step = F.when(has_data & F.col("ftp_w").isNotNull(), "all_set").when(has_data, "set_ftp").when(F.coalesce(F.col("n_connections") > 0, F.lit(False)), "run_first_sync").otherwise("connect_a_source")
    return setup.select("athlete", step.alias("step"))


def fitness_points(days: DataFrame, loads: DataFrame) -> DataFrame:
    """Chart points of fitness: each day's values with the load of that day; a provisional day is flagged."""
    joined = days.join(loads.select("key", "day", F.col("load").alias("day_load")), ["key", "day"], "left")
    return joined.select("key", "day", "ctl", "atl", "tsb", "day_load", F.col("day_load").isNull().alias("provisional"))


def critical_power_points(fits: DataFrame, curve: DataFrame, durations: Sequence[int]) -> DataFrame:
    """Chart points of a fit: for each duration what the model gives, W'/t + CP, beside what was observed."""
    grid = fits.where(F.col("cp_w").isNotNull()).withColumn("duration_s", F.explode(F.array(*(F.lit(d).cast("long") for d in durations))))
    joined = grid.join(curve.select("key", "duration_s", F.col("best_w").alias("observed_w")), ["key", "duration_s"], "left")
    return joined.select("key", "duration_s", (F.col("w_prime_j") / F.col("duration_s") + F.col("cp_w")).alias("predicted_w"), "observed_w")


def bounds(track: DataFrame) -> DataFrame:
    """The box around each key's positions."""
    return track.groupBy("key").agg(F.min("lat").alias("south"), F.max("lat").alias("north"), F.min("lng").alias("west"), F.max("lng").alias("east"), F.count("lat").alias("n"))


def seeded_window(days: DataFrame, first: str, last: str, seed_ctl: float | None = None, seed_atl: float | None = None, ctl_days: float = C.CTL_DAYS, atl_days: float = C.ATL_DAYS) -> DataFrame:
    """A stretch of ``days(key, day, load)`` with fitness, fatigue and form carried on from a seed, not from the first day.

    A stretch that begins with a key's first day starts from zero. One that begins later needs a finite seed; without it
    every day of the key is ``not_seeded``, as fitness that starts from zero in the middle of a history would be wrong.
    """
    from strideframe.operators.load import pmc

    low, high = F.to_date(F.lit(first)), F.to_date(F.lit(last))
    begin = days.groupBy("key").agg(F.min("day").alias("begin_"))
    inside = days.where(F.col("day").between(low, high)).join(begin, "key")
    given = [x is not None and x == x and abs(x) != float("inf") for x in (seed_ctl, seed_atl)]
    lacking = (F.col("begin_") < low) if not all(given) else F.lit(False)
    grid = inside.select("key", "day", "load", F.lit(False).alias("substituted"))
    rows = pmc(grid, ctl_days, atl_days, seed_ctl if all(given) else 0.0, seed_atl if all(given) else 0.0).join(begin, "key")
    why = F.coalesce(ladder([(lacking, "not_seeded")]), F.col("reason"))
    return rows.select("key", "day", *(F.when(why.isNull(), F.col(c)).alias(c) for c in ("ctl", "atl", "tsb")), why.alias("reason"))
