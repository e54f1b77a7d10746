"""Daily training load: calendar grid, fitness, fatigue and form."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strideframe.functions import constants as C
from strideframe.functions.result import finite

#: Days to a block of the running sums, so that the largest exponential stays far from overflow.
BLOCK_DAYS = 1024


def daily_grid(loads: DataFrame, through: str | None = None) -> DataFrame:
    """Every day from a key's first to its last (or to ``through``, a date); a day without activity has load 0.

    ``loads(key, day, load, substituted)`` has a row for each day with activity; a null load (activity, but nothing
    computable) stays null. Adds ``loaded``.
    """
    last = F.max("day") if through is None else F.greatest(F.max("day"), F.to_date(F.lit(through)))
    days = loads.groupBy("key").agg(F.explode(F.sequence(F.min("day"), last)).alias("day"))
    found = days.join(loads.withColumn("loaded", F.lit(True)), ["key", "day"], "left")
    loaded = F.coalesce("loaded", F.lit(False))
    return found.select("key", "day", F.when(loaded, F.col("load")).otherwise(0.0).alias("load"), F.coalesce("substituted", F.lit(False)).alias("substituted"), loaded.alias("loaded"))


def _smoothed(days: float, index: Column, load: Column, seed: Column | float) -> tuple[Column, Column]:
    """The exponentially weighted average with time constant ``days``, as window sums.

    With c = exp(-1/days): inside a block, (1-c) * exp(-r/days) * sum(load * exp(r/days)) over the days r so far; earlier
    blocks reach on through their last values (a value two blocks back has decayed by c**1024).
    """
    c = math.exp(-1 / days)
    r = index % BLOCK_DAYS
    inside = Window.partitionBy("key", F.floor(index / BLOCK_DAYS)).orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("key").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    own = (1 - c) * F.exp(-r / days) * F.sum(load * F.exp(r / days)).over(inside)
    return own, before


def pmc(grid: DataFrame, ctl_days: float = C.CTL_DAYS, atl_days: float = C.ATL_DAYS, seed_ctl: float = 0.0, seed_atl: float = 0.0) -> DataFrame:
    """Fitness (ctl), fatigue (atl) and form (tsb) for each day of a gap-free ``grid(key, day, load, ...)``.

    A null load decays as 0 and makes its day provisional. Form is the day before's fitness less its fatigue, the seeds'
    on the first day. Confidence is 1, times 0.5 on provisional and 0.7 on substituted days. A load that isn't finite puts
    all days of its key out of domain: they have a ``reason`` and no values.
    """
    per_key = Window.partitionBy("key").orderBy("day")
    rows = grid.withColumn("i", F.row_number().over(per_key) - 1).withColumn("known", F.coalesce("load", F.lit(0.0)))
    i, known = F.col("i"), F.col("known")
    ends = F.col("i") % BLOCK_DAYS == BLOCK_DAYS - 1
    for name, days, seed in (("ctl", ctl_days, seed_ctl), ("atl", atl_days, seed_atl)):
        own, before = _smoothed(days, i, known, seed)
        c = math.exp(-1 / days)
        rows = rows.withColumn("own", own)
        rows = rows.withColumn("back1", F.coalesce(F.last(F.when(ends, F.col("own")), ignorenulls=True).over(before), F.lit(0.0)))
        rows = rows.withColumn("back2", F.coalesce(F.last(F.when(ends, F.col("back1")), ignorenulls=True).over(before), F.lit(0.0)))
        carried = F.exp(-(i % BLOCK_DAYS + 1) / days) * (F.col("back1") + c**BLOCK_DAYS * F.col("back2"))
        rows = rows.withColumn(name, F.col("own") + carried + seed * F.exp(-(i + 1) / days)).drop("own", "back1", "back2")
    form = F.lag(F.col("ctl") - F.col("atl"), 1, seed_ctl - seed_atl).over(per_key)
    provisional = F.col("load").isNull()
    bad = F.coalesce(F.bool_or(F.col("load").isNotNull() & ~finite(F.col("load"))).over(Window.partitionBy("key")), F.lit(False))
    why = F.when(bad, "out_of_domain")
    confidence = F.when(provisional, C.PROVISIONAL_CONFIDENCE).otherwise(1.0) * F.when(F.col("substituted"), C.SUBSTITUTED_CONFIDENCE).otherwise(1.0)
    rows = rows.select("key", "day", "load", "ctl", "atl", form.alias("tsb"), provisional.alias("provisional"), "substituted", confidence.alias("confidence"), why.alias("reason"))
    return rows.withColumns({c: F.when(F.col("reason").isNull(), F.col(c)) for c in ("ctl", "atl", "tsb", "confidence")})
