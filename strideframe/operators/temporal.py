"""Joins and splits along time: effective-dated lookup, band join, interval containment, local days."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strideframe.functions import constants as C


def as_of(probes: DataFrame, versions: DataFrame, on: Sequence[str], at: str, since: str, values: Sequence[str], gate: Column | None = None, bucket: str = "month") -> DataFrame:
    """``probes`` with the ``values`` of the latest version whose ``since`` is not after ``at``; null where there is none.

    Versions and probes of a key and a stretch of time (``bucket``, a unit of date_trunc) stand in one order and each probe
    takes the last version before it, so no probe meets more than its own version and a key with many rows is spread over
    its stretches. The version in force at the start of a stretch is carried in from the key's earlier ones, of which each
    adds one row. Versions must be unique in (keys, since). ``gate`` is over the version's columns and is asked after the
    choice: a version that it rejects gives nulls, not an older version.
    """
    held = F.struct(*(F.col(v).alias(v) for v in (since, *values)), *([gate.alias("ok")] if gate is not None else []))
    stretch = F.date_trunc(bucket, "at_").alias("stretch_")
    v = versions.select(*on, F.col(since).cast("timestamp").alias("at_"), F.lit(1).alias("kind_"), held.alias("held")).select("*", stretch)
    p = probes.select(*on, F.col(at).cast("timestamp").alias("at_"), F.lit(2).alias("kind_"), F.struct("*").alias("probe")).select("*", stretch)
    last = v.select(*on, "stretch_", "at_", "held").unionByName(p.select(*on, "stretch_"), allowMissingColumns=True)
    last = last.groupBy(*on, "stretch_").agg(F.max_by("held", "at_").alias("held"))
    earlier = Window.partitionBy(*on).orderBy("stretch_").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.select(*on, "stretch_", F.col("stretch_").alias("at_"), F.lit(0).alias("kind_"), F.last("held", ignorenulls=True).over(earlier).alias("held"))
    both = v.unionByName(carried).unionByName(p, allowMissingColumns=True)
    before = Window.partitionBy(*on, "stretch_").orderBy("at_", "kind_").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("found", F.last("held", ignorenulls=True).over(before)).where("kind_ = 2")
    ok = F.col("found.ok") if gate is not None else F.lit(True)
    return found.select("probe.*", *(F.when(ok, F.col(f"found.{c}")).alias(c) for c in (since, *values)))


def band_join(left: DataFrame, right: DataFrame, on: Sequence[str], left_at: Column, right_at: Column, width: float, keep: Column | None = None) -> DataFrame:
    """Pairs with equal ``on`` columns whose times (numbers) differ by at most ``width``.

    Times fall into buckets of the band's width; each left row meets its own and the two neighbouring buckets in an equal
    join, so no pair outside three buckets is formed. Columns: ``l`` and ``r`` structs. ``keep`` is a further condition.
    """
    a = left.select(*on, F.struct("*").alias("l"), left_at.alias("at_l"))
    a = a.withColumn("bucket", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.floor(F.col("at_l") / width) + d)))
    b = right.select(*on, F.struct("*").alias("r"), right_at.alias("at_r")).withColumn("bucket", F.floor(F.col("at_r") / width))
    pairs = a.join(b, [*on, "bucket"]).where(F.abs(F.col("at_l") - F.col("at_r")) <= width)
    return (pairs.where(keep) if keep is not None else pairs).select(*on, "l", "r")


def same_session(l: str = "l", r: str = "r") -> Column:
    """Two recordings are one session: equal sport, and an equal fingerprint or starts within 120 s and durations within
    the larger of 60 s and 5 %."""
    a, b = (lambda c: F.col(f"{l}.{c}")), (lambda c: F.col(f"{r}.{c}"))
    start = F.abs(F.unix_timestamp(a("start")) - F.unix_timestamp(b("start"))) <= C.MATCH_START_S
    slack = F.greatest(F.lit(float(C.MATCH_DURATION_S)), C.MATCH_DURATION_SHARE * F.greatest(a("duration_s"), b("duration_s")))
    close = start & (F.abs(a("duration_s") - b("duration_s")) <= slack)
    print_ = F.coalesce(a("fingerprint") == b("fingerprint"), F.lit(False))
    return (a("sport") == b("sport")) & (print_ | F.coalesce(close, F.lit(False)))


def contained(gaps: DataFrame, ranges: DataFrame, on: Sequence[str]) -> DataFrame:
    """Open gaps that lie wholly inside one synced range of the same scope: closed, with the earliest start of such a range.

    ``ranges`` are merged to disjoint islands first, so a gap can lie in one island at most and one lookup of the latest
    island that starts at or before it is enough. A gap that spans two touching ranges is closed too.
    """
    order = Window.partitionBy(*on).orderBy("range_start", "range_end")
    reach = F.max("range_end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = ranges.withColumn("opens", F.coalesce(F.col("range_start") > reach, F.lit(True)).cast("int"))
    islands = marked.withColumn("island", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    merged = islands.groupBy(*on, "island").agg(F.min("range_start").alias("island_start"), F.max("range_end").alias("island_end")).drop("island")
    found = as_of(gaps, merged, on, "gap_start", "island_start", ["island_end"])
    closed = F.coalesce(F.col("gap_end") <= F.col("island_end"), F.lit(False))
    return found.withColumn("closed", closed).withColumn("closed_by", F.when(closed, F.col("island_start"))).drop("island_start", "island_end")


def local_day(instant: Column, zone: Column, effective_from: Column | None = None, prior: Column | None = None) -> Column:
    """The date of an instant on the wall clock of an IANA zone; an instant before the zone took effect keeps its prior day."""
    day = F.to_date(F.from_utc_timestamp(instant, zone))
    return day if effective_from is None else F.when((instant < effective_from) & prior.isNotNull(), prior).otherwise(day)


def day_bounds(day: Column, zone: Column) -> tuple[Column, Column]:
    """The half-open range of instants that make up a local day."""
    return F.to_utc_timestamp(day.cast("timestamp"), zone), F.to_utc_timestamp(F.date_add(day, 1).cast("timestamp"), zone)


def chunks(spans: DataFrame, days: int) -> DataFrame:
    """Each span ``(key, first, last)`` of dates cut into contiguous pieces of at most ``days`` days, the oldest first."""
    starts = F.sequence("first", "last", F.expr(f"interval {days} days"))
    cut = spans.select("key", "last", F.posexplode(starts).alias("chunk", "chunk_from"))
    return cut.select("key", F.col("chunk").cast("long").alias("chunk"), "chunk_from", F.least(F.date_add("chunk_from", days - 1), "last").alias("chunk_through"))


def intervals(versions: DataFrame, on: Sequence[str], since: str) -> DataFrame:
    """Slowly changing rows with ``effective_to``: the date at which the next version of the key takes effect."""
    return versions.withColumn("effective_to", F.lead(since).over(Window.partitionBy(*on).orderBy(since)))
