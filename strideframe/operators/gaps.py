"""Incremental delivery: discovery, typed gaps, self-healing by token, window narrowing, freshness, backfill."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strideframe.sources.scratch import scratch

#: A stage of more references is worked in ranges.
HOT_ROWS = 1 << 20
GAP = ("scope", "gbo_type", "reason", "transient", "range_start_at", "range_end_at", "start_token", "end_token")


def to_fetch(refs: DataFrame, watermarks: DataFrame, on: Sequence[str]) -> DataFrame:
    """References that a run must fetch: those without a hint, and those changed after their scope's high water."""
    joined = refs.join(watermarks.select(*on, "high_water_at"), list(on), "left")
    keep = F.col("hint").isNull() | F.col("high_water_at").isNull() | (F.col("hint") > F.col("high_water_at"))
    return joined.where(keep).drop("high_water_at")


def pages(refs: DataFrame, stages: Sequence[str], size: int, on: Sequence[str] = ("scope",), hot_rows: int = HOT_ROWS) -> DataFrame:
    """References with their page's cursor ``stage:offset`` and that of the page after it, null on the last.

    Stages follow one another in the order given; inside a stage references stand by id. Where a stage of a scope has over
    ``hot_rows`` of them, all are written in ranges of ids, and a range's places begin where those of earlier ranges end.
    """
    keys = [*on, "stage"]
    counts = refs.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_"))
    order = F.array_position(F.array(*(F.lit(s) for s in stages)), F.col("stage"))
    following = F.lead("stage").over(Window.partitionBy(*on).orderBy(order))
    page = lambda place: (F.floor(place / size) * size).cast("long")
    in_stage = counts.select(*keys, page(F.col("n_") - 1).alias("last_offset"), following.alias("next_stage"))
    if (counts.agg(F.max("n_")).first()[0] or 0) > hot_rows:
        rows, keys = _in_ranges(refs, [*keys, "ref_id"]), [*keys, "range_"]
        upto = F.sum("n_").over(Window.partitionBy(*on, "stage").orderBy("range_").rowsBetween(Window.unboundedPreceding, -1))
        ranges = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_")).withColumn("before_", F.coalesce(upto, F.lit(0)))
        in_stage = ranges.join(in_stage, [*on, "stage"]).drop("n_")
    else:
        rows, in_stage = refs, in_stage.withColumn("before_", F.lit(0))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("ref_id")) - 1 + F.col("before_")
    joined = rows.join(in_stage, keys).withColumn("offset", page(place))
    ahead = F.when(F.col("offset") < F.col("last_offset"), F.concat_ws(":", "stage", (F.col("offset") + size).cast("string"))).when(F.col("next_stage").isNotNull(), F.concat("next_stage", F.lit(":0")))
    out = joined.withColumn("cursor", F.concat_ws(":", "stage", F.col("offset").cast("string"))).withColumn("next_cursor", ahead)
    return out.select(*refs.columns, "cursor", "next_cursor")


def _in_ranges(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rows, written and read again, with the number ``range_`` of the range of ``by`` that holds them."""
    at = scratch(rows.sparkSession, "ranges")
    rows.repartitionByRange(*by).withColumn("range_", F.spark_partition_id()).write.parquet(at)
    return rows.sparkSession.read.parquet(at)


def open_gaps(failures: DataFrame) -> DataFrame:
    """Typed gaps of what a run could not land: a failed record is a gap of its token alone, a failed window a gap of its
    range. A record type that its source hasn't declared never heals by itself.

    ``failures(scope, gbo_type, reason, token, window_start, window_end)``.
    """
    single = F.col("token").isNotNull()
    return failures.select(
        "scope", "gbo_type", "reason", (F.col("reason") != "schema_mismatch").alias("transient"),
        F.when(~single, F.col("window_start")).alias("range_start_at"), F.when(~single, F.col("window_end")).alias("range_end_at"),
        F.col("token").alias("start_token"), F.col("token").alias("end_token"),
    )


def close_by_token(gaps: DataFrame, landed: DataFrame, on: Sequence[str] = ("scope",)) -> DataFrame:
    """Gaps with ``closed``: transient gaps of a single record whose token has landed. Others, and terminal ones, stay."""
    tokens = landed.select(*on, F.col("token").alias("start_token")).distinct().withColumn("landed_", F.lit(True))
    joined = gaps.join(tokens, [*on, "start_token"], "left")
    single = F.col("start_token").isNotNull() & (F.col("start_token") == F.col("end_token"))
    return joined.withColumn("closed", F.coalesce(F.col("landed_") & F.col("transient") & single, F.lit(False))).drop("landed_")


def synced_range(oldest: Column, newest: Column) -> tuple[Column, Column]:
    """What a run over the days from ``oldest`` to ``newest`` has covered: midnight of the first to the last second of the last."""
    return oldest.cast("timestamp"), F.date_add(newest, 1).cast("timestamp") - F.expr("interval 1 second")


def narrowed(windows: DataFrame, watermarks: DataFrame, on: Sequence[str]) -> DataFrame:
    """Windows ``(oldest, newest)`` that start no earlier than the day of the lowest high water of their scope's record types;
    types without one are passed over, and a scope without any keeps its window. A high water past the window leaves its
    last day."""
    floor = watermarks.groupBy(*on).agg(F.min("high_water_at").alias("floor_at"))
    joined = windows.join(floor, list(on), "left")
    start = F.greatest("oldest", F.coalesce(F.to_date("floor_at"), F.col("oldest")))
    return joined.withColumn("oldest", F.least(start, F.col("newest")))


def freshness(observed: DataFrame, now: Column, on: Sequence[str]) -> DataFrame:
    """Seconds from each scope's latest observation to now, never below 0; null where nothing was observed."""
    latest = observed.groupBy(*on).agg(F.max("observed_at").alias("latest"))
    return latest.select(*on, F.when(F.col("latest").isNotNull(), F.greatest(F.lit(0), F.unix_timestamp(now) - F.unix_timestamp("latest"))).alias("lag_s"))


def backfill_state(chunks: DataFrame, outcomes: DataFrame, on: Sequence[str] = ("key",)) -> DataFrame:
    """Chunks of a backfill with ``status``: ``skipped`` when an earlier run committed it, ``done``, the failure at which the run
    stopped, or ``pending`` after that.

    ``chunks(key, chunk, committed)``, ``outcomes(key, chunk, ok)``: what the source would answer.
    """
    rows = chunks.join(outcomes, [*on, "chunk"], "left")
    ok = F.col("committed") | F.coalesce("ok", F.lit(False))
    before = Window.partitionBy(*on).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    stopped = F.coalesce(F.bool_or(~ok).over(before), F.lit(False))
    status = F.when(F.col("committed"), "skipped").when(stopped, "pending").when(ok, "done").otherwise("failed")
    return rows.withColumn("status", status).drop("ok")


def run_counters(results: DataFrame, on: Sequence[str] = ("run_id",)) -> DataFrame:
    """Counts of a run's records by outcome, and whether it is degraded: any gap, failure or quarantined record."""
    count = lambda s: F.count_if(F.col("outcome") == s)
    out = results.groupBy(*on).agg(*(count(s).alias(s) for s in ("persisted", "failed", "quarantined", "advanced", "closed")))
    return out.withColumn("degraded", (F.col("failed") > 0) | (F.col("quarantined") > 0))


def retry_waits(attempts: DataFrame, base_s: float, most_s: float, budget_s: float, most_attempts: int) -> DataFrame:
    """When a request is tried again: ``(request_id, attempt, status, retry_after_s, draw)`` with ``wait_s``, null where it is not.

    429 and 5xx are tried again, after what the server asks for or else a random share (``draw``, 0 to 1) of the ceiling
    min(base * 2**attempt, most); not beyond the attempts, nor where the waits so far would exceed the budget.
    """
    again = (F.col("status") == 429) | F.col("status").between(500, 599)
    ceiling = F.least(F.lit(base_s) * F.pow(F.lit(2.0), F.col("attempt")), F.lit(most_s))
    wait = F.when(again & (F.col("attempt") + 1 < most_attempts), F.coalesce("retry_after_s", ceiling * F.col("draw")))
    so_far = F.sum("w_").over(Window.partitionBy("request_id").orderBy("attempt").rowsBetween(Window.unboundedPreceding, 0))
    rows = attempts.withColumn("w_", wait).withColumn("sum_", so_far)
    return rows.withColumn("wait_s", F.when(F.col("sum_") <= budget_s, F.col("w_"))).drop("w_", "sum_")
