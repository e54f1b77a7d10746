"""Streams of samples: regular grids, trailing means, runs and gaps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strideframe.functions import constants as C
from strideframe.functions.result import ratio
from strideframe.functions.scalars import finite_or_null


#: Seconds that are made at once.
BLOCK_S = 3_600


def resample_1hz(samples: DataFrame, max_gap_s: float = C.MAX_GAP_S, keys: Sequence[str] = ("key",)) -> DataFrame:
    """``(*keys, t, v)`` at every whole second from 0 to the last sample's.

    ``samples(*keys, pos, t, v)``: of samples at one t the first by pos counts. A second that has a sample takes its value
    (null stays null); any other lies on the line between its neighbouring valid samples if these are at most
    ``max_gap_s`` apart, and is null otherwise.
    """
    first = samples.groupBy(*keys, "t").agg(F.min_by("v", "pos").alias("v"))
    # Seconds are made block by block, so that no row holds a whole recording's.
    last = samples.groupBy(*keys).agg(F.floor(F.max("t")).cast("long").alias("last"))
    blocks = last.select(*keys, "last", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last"), F.lit(BLOCK_S).cast("long"))).alias("from"))
    grid = blocks.select(*keys, F.explode(F.sequence("from", F.least(F.col("from") + (BLOCK_S - 1), F.col("last")))).alias("t"))
    on = grid.join(first.withColumn("hit", F.lit(True)), [*keys, "t"], "full_outer")
    order = Window.partitionBy(*keys).orderBy("t")
    # Looking ahead is looking back in the other order, which needs no more than a row at a time.
    back, ahead = order.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(*keys).orderBy(F.desc("t")).rowsBetween(Window.unboundedPreceding, 0)
    at = F.when(F.col("v").isNotNull(), F.col("t"))
    near = on.select(*keys, "t", "v", "hit", F.last("v", True).over(back).alias("v0"), F.last(at, True).over(back).alias("t0"), F.last("v", True).over(ahead).alias("v1"), F.last(at, True).over(ahead).alias("t1"))
    line = F.col("v0") + ratio((F.col("v1") - F.col("v0")) * (F.col("t") - F.col("t0")), F.col("t1") - F.col("t0"))
    value = F.when(F.col("hit"), F.col("v")).when(F.col("t1") - F.col("t0") <= max_gap_s, line)
    return near.where(F.col("t") == F.floor("t")).select(*keys, "t", value.alias("v"))


def channel_samples(channels: DataFrame, kind: str = "activity") -> DataFrame:
    """``(key, channel, pos, t, v)`` of ``channels(key, channel, set_kind, rate, values)``: the samples of the sets of a kind, at
    i / rate seconds; a rate that is null or not positive counts as 1. What isn't a finite number is a gap."""
    rate = F.when(F.col("rate") > 0, F.col("rate").cast("double")).otherwise(1.0)
    rows = channels.where(F.col("set_kind") == kind).select("key", "channel", rate.alias("rate"), F.posexplode("values").alias("pos", "v"))
    return rows.select("key", "channel", "pos", (F.col("pos") / F.col("rate")).alias("t"), finite_or_null(F.col("v")).alias("v"))


def aligned_channels(samples: DataFrame, channels: Sequence[str], max_gap_s: float = C.MAX_GAP_S) -> DataFrame:
    """``(key, t, *channels)``: the channels of ``samples(key, channel, pos, t, v)`` on one grid of whole seconds.

    Each channel is put on the grid by its own times. The grid ends with the shortest of those channels that the key has; a
    channel that it doesn't have is null throughout.
    """
    wanted = samples.where(F.col("channel").isin(*channels))
    ends = wanted.groupBy("key", "channel").agg(F.floor(F.max("t")).alias("end")).groupBy("key").agg(F.min("end").alias("end"))
    grid = resample_1hz(wanted.join(ends, "key").where(F.floor("t") <= F.col("end") + F.ceil(F.lit(max_gap_s))).drop("end"), max_gap_s, ("key", "channel"))
    rows = grid.groupBy("key", "t").agg(*(F.max(F.when(F.col("channel") == c, F.col("v"))).alias(c) for c in channels))
    return rows.join(ends, "key").where(F.col("t") <= F.col("end")).select("key", "t", *channels)


def seeded_mean(stream: DataFrame, column: str, width: int, out: str = "mean", keys: tuple[str, ...] = ("key",), order: str = "t") -> DataFrame:
    """The mean of the last ``width`` rows, null unless all of them are valid."""
    last = Window.partitionBy(*keys).orderBy(order).rowsBetween(-(width - 1), 0)
    return stream.withColumn(out, F.when(F.count(column).over(last) == width, F.avg(column).over(last)))


def runs(stream: DataFrame, column: str) -> DataFrame:
    """One row per key: samples, valid samples, longest run of valid samples, and number of runs of gaps."""
    order = Window.partitionBy("key").orderBy("t")
    valid = F.col(column).isNotNull()
    marked = stream.select("key", "t", valid.alias("valid"), F.row_number().over(order).alias("i"), (~valid & F.lag(valid, 1, True).over(order)).alias("opens"))
    islands = marked.withColumn("island", F.col("i") - F.sum(F.col("valid").cast("long")).over(order))
    sizes = islands.groupBy("key", "island").agg(F.count(F.lit(1)).alias("rows"), F.count_if("valid").alias("n"), F.count_if("opens").alias("opens"))
    return sizes.groupBy("key").agg(F.sum("rows").alias("samples"), F.sum("n").alias("valid"), F.max("n").alias("longest_run"), F.sum("opens").alias("gap_runs"))
