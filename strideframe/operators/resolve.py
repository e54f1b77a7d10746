"""Conflict resolution between sources: trust order, winning values, disputes, versions, validation, tombstones."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strideframe.functions import constants as C
from strideframe.functions.scalars import versioned_id

KEYS = ("trust_tier", "confidence", "recency", "completeness", "stable_tiebreak")


def tier_rank(tier: Column) -> Column:
    """0 for the most trusted tier; an unknown or outcome tier is worst."""
    out = F.lit(len(C.TIERS))
    for rank, name in reversed(list(enumerate(C.TIERS))):
        out = F.when(tier == name, rank).otherwise(out)
    return out


def effective_tier(*layers: Column, default: str = "platform_computed") -> Column:
    """The first layer that names a ranked tier (per-athlete channel, per-athlete ``*``, profile channel, profile ``*``, own tier);
    other tokens are passed over."""
    return F.coalesce(*(F.when(x.isin(*C.TIERS), x) for x in layers), F.lit(default))


def sort_key(tier="tier", confidence="confidence", observed="observed", completeness="completeness", source="source") -> list[Column]:
    return [tier_rank(F.col(tier)), -F.col(confidence), -F.unix_micros(F.col(observed)), -F.col(completeness), F.col(source)]


def deciding(first: Column, second: Column) -> Column:
    """The first of the five keys on which the winner and the runner-up differ, the last where none does."""
    rule = F.lit(KEYS[-1])
    for i in reversed(range(len(KEYS))):
        rule = F.when(first[f"k{i}"] != second[f"k{i}"], KEYS[i]).otherwise(rule)
    return rule


def in_dispute(high: Column, low: Column, values: Column) -> Column:
    spread = (high - low) / F.greatest(F.lit(1.0), F.abs(high))
    return F.coalesce((values >= 2) & (spread > C.DISPUTE_TOLERANCE), F.lit(False))


def winners(rows: DataFrame, on: Sequence[str], tie: Sequence[str] = (), value: str = "value") -> DataFrame:
    """One row per key: the winning candidate's columns, the rule that decided, the number of candidates and whether they
    disagree.

    The five keys are compared in order; the rule is the first on which the winner and the runner-up differ, the last where
    none does, ``sole_contributor`` without a runner-up. Candidates are in dispute if two or more have values that differ by over 5 % of the larger of
    one and the largest. The rank is cut at two, so that a group is pruned to its two best
    before it is shuffled.
    """
    keyed = rows.select(*on, F.struct(*(c.alias(f"k{i}") for i, c in enumerate(sort_key())), *(F.col(c).alias(c) for c in tie)).alias("key_"), F.struct("*").alias("row_"))
    rank = F.row_number().over(Window.partitionBy(*on).orderBy("key_"))
    top = keyed.withColumn("rank_", rank).where("rank_ <= 2").groupBy(*on).agg(F.min("key_").alias("first"), F.max("key_").alias("second"), F.min_by("row_", "rank_").alias("w"))
    sums = rows.groupBy(*on).agg(F.count(F.lit(1)).alias("n"), F.max(value).alias("high"), F.min(value).alias("low"), F.count(value).alias("values"))
    two = top.join(sums, list(on))
    rule, disputed = deciding(F.col("first"), F.col("second")), in_dispute(F.col("high"), F.col("low"), F.col("values"))
    return two.select(*on, "w", F.when(F.col("n") == 1, "sole_contributor").otherwise(rule).alias("rule"), "n", disputed.alias("disputed"))


def current_version(log: DataFrame, on: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The latest version of each key; re-delivered rows of equal order are one version."""
    latest = Window.partitionBy(*on).orderBy(*order)
    return log.withColumn("rn_", F.row_number().over(latest)).where("rn_ = 1").drop("rn_")


def versions(log: DataFrame, on: Sequence[str], order: Sequence[Column], native: str, digest: str) -> DataFrame:
    """All versions of each key with ``is_superseded``: the latest keeps its native id, an older one is named by its hash. Versions
    of one hash are one, however often they were delivered."""
    once = log.dropDuplicates([*on, digest])
    place = F.row_number().over(Window.partitionBy(*on).orderBy(*order))
    rows = once.withColumn("is_superseded", place > 1)
    return rows.withColumn(native, F.when(F.col("is_superseded"), versioned_id(F.col(native), F.col(digest))).otherwise(F.col(native)))


def first_violation(rules: Sequence[tuple[str, Column]]) -> Column:
    """The id of the first rule that a row breaks, null for a sound row."""
    return F.coalesce(*(F.when(F.coalesce(bad, F.lit(False)), F.lit(name)) for name, bad in rules))


def out_of_range(column: str, low: float, high: float) -> tuple[str, Column]:
    return f"RANGE:{column}", ~F.col(column).between(low, high)


def without_tombstones(rows: DataFrame, tombstones: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows whose key no tombstone names."""
    return rows.join(tombstones.select(*on).distinct(), list(on), "left_anti")


def contributing(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """Rows that aren't superseded, tombstones or quarantined, and whose source is active."""
    live = rows.where(~F.col("is_superseded") & ~F.col("is_tombstone") & F.col("quarantine_rule").isNull())
    return live.join(sources.where("is_active").select("source"), "source", "left_semi")


def upserted(stored: DataFrame, batch: DataFrame, on: Sequence[str], position: str) -> DataFrame:
    """``stored`` after an upsert of ``batch``: of a batch's rows of one key the last by ``position`` counts; other columns of a
    key that is met are replaced whole. On tables with row-level updates the same rows go through MERGE."""
    last = current_version(batch, on, [F.desc(position)]).drop(position)
    return stored.join(last.select(*on), list(on), "left_anti").unionByName(last)


def resolve_fields(rows: DataFrame, on: Sequence[str], fields: Sequence[str], tie: Sequence[str] = ()) -> DataFrame:
    """Each field's winning value by itself: sources without a value for a field don't take part in it.

    One row per key with, for each field, its value (null where no source has one), ``<field>_source`` and
    ``<field>_rule``.
    """
    shared = ["tier", "confidence", "observed", "completeness", "source", *tie]
    pairs = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).cast("double").alias("value")) for f in fields))
    long = rows.select(*on, *shared, F.inline(pairs)).where("value IS NOT NULL")
    won = winners(long, [*on, "field"], tie).select(*on, "field", F.struct(F.col("w.value").alias("value"), F.col("w.source").alias("source"), "rule").alias("r"))
    wide = won.groupBy(*on).pivot("field", list(fields)).agg(F.first("r"))
    every = rows.select(*on).distinct().join(wide, list(on), "left")
    return every.select(*on, *(c for f in fields for c in (F.col(f"{f}.value").alias(f), F.col(f"{f}.source").alias(f"{f}_source"), F.col(f"{f}.rule").alias(f"{f}_rule"))))
