"""From contributing candidates to canonical records: channels, laps, wellness days, re-resolution, effective-dated writes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strideframe.functions import constants as C
from strideframe.operators.resolve import deciding, in_dispute, resolve_fields, sort_key, tier_rank


def substitution(channel: Column, tier: Column, top_tiers: Mapping[str, str]) -> Column:
    """The displaced top tier of a channel's equivalence class where the winner ranks below it, else null.

    ``top_tiers`` names the class's best tier for each channel that has a class; a channel without one is its own.
    """
    out = F.lit(None).cast("string")
    for name, top in top_tiers.items():
        out = F.when((channel == name) & (tier_rank(tier) > C.TIERS.index(top)), F.lit(top)).otherwise(out)
    return out


def resolve_channels(channels: DataFrame, top_tiers: Mapping[str, str] = {}) -> DataFrame:
    """One row for each activity and channel that any candidate carries: the source of best tier for that channel, among equal
    tiers the one of the smaller id, with its fidelity (``substituted`` below the class's top).

    ``channels(activity_id, channel, source, tier, ...)``; further columns are those of the winner.
    """
    first = F.struct(tier_rank(F.col("tier")), F.col("source"))
    won = channels.groupBy("activity_id", "channel").agg(F.min_by(F.struct(*(c for c in channels.columns if c not in ("activity_id", "channel"))), first).alias("w"), F.count_distinct("source").alias("n_sources"))
    displaced = substitution(F.col("channel"), F.col("w.tier"), top_tiers)
    return won.select("activity_id", "channel", "w.*", "n_sources", F.when(displaced.isNotNull(), "substituted").otherwise(F.col("w.tier")).alias("fidelity"), displaced.alias("from_fidelity"))


def laps_of_best(laps: DataFrame, candidates: DataFrame) -> DataFrame:
    """Laps taken whole from one candidate for each activity: the one of best own tier, then of the smaller source id, among
    candidates that have laps. Re-ranking by settings doesn't count here."""
    with_laps = candidates.join(laps.select("candidate_id").distinct(), "candidate_id", "left_semi")
    best = with_laps.groupBy("activity_id").agg(F.min_by("candidate_id", F.struct(tier_rank(F.col("adapter_tier")), F.col("source"), F.col("candidate_id"))).alias("candidate_id"))
    return laps.join(best, "candidate_id")


def _by_field(candidates: DataFrame, on: Sequence[str], numbers: Sequence[str], words: Sequence[str]) -> DataFrame:
    """A row for each candidate and field that it has a value for."""
    none = {"number": F.lit(None).cast("double"), "word": F.lit(None).cast("string")}
    pair = lambda f, **v: F.struct(F.lit(f).alias("field"), *((none | v)[c].alias(c) for c in none))
    pairs = F.array(*(pair(f, number=F.col(f).cast("double")) for f in numbers), *(pair(f, word=F.col(f)) for f in words))
    completeness = F.when(F.coalesce("has_streams", F.lit(False)), 2.0).otherwise(1.0)
    rank = ["tier", F.coalesce("confidence", F.lit(1.0)).alias("confidence"), "observed", completeness.alias("completeness"), "source", "candidate_id"]
    return candidates.select(*on, *rank, F.inline(pairs)).where("number IS NOT NULL OR word IS NOT NULL")


def field_records(candidates: DataFrame, on: Sequence[str], numbers: Sequence[str], words: Sequence[str] = (), top_tiers: Mapping[str, str] = {}, failures: DataFrame | None = None) -> DataFrame:
    """How each field of each key was resolved, one row for every field of every key, absent ones included.

    ``candidates(candidate_id, source, tier, confidence, observed, has_streams, ...)``: a candidate without a confidence has
    1, one with streams comes before a bare summary where all else is equal. The row holds the winner's value (``number``
    or ``word``), source and candidate, the rule that decided, the number of candidates considered (``considered`` lists
    them) and the coverage: ``present``, ``fidelity`` and ``disputed``. Fidelity is the winner's tier, ``substituted`` with
    the displaced tier as ``from_fidelity`` below the top of the field's class, ``absent_true`` where no candidate has the
    field, ``absent_failed`` where ``failures(on, field)`` says that one should have. Numbers of UNDISPUTED_FIELDS and
    words are never in dispute.
    """
    names = [*numbers, *words]
    completeness = F.when(F.coalesce("has_streams", F.lit(False)), 2.0).otherwise(1.0)
    rank = ["tier", F.coalesce("confidence", F.lit(1.0)).alias("confidence"), "observed", completeness.alias("completeness"), "source", "candidate_id"]
    given = [F.col(f).cast("double" if f in numbers else "string").alias(f"v{i}_") for i, f in enumerate(names)]
    # Candidates are shuffled once, as they come; what is made for each field of them is made behind that.
    rows = candidates.select(*on, *rank, *given).repartition(*on).sortWithinPartitions(*on)
    own = F.struct(*(c.alias(f"k{i}") for i, c in enumerate(sort_key())), "candidate_id")
    whole = Window.partitionBy(*on)
    at = range(len(names))
    rows = rows.withColumn("key_", own).select("*", *(F.when(F.col(f"v{i}_").isNotNull(), F.col("key_")).alias(f"k{i}_") for i in at))
    rows = rows.select("*", *(F.min(f"k{i}_").over(whole).alias(f"first{i}_") for i in at))
    won = rows.groupBy(*on).agg(*(_won(i, f, f in numbers).alias(f"f{i}_") for i, f in enumerate(names)))
    failed = F.lit(False)
    if failures is not None:
        won = won.join(failures.groupBy(*on).agg(F.collect_set("field").alias("failed_")), list(on), "left")
        failed = F.coalesce(F.array_contains("failed_", F.col("field")), F.lit(False))
    rows = won.select(*on, *(["failed_"] if failures is not None else []), F.inline(F.array(*(f"f{i}_" for i in at))))
    present = F.col("n") > 0
    displaced = substitution(F.col("field"), F.col("w.tier"), top_tiers)
    fidelity = F.when(present & displaced.isNotNull(), "substituted").when(present, F.col("w.tier")).when(failed, "absent_failed").otherwise("absent_true")
    second = F.when(F.col("n_first") > 1, F.col("first")).otherwise(F.col("second"))
    rule = F.when(F.col("n") == 1, "sole_contributor").when(present, deciding(F.col("first"), second))
    return rows.select(
        *on, "field", "w.number", "w.word", F.col("first.k4").alias("source"), "first.candidate_id", rule.alias("rule"), F.col("n").alias("n_considered"),
        present.alias("present"), fidelity.alias("fidelity"), F.when(present, displaced).alias("from_fidelity"), in_dispute(F.col("high"), F.col("low"), F.col("values")).alias("disputed"),
    )


def _won(i: int, field: str, number: bool) -> Column:
    """What a key's candidates are to its field: the least and the next key, the winner's value, how many there are."""
    key, first, value = F.col(f"k{i}_"), F.col(f"first{i}_"), F.col(f"v{i}_")
    best = key.isNotNull() & key.eqNullSafe(first)
    pair = F.struct((value if number else F.lit(None).cast("double")).alias("number"), (F.lit(None).cast("string") if number else value).alias("word"), "tier")
    compared = value if number and field not in C.UNDISPUTED_FIELDS else F.lit(None).cast("double")
    return F.struct(
        F.lit(field).alias("field"), F.count(key).alias("n"), F.min(first).alias("first"), F.count_if(best).alias("n_first"), F.min(F.when(~best, key)).alias("second"), F.min(F.when(best, pair)).alias("w"),
        F.max(compared).alias("high"), F.min(compared).alias("low"), F.count(compared).alias("values"),
    )


def considered(candidates: DataFrame, on: Sequence[str], numbers: Sequence[str], words: Sequence[str] = ()) -> DataFrame:
    """``(on, field, candidate_id)``: every candidate that took part in resolving a field, as rows, however many there are."""
    return _by_field(candidates, on, numbers, words).select(*on, "field", "candidate_id")


def resolve_wellness(rows: DataFrame, stored: DataFrame, on: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Wellness days after a run: each field's winning value, and the stored one where no source has a value.

    Days of ``stored`` that no candidate names stay as they are.
    """
    won = resolve_fields(rows, on, fields).select(*on, *(F.col(f).alias(f"new_{f}") for f in fields))
    both = stored.select(*on, *fields).join(won, list(on), "full_outer")
    return both.select(*on, *(F.coalesce(f"new_{f}", f).alias(f) for f in fields))


def affected(records: DataFrame, source: Column, on: Sequence[str]) -> DataFrame:
    """The keys of canonical records to resolve again when a source changes: those to which it has a candidate."""
    return records.where(F.col("source") == source).select(*on).distinct()


def with_source_active(sources: DataFrame, changed: Column, active: bool) -> DataFrame:
    """Sources after one is switched off or on; nothing is deleted, so the switch can be undone."""
    return sources.withColumn("is_active", F.when(F.col("source") == changed, F.lit(active)).otherwise(F.col("is_active")))


def merged_resolution(stored: DataFrame, resolved: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    """Canonical rows after the ``keys`` were resolved again: a key with a fresh row takes it, one without any contributor
    keeps its stored row."""
    fresh = resolved.join(keys.select(*on).distinct(), list(on), "left_semi")
    return stored.join(fresh.select(*on), list(on), "left_anti").unionByName(fresh)


def split_off(candidates: DataFrame, splits: DataFrame) -> DataFrame:
    """Candidates after explicit splits ``(candidate_id, new_activity_id)``: a split candidate leaves its activity for a new
    one of its own; of several splits of one candidate the least id counts."""
    once = splits.groupBy("candidate_id").agg(F.min("new_activity_id").alias("new_activity_id"))
    joined = candidates.join(once, "candidate_id", "left")
    return joined.withColumn("activity_id", F.coalesce("new_activity_id", "activity_id")).drop("new_activity_id")


def without_positions(channels: DataFrame, athletes: DataFrame, position: str = "latlng") -> DataFrame:
    """Channels without the positions of athletes who opted out of raw positions (``athletes(athlete, keeps_gps)``)."""
    out = athletes.where(~F.col("keeps_gps")).select("athlete")
    return channels.where(F.col("channel") == position).join(out, "athlete", "left_anti").unionByName(channels.where(~F.col("channel").eqNullSafe(F.lit(position))))


def withheld_originals(files: DataFrame, athletes: DataFrame) -> DataFrame:
    """Original files with ``withheld``: those that hold positions, of athletes who opted out."""
    out = athletes.where(~F.col("keeps_gps")).select("athlete").distinct().withColumn("out_", F.lit(True))
    return files.join(out, "athlete", "left").withColumn("withheld", F.coalesce(F.col("out_") & F.col("has_gps"), F.lit(False))).drop("out_")


def record_versions(stored: DataFrame, incoming: DataFrame, on: Sequence[str], since: str = "effective_date") -> DataFrame:
    """Effective-dated rows after a write, with ``effective_to`` and ``refused``.

    An incoming row is refused unless it takes effect after every stored row of its key; an accepted one closes the
    interval that was open. Of incoming rows of one key and date the first by all columns is written.
    """
    latest = stored.groupBy(*on).agg(F.max(since).alias("latest_"))
    once = incoming.withColumn("rn_", F.row_number().over(Window.partitionBy(*on, since).orderBy(*(c for c in incoming.columns if c not in (*on, since))))).where("rn_ = 1").drop("rn_")
    judged = once.join(latest, list(on), "left").withColumn("refused", F.coalesce(F.col(since) <= F.col("latest_"), F.lit(False))).drop("latest_")
    every = stored.withColumn("refused", F.lit(False)).unionByName(judged)
    ahead = F.lead(since).over(Window.partitionBy(*on, "refused").orderBy(since))
    return every.withColumn("effective_to", F.when(~F.col("refused"), ahead))


def in_force(versions: DataFrame, at: Column, on: Sequence[str], since: str = "effective_date") -> DataFrame:
    """The version of each key in force at ``at``: the latest that took effect by then, unless it has ended before."""
    rows = versions.where((F.col(since) <= at) & (F.col("effective_to").isNull() | (F.col("effective_to") > at)))
    return rows.groupBy(*on).agg(F.max_by(F.struct(*(c for c in versions.columns if c not in on)), since).alias("v")).select(*on, "v.*")


def decision_records(recordings: DataFrame, sessions: DataFrame) -> DataFrame:
    """Why each recording belongs to its session: ``opened``, ``fingerprint`` or ``window``, with the closeness in time.

    ``sessions(id, session_id)`` names the recording that opened the session.
    """
    named = recordings.join(sessions, "id")
    opener = recordings.select(F.col("id").alias("session_id"), F.struct("start", "fingerprint").alias("o"))
    joined = named.join(opener, "session_id")
    apart = F.abs(F.unix_timestamp("start") - F.unix_timestamp("o.start"))
    same_print = F.coalesce(F.col("fingerprint") == F.col("o.fingerprint"), F.lit(False))
    rule = F.when(F.col("id") == F.col("session_id"), "opened").when(same_print, "fingerprint").otherwise("window")
    score = F.when(rule == "fingerprint", 1.0).otherwise(F.greatest(F.lit(0.0), 1 - apart / C.MATCH_WINDOW_S))
    return joined.select("id", "session_id", rule.alias("rule"), score.alias("score"))
