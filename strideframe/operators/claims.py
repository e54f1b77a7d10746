"""Claims in texts: which metric a label means, which value it should have, what a sentence says of it."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strideframe.functions import constants as C
from strideframe.operators.text import NEGATION_REACH

ISO_DATE = r"\d{4}-\d{2}-\d{2}"
LOOKBACK_DAYS = 42
FRESH_DAYS = 1


def folded(label: Column) -> Column:
    """Lower case, with single blanks and none at the ends."""
    return F.trim(F.lower(F.regexp_replace(label, r"\s+", " ")))


def metric_key(label: Column, names: Sequence[str], aliases: Mapping[str, str]) -> Column:
    """The metric that a label means, null for none: by the whole label, by what stands before a gloss in brackets, or by the
    gloss itself. ``aliases`` are other words for ``names``; one for an unknown name counts for nothing."""
    known = {n: n for n in names} | {" ".join(a.lower().split()): n for a, n in aliases.items() if n in names}
    table = F.create_map(*(F.lit(x) for pair in known.items() for x in pair))
    whole = folded(label)
    head, gloss = F.trim(F.substring_index(whole, "(", 1)), F.trim(F.regexp_extract(whole, r"\(([^)]*)", 1))
    return F.coalesce(F.element_at(table, whole), F.element_at(table, head), F.element_at(table, gloss))


def canonical_values(claims: DataFrame, values: DataFrame, on: Sequence[str], reference: Column, lookback: int = LOOKBACK_DAYS) -> DataFrame:
    """``claims`` with ``canonical``: the value of the claim's metric on the day that its ``as_of`` names.

    Without a day the latest value of the last ``lookback`` days counts; an ``as_of`` that is no date reads nothing, so
    that a claim about an unreadable day is never held against today's value. ``values(*on, metric, day, value)``.
    """
    day = F.trim("as_of").try_cast("date")
    absent = F.coalesce(F.trim("as_of"), F.lit("")) == ""
    dated = values.select(*on, "metric", F.col("day").alias("day_"), F.col("value").alias("on_day_"))
    recent = values.where(F.col("value").isNotNull() & F.col("day").between(F.date_sub(reference, lookback), reference))
    latest = recent.groupBy(*on, "metric").agg(F.max_by("value", "day").alias("latest_"))
    strict = F.when(F.trim("as_of").rlike(f"^{ISO_DATE}$"), day)
    rows = claims.withColumn("day_", strict).join(dated, [*on, "metric", "day_"], "left").join(latest, [*on, "metric"], "left")
    return rows.withColumn("canonical", F.when(absent, F.col("latest_")).otherwise(F.col("on_day_"))).drop("day_", "on_day_", "latest_")


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}]+"), lambda w: w != "")


def _tokens(words: Column, groups: Sequence[Sequence[str]]) -> Column:
    """The group's first word in place of each word that belongs to one, null for the others."""
    table = F.create_map(*(F.lit(x) for group in groups for word in group for x in (word, group[0])))
    return F.transform(words, lambda w: F.element_at(table, w))


def named_activities(text: Column, groups: Sequence[Sequence[str]] = C.ACTIVITY_WORDS) -> Column:
    """The activities that a text names, once each and in order."""
    return F.array_sort(F.array_distinct(F.array_compact(_tokens(_words(text), groups))))


def forbidden_activities(text: Column, negations: Sequence[str], groups: Sequence[Sequence[str]] = C.ACTIVITY_WORDS) -> Column:
    """The activities that a constraint forbids: those named within four words of a word of negation."""
    words = _words(text)
    negative = F.transform(words, lambda w: w.isin(*negations))
    near = lambda i: F.exists(F.slice(negative, F.greatest(i + 1 - NEGATION_REACH, F.lit(1)), 2 * NEGATION_REACH + 1 - F.greatest(NEGATION_REACH - i, F.lit(0))), lambda x: x)
    marked = F.transform(_tokens(words, groups), lambda t, i: F.when(near(i), t))
    return F.array_sort(F.array_distinct(F.array_compact(marked)))


def conflicts(prescriptions: DataFrame, constraints: DataFrame, on: Sequence[str], negations: Sequence[str], groups: Sequence[Sequence[str]] = C.ACTIVITY_WORDS) -> DataFrame:
    """Sentences that prescribe what one of the owner's constraints forbids: ``(*on, sentence_id, action, activities)``.

    A hard constraint removes the sentence, a soft one adds a caution. ``prescriptions(*on, sentence_id, sentence)``,
    ``constraints(*on, content, severity)``.
    """
    forbids = constraints.select(*on, F.explode(forbidden_activities(F.col("content"), negations, groups)).alias("activity"), (F.col("severity") == "hard").alias("hard")).groupBy(*on, "activity").agg(F.bool_or("hard").alias("hard"))
    says = prescriptions.select(*on, "sentence_id", F.explode(named_activities(F.col("sentence"), groups)).alias("activity"))
    met = says.join(forbids, [*on, "activity"])
    # As many activities as there are groups of words.
    out = met.groupBy(*on, "sentence_id").agg(F.bool_or("hard").alias("hard"), F.array_sort(F.collect_set("activity")).alias("activities"))
    return out.select(*on, "sentence_id", F.when(F.col("hard"), "remove").otherwise("caution").alias("action"), "activities")


def binding_violation(sentence: Column, metric: Column, as_of: Column, labels: Mapping[str, str], reference: Column, present_words: Sequence[str], fresh_days: int = FRESH_DAYS) -> Column:
    """How a claim departs from the sentence that it stands in, null where it doesn't.

    ``metric_mismatch``: the sentence names metrics (``labels``: word -> metric), but not the claim's. ``stale_as_of``: the
    claim is of a day long past, while the sentence has no date and speaks of the present.
    """
    said = F.concat(F.lit(" "), F.array_join(_words(sentence), " "), F.lit(" "))
    named = F.array_compact(F.array(*(F.when(F.contains(said, F.lit(f" {word} ")), F.lit(name)) for word, name in labels.items())))
    other = (F.size(named) > 0) & metric.isNotNull() & ~F.array_contains(named, metric)
    past = F.when(as_of.rlike(f"^{ISO_DATE}$"), as_of.try_cast("date")) < F.date_sub(reference, fresh_days)
    now = F.exists(F.array(*(F.lit(w) for w in present_words)), lambda w: F.contains(said, F.concat(F.lit(" "), w, F.lit(" "))))
    return F.when(F.coalesce(other, F.lit(False)), "metric_mismatch").when(F.coalesce(past & now & ~sentence.rlike(ISO_DATE), F.lit(False)), "stale_as_of")


def fact_sheet(days: DataFrame, most: int = 7) -> DataFrame:
    """``(key, sheet)``: current fitness, fatigue and form of ``days(key, day, ctl, atl, tsb)`` with their trend since the first
    known day, and a line for each of the last ``most`` days, the oldest first."""
    known = days.where(F.col("ctl").isNotNull())
    names = (("fitness", "ctl"), ("fatigue", "atl"), ("form", "tsb"))
    values = F.struct("ctl", "atl", "tsb")
    ends = known.groupBy("key").agg(F.min_by(values, "day").alias("first"), F.max_by(values, "day").alias("last"))
    back = (F.row_number().over(Window.partitionBy("key").orderBy(F.desc("day"))) - 1).alias("back")
    recent = known.select("key", back, "ctl", "atl", "tsb").where(F.col("back") < most)
    label = F.when(F.col("back") == 0, "latest").otherwise(F.concat(F.col("back").cast("string"), F.lit(" day(s) earlier")))
    line = F.concat(F.lit("  "), label, F.format_string(": fitness %.1f, fatigue %.1f, form %.1f", "ctl", "atl", "tsb"))
    tail = recent.groupBy("key").agg(F.array_sort(F.collect_list(F.struct((-F.col("back")).alias("at"), line.alias("line")))).alias("lines"))
    trend = lambda c: F.when(F.abs(F.col(f"last.{c}") - F.col(f"first.{c}")) < 0.05, "steady").when(F.col(f"last.{c}") > F.col(f"first.{c}"), "rising").otherwise("falling")
    lead = F.concat_ws("; ", *(F.concat(F.lit(f"current {name} ({c}) "), F.format_string("%.1f", F.col(f"last.{c}")), F.lit(" ("), trend(c), F.lit(")")) for name, c in names))
    sheet = F.concat(lead, F.lit("\nrecent days (most recent last):\n"), F.array_join(F.transform("lines", lambda x: x["line"]), "\n"))
    return ends.join(tail, "key").select("key", sheet.alias("sheet"))
