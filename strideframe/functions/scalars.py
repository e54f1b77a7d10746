"""Scalar rules of ingestion and display, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from strideframe.functions import constants as C

#: Sport words of sources and the sport codes they stand for; any other word is ``other``.
SPORTS = {"cycling": "cycling", "ride": "cycling", "virtualride": "cycling", "biking": "cycling", "run": "running", "running": "running", "swim": "swimming", "swimming": "swimming", "rowing": "rowing", "weighttraining": "strength", "strength": "strength"}


def sport_code(word: Column) -> Column:
    folded = F.lower(F.trim(word))
    out = F.lit("other")
    for name, code in SPORTS.items():
        out = F.when(folded == name, code).otherwise(out)
    return out


def finite_or_null(x: Column) -> Column:
    """A number from text or number; anything else, NaN and infinities are null."""
    v = x.try_cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v)


def rpe(value: Column, percent: Column) -> Column:
    """Perceived exertion on 0..10. On the percent scale 0 is 0, 10..100 is a tenth, what lies between and above is nothing."""
    on_ten = F.when(value.between(0, 10), value)
    on_hundred = F.when(value == 0, F.lit(0.0)).when(value.between(10, 100), value / 10)
    return F.when(percent, on_hundred).otherwise(on_ten)


def feel(value: Column) -> Column:
    return F.when((value == F.floor(value)) & value.between(1, 5), value.cast("int"))


def content_hash(*columns: str) -> Column:
    """sha256 of the canonical JSON of the columns, in order of their names."""
    return F.sha2(F.to_json(F.struct(*(F.col(c) for c in sorted(columns)))), 256)


def versioned_id(native: Column, digest: Column) -> Column:
    """The id of a superseded version: the base id and sixteen digits of its hash."""
    return F.concat(F.element_at(F.split(native, "#superseded:"), 1), F.lit("#superseded:"), F.substring(digest, 1, 16))


def day_label(day: Column) -> Column:
    return F.date_format(day, "MMM d")


def duration_label(seconds: Column) -> Column:
    whole = (seconds % 60 == 0) & (seconds > 0)
    return F.when(whole, F.concat((seconds / 60).cast("long").cast("string"), F.lit(" min"))).otherwise(F.concat(seconds.cast("string"), F.lit(" sec")))


def trend_word(first: Column, last: Column, least: float = 0.05) -> Column:
    change = last - first
    return F.when(F.abs(change) < least, "steady").when(change > 0, "rising").otherwise("falling")


def coverage_state(reason: Column) -> Column:
    """``present`` for a computed metric; ``absent_failed`` where computing failed, ``absent_true`` where there was nothing."""
    return F.when(reason.isNull(), "present").when(reason.isin("missing_dependency", "poor_fit", "out_of_domain"), "absent_failed").otherwise("absent_true")


def step_target(percent: Column, base: Column) -> Column:
    """An absolute target from a share of a base; null where the base is unknown."""
    return percent * base / 100


def backoff(attempt: Column, base: float, most: float) -> Column:
    return F.least(F.lit(base) * F.pow(F.lit(2.0), attempt), F.lit(most))


def closeness(distance_s: Column) -> Column:
    """1 at the same instant, 0 from the edge of the matching window on."""
    return F.greatest(F.lit(0.0), 1 - F.abs(distance_s) / C.MATCH_WINDOW_S)


def tenths(x: Column) -> Column:
    """The whole number nearest to ten times a double, exactly: half to even where ten times its binary value is a half.

    The product in doubles is corrected by what it leaves out, from the halves of x, so that 0.15, which lies below its
    name, gives 1. For numbers under 2 ** 59.
    """
    p = x * 10.0
    split = x * 134217729.0
    high = split - (split - x)
    rest = (high * 10.0 - p) + (x - high) * 10.0
    half = F.abs(p - F.floor(p)) == 0.5
    towards = F.when(rest > 0, F.ceil(p)).when(rest < 0, F.floor(p)).otherwise(F.rint(p))
    return F.when(half, towards.cast("long")).otherwise(F.rint(p).cast("long") + F.rint(rest).cast("long"))


def display(x: Column) -> Column:
    """One decimal, rounded half to even from the double's exact value; whole numbers without it, and without an exponent.
    Null for what is no finite number."""
    k = tenths(x)
    digits = F.abs(k)
    small = F.concat(F.when(k < 0, "-").otherwise(""), F.call_function("div", digits, F.lit(10)).cast("string"), F.when(digits % 10 > 0, F.concat(F.lit("."), (digits % 10).cast("string"))).otherwise(""))
    # Doubles from 2 ** 53 on are whole.
    large = F.when(F.abs(x) < 2.0**63, x.cast("long").cast("string")).otherwise(F.format_string("%.0f", x))
    return F.when(F.abs(x) < 2.0**53, small).when(F.abs(x) < float("inf"), large)


def policy_version(policy: Column) -> Column:
    """The version of a policy given as a struct with its fields in order: ``v1:`` and sixteen digits of its hash."""
    return F.concat(F.lit("v1:"), F.substring(F.sha2(F.to_json(policy), 256), 1, 16))


def wall_clock(instant: Column, zone: Column) -> Column:
    """What the clock on the wall of a zone shows at an instant, as text without a zone."""
    return F.date_format(F.from_utc_timestamp(instant, zone), "yyyy-MM-dd'T'HH:mm:ss")


def job_id(native_id: Column) -> Column:
    """The id of the job of a native id in the form of a UUID; the same id always gives the same job."""
    h = F.sha2(native_id, 256)
    parts = [(1, 8), (9, 4), (14, 3), (18, 3), (21, 12)]
    cut = [F.substring(h, at, n) for at, n in parts]
    return F.concat(cut[0], F.lit("-"), cut[1], F.lit("-5"), cut[2], F.lit("-8"), cut[3], F.lit("-"), cut[4])


def base_axis(base: str, index: Column, distance: Column) -> Column:
    """A sample's place on a chart: its distance where that is asked for and known, else its number of seconds."""
    return F.coalesce(distance, index.cast("double")) if base == "distance" else index.cast("double")
