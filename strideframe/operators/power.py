"""Power metrics of 1 Hz streams ``(key, t, power)``, all keys at once."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strideframe.functions import constants as C
from strideframe.functions.result import computed, finite, ladder, ratio
from strideframe.operators.series import seeded_mean


def normalized_power(stream: DataFrame, window: int = C.NP_WINDOW_S, sport: str | None = None) -> DataFrame:
    """One row per key: np_w, avg_power_w, duration_s (valid seconds), window_s (seeded seconds), reason.

    The fourth root of the mean fourth power of the seeded trailing mean. Needs one run of valid samples as long as the
    window. ``sport`` names a column for the sport gate.
    """
    gate = [(~F.col(sport).isin(*C.POWER_SPORTS), "not_applicable_for_sport")] if sport else []
    smooth = seeded_mean(stream, "power", window, "r")
    sums = [F.count("power").alias("duration_s"), F.count("r").alias("window_s"), F.count(F.lit(1)).alias("samples"), F.avg("power").alias("avg_all"), F.pow(F.avg(F.pow("r", F.lit(4.0))), F.lit(0.25)).alias("raw")]
    per_key = smooth.groupBy("key", *([sport] if sport else [])).agg(*sums)
    why = ladder([*gate, (F.col("duration_s") == 0, "missing_required_input"), (F.col("window_s") == 0, "insufficient_data"), (~finite(F.col("raw")), "out_of_domain")])
    per_key = per_key.withColumn("reason", why)
    live = F.col("reason").isNull()
    return per_key.select(
        "key", computed(F.col("raw"), F.col("reason")).alias("np_w"), F.when(live, F.col("avg_all")).alias("avg_power_w"), "duration_s", "window_s", "reason",
        (F.col("duration_s") / F.col("samples")).alias("coverage_fraction"), (F.col("samples") - F.col("duration_s")).alias("gap_count"),
    )


def intensity_class(factor: Column) -> Column:
    """The band of an intensity factor; a factor on a cut belongs to the band above."""
    out = F.lit(C.INTENSITY_NAMES[0])
    for cut, name in zip(C.INTENSITY_CUTS, C.INTENSITY_NAMES[1:]):
        out = F.when(factor >= cut, name).otherwise(out)
    return F.when(factor.isNotNull(), out)


def load_bundle(powers: DataFrame) -> DataFrame:
    """Adds to ``powers(np_w, duration_s, reason, ftp_w, avg_hr_bpm, avg_power_w)``: if_, tss, tss_per_hour, ef, vi, class.

    A missing threshold or average is missing input, one that isn't positive is out of domain; both only stop the metrics
    that need it. Each metric has a ``*_reason``.
    """
    why = F.col("reason")
    needs = lambda c: [(why.isNotNull(), None), (F.col(c).isNull(), "missing_required_input"), (~finite(F.col(c)) | (F.col(c) <= 0), "out_of_domain")]

    def reason(column: str) -> Column:
        return F.coalesce(why, ladder(needs(column)[1:]))

    out = powers.withColumn("if_reason", reason("ftp_w"))
    out = out.withColumn("if_", computed(ratio(F.col("np_w"), F.col("ftp_w")), F.col("if_reason")))
    out = out.withColumn("tss_reason", F.coalesce("if_reason", ladder([(F.col("duration_s") <= 0, "out_of_domain")])))
    out = out.withColumn("tss", computed(ratio(F.col("duration_s") * F.col("np_w") * F.col("np_w"), F.col("ftp_w") * F.col("ftp_w") * 3600) * 100, F.col("tss_reason")))
    out = out.withColumn("tss_per_hour", ratio(F.col("tss"), F.col("duration_s") / 3600))
    out = out.withColumn("ef_reason", reason("avg_hr_bpm")).withColumn("vi_reason", reason("avg_power_w"))
    out = out.withColumn("ef", computed(ratio(F.col("np_w"), F.col("avg_hr_bpm")), F.col("ef_reason"))).withColumn("vi", computed(ratio(F.col("np_w"), F.col("avg_power_w")), F.col("vi_reason")))
    return out.withColumn("intensity_class", intensity_class(F.col("if_")))


#: Seconds whose windows a task looks at together, besides those that the last windows reach into.
MMP_BLOCK_S = 32_768
#: Up to this duration each window length is looked at; for longer ones a search over slopes is cheaper.
MMP_DIRECT_S = 8

Window_ = tuple[float, int, int]  # mean, length, start


def _shorter(a: Window_ | None, b: Window_ | None) -> Window_ | None:
    """The better of two windows: by mean, then by length, then by start."""
    return max((w for w in (a, b) if w), key=lambda w: (w[0], -w[1], -w[2]), default=None)


def _best_by_length(total: np.ndarray, d: int, starts: int) -> Window_ | None:
    """The best window of d to 2d - 1 samples of a gap-free run with running sums ``total``."""
    best = None
    for n in range(d, min(2 * d, len(total))):
        means = (total[n:] - total[:-n])[:starts] / n
        if len(means):
            at = int(means.argmax())
            best = _shorter(best, (float(means[at]), n, at))
    return best


def _best_by_slope(total: np.ndarray, d: int, starts: int, least: float) -> Window_ | None:
    """The best window of at least d samples, if its mean is ``least`` or more, in a few passes over the run.

    A window's mean is the slope between two points of the running sum. Against a trial slope the best end for each start
    is found by a running minimum; the slope of the pair that gains most is the next trial, until none gains.
    """
    m = min(len(total) - d, starts)
    if m <= 0:
        return None
    places = np.arange(len(total))
    slope = max(float((total[d : d + m] - total[:m]).max()) / d, least)
    noise = 16 * np.finfo(float).eps * max(1.0, float(np.abs(total).max()), abs(slope) * len(total))
    while True:
        q = total - slope * places
        low = np.minimum.accumulate(q[:m])
        gain = q[d:] - np.pad(low, (0, len(q) - d - m), mode="edge")
        end = int(gain.argmax())
        start = int(q[: min(end, m - 1) + 1].argmin())
        steeper = float(total[end + d] - total[start]) / (end + d - start)
        if gain[end] <= noise or steeper <= slope:
            break
        slope = steeper
    ends = np.nonzero(gain >= -noise)[0]
    # The last start that is as low as any before it is the one of the shortest window.
    last = np.maximum.accumulate(np.where(q[:m] <= low + noise, np.arange(m), -1))
    start, end = last[np.minimum(ends, m - 1)], ends + d
    if len(short := np.nonzero(end - start < 2 * d)[0]):
        start, end = start[short], end[short]
    means = (total[end] - total[start]) / (end - start)
    if not len(means) or means.max() < least:
        return None
    at = min(np.nonzero(means == means.max())[0].tolist(), key=lambda k: (end[k] - start[k], start[k]))
    return float(means[at]), int(end[at] - start[at]), int(start[at])


def best_windows(values: np.ndarray, durations: Sequence[int], starts: int) -> dict[int, Window_]:
    """For each duration the best gap-free window of at least that many values that starts before ``starts``; NaN is a gap."""
    ok = np.r_[False, ~np.isnan(values), False]
    opens, closes = np.nonzero(ok[1:] & ~ok[:-1])[0], np.nonzero(ok[:-1] & ~ok[1:])[0]
    sums = [np.r_[0, np.cumsum(values[a:b])] for a, b in zip(opens, closes)]
    found = {}
    for d in durations:
        best = None
        for at, total in zip(opens.tolist(), sums):
            if len(total) > d and at < starts:
                own = _best_by_length(total, d, starts - at) if d <= MMP_DIRECT_S else _best_by_slope(total, d, starts - at, best[0] if best else -np.inf)
                best = _shorter(best, own and (own[0], own[1], own[2] + at))
        if best:
            found[d] = best
    return found


def mean_maximal_power(stream: DataFrame, durations: Sequence[int] = C.MMP_GRID_S) -> DataFrame:
    """``(key, duration_s, best_w, window_s, start_t)``: the best mean over any gap-free window of at least a duration.

    A window of twice the duration or more splits into two, one of which is as good, so that no longer ones are needed.
    Ties go to the shortest, then the earliest window. A key's seconds are cut into blocks, which a task works together
    with the seconds that their last windows reach into; the blocks' bests then meet. Durations that no gap-free window
    reaches have no row.
    """
    lengths = sorted(set(durations))
    reach = 2 * lengths[-1]
    size = max(MMP_BLOCK_S, 4 * lengths[-1])
    own = F.floor(F.col("t") / size)
    before = F.when(F.col("t") - own * size < reach, own - 1)
    blocks = stream.select("key", "t", "power", F.explode(F.array_compact(F.array(own, before))).alias("block"))

    def curve(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        t, v = pdf["t"].to_numpy(), pdf["power"].to_numpy(float)
        if (t[1:] < t[:-1]).any():
            order = t.argsort(kind="stable")
            t, v = t[order], v[order]
        starts = int(np.searchsorted(t, (key[1] + 1) * size))
        rows = [(key[0], d, mean, n, int(t[at])) for d, (mean, n, at) in best_windows(v, lengths, starts).items()]
        return pd.DataFrame(rows, columns=["key", "duration_s", "best_w", "window_s", "start_t"])

    kind = dict(stream.dtypes)["key"]
    found = blocks.groupBy("key", "block").applyInPandas(curve, f"key {kind}, duration_s long, best_w double, window_s long, start_t long")
    rank = F.struct("best_w", -F.col("window_s"), -F.col("start_t"))
    best = found.groupBy("key", "duration_s").agg(F.max_by(F.struct("best_w", "window_s", "start_t"), rank).alias("b"))
    return best.select("key", "duration_s", "b.*")


def power_curve(curves: DataFrame, activities: DataFrame) -> DataFrame:
    """The best of several activities' curves for each athlete and duration, with the activity it comes from; among equal
    bests the activity that starts first, then the one of the smaller id, wins."""
    joined = curves.join(activities.select(F.col("activity_id").alias("key"), "athlete", "start"), "key")
    first = F.struct(F.col("best_w"), -F.unix_micros("start"), -F.col("key"))
    best = joined.groupBy("athlete", "duration_s").agg(F.max_by(F.struct("best_w", "key", "start"), first).alias("b"))
    return best.select("athlete", "duration_s", F.col("b.best_w").alias("best_w"), F.col("b.key").alias("activity_id"), F.to_date("b.start").alias("on_date"))


def critical_power(points: DataFrame, domain: tuple[int, int] = C.CP_DOMAIN_S, least_points: int = C.CP_LEAST_POINTS, least_ratio: float = C.CP_LEAST_RATIO, least_r2: float = C.CP_LEAST_R2, bias_s: int | None = None) -> DataFrame:
    """One row per key of ``points(key, duration_s, best_w)``: cp_w, w_prime_j, r2, se_cp, se_w_prime, n, reason.

    The line of work over time through the curve's points inside the domain: slope is critical power, intercept the work
    above it. Standard errors come from the residuals themselves. A key has no more points than the curve has durations, so
    they are folded from an array in the same pass. With ``bias_s``, ``long_bias`` tells whether a fit leans on a duration
    beyond it, at which the model gives too much; null without a fit.
    """
    inside = F.col("duration_s").between(*domain) & finite(F.col("best_w"))
    x, w, p = F.when(inside, F.col("duration_s").cast("double")), F.when(inside, F.col("best_w") * F.col("duration_s")), F.when(inside, F.col("best_w"))
    every = points.groupBy("key").agg(
        F.count(x).alias("n"), F.max(x).alias("x_max"), F.min(x).alias("x_min"), F.max(p).alias("p_max"), F.min(p).alias("p_min"), F.regr_slope(w, x).alias("cp"), F.regr_intercept(w, x).alias("wp"),
        F.regr_r2(w, x).alias("r2"), F.regr_sxx(w, x).alias("sxx"), F.regr_syy(w, x).alias("syy"), F.avg(x).alias("x_mean"), F.array_sort(F.collect_list(F.when(inside, F.struct(x.alias("x"), w.alias("w"))))).alias("pts"),
    )
    every = every.withColumn("ssr", F.aggregate("pts", F.lit(0.0), lambda sum_, q: sum_ + F.pow(q["w"] - F.col("cp") * q["x"] - F.col("wp"), F.lit(2.0))))
    n = F.coalesce("n", F.lit(0))
    spread = ratio(F.col("p_max") - F.col("p_min"), F.col("p_max"))
    why = ladder(
        [
            (n < least_points, "insufficient_data"), (ratio(F.col("x_max"), F.col("x_min")) < least_ratio, "insufficient_data"), (spread < C.CP_LEAST_SPREAD, "insufficient_data"), (F.col("syy") <= 0, "poor_fit"),
            (~finite(F.col("cp")) | ~finite(F.col("wp")), "out_of_domain"), (F.col("r2") < least_r2, "poor_fit"), ((F.col("cp") <= 0) | (F.col("wp") <= 0), "poor_fit"),
        ]
    )
    every = every.withColumn("reason", why)
    s2 = ratio(F.col("ssr"), F.col("n") - 2)
    error = lambda x: F.when(F.col("reason").isNull(), F.when(F.col("n") <= 2, 0.0).otherwise(F.sqrt(x)))
    return every.select(
        "key", computed(F.col("cp"), F.col("reason")).alias("cp_w"), computed(F.col("wp"), F.col("reason")).alias("w_prime_j"), computed(F.col("r2"), F.col("reason")).alias("r2"),
        error(ratio(s2, F.col("sxx"))).alias("se_cp"), error(s2 * (ratio(F.lit(1.0), F.col("n")) + ratio(F.col("x_mean") * F.col("x_mean"), F.col("sxx")))).alias("se_w_prime"), n.alias("n"), "reason",
        *([] if bias_s is None else [F.when(F.col("reason").isNull(), F.col("x_max") > bias_s).alias("long_bias")]),
    )


#: Seconds to a block of the recovery sums: exp(50,000 / 316) is far from overflow.
WBAL_BLOCK_S = 50_000


def w_balance(stream: DataFrame, cp: float | Column, w_prime: float | Column, floor: bool = False) -> DataFrame:
    """``(key, t, w_bal_j)`` for each second, the first included; null where cp or w_prime is null, not finite or not positive.

    What is spent above critical power adds to the deficit, what lies below shrinks it by exp(-1/tau), a gap carries it
    on. The deficit never falls below zero, so it is one running sum under another: with S the running sum of 1/tau over
    recovering seconds, D(t) = exp(-S(t)) * sum of spent(k) * exp(S(k)). S grows by at most 1/316 a second and starts
    anew in each block of WBAL_BLOCK_S seconds; a block takes over the deficit at the end of the blocks before it.
    """
    a, b, c = C.WBAL_TAU
    as_column = lambda x: x if isinstance(x, Column) else F.lit(x).cast("double")
    cp, w_prime = as_column(cp), as_column(w_prime)
    usable = F.coalesce(finite(cp) & (cp > 0) & finite(w_prime) & (w_prime > 0), F.lit(False))
    p = F.col("power")
    rows = stream.select("key", "t", p, cp.alias("cp_"), F.when(usable, w_prime).alias("w_prime_"), F.floor(F.col("t") / WBAL_BLOCK_S).alias("block"))
    cp = F.col("cp_")
    so_far = Window.partitionBy("key", "block").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    slow = F.when(p < cp, 1 / (a * F.exp(b * (cp - p)) + c)).otherwise(0.0)
    rows = rows.withColumn("s", F.sum(slow).over(so_far)).withColumn("spent", F.when(p >= cp, p - cp).otherwise(0.0))
    rows = rows.withColumn("own", F.exp(-F.col("s")) * F.sum(F.col("spent") * F.exp("s")).over(so_far))
    ends = rows.groupBy("key", "block").agg(F.max("s").alias("s"), F.max_by("own", "t").alias("own"))
    # One entry for each earlier block of the key.
    earlier = Window.partitionBy("key").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = F.collect_list(F.struct("own", "s")).over(earlier)
    carried = ends.select("key", "block", F.aggregate(before, F.lit(0.0), lambda d, x: d * F.exp(-x["s"]) + x["own"]).alias("carried"))
    deficit = F.col("own") + F.exp(-F.col("s")) * F.col("carried")
    balance = F.col("w_prime_") - deficit
    return rows.join(carried, ["key", "block"]).select("key", "t", (F.greatest(balance, F.lit(0.0)) if floor else balance).alias("w_bal_j"))


def w_balance_summary(stream: DataFrame, settings: DataFrame, floor: bool = False) -> DataFrame:
    """One row per key: start_j, end_j, least_j of the balance, valid_s, gap_s, reason.

    ``settings(key, sport, cp_w, w_prime_j)`` has a row for each key. Gates in order: sport, no power, a missing setting,
    a setting that isn't finite and positive.
    """
    with_cp = stream.join(settings, "key")
    balance = w_balance(with_cp, F.col("cp_w"), F.col("w_prime_j"), floor)
    ends = balance.groupBy("key").agg(F.min_by("w_bal_j", "t").alias("start_j"), F.max_by("w_bal_j", "t").alias("end_j"), F.min("w_bal_j").alias("least_j"))
    counts = stream.groupBy("key").agg(F.count("power").alias("valid_s"), F.count_if(F.col("power").isNull()).alias("gap_s"))
    rows = settings.join(counts, "key", "left").join(ends, "key", "left")
    positive = lambda c: finite(F.col(c)) & (F.col(c) > 0)
    why = ladder(
        [
            (~F.col("sport").isin(*C.POWER_SPORTS), "not_applicable_for_sport"),
            (F.coalesce("valid_s", F.lit(0)) == 0, "missing_required_input"),
            (F.col("cp_w").isNull() | F.col("w_prime_j").isNull(), "missing_required_input"),
            (~positive("cp_w") | ~positive("w_prime_j"), "out_of_domain"),
        ]
    )
    live = why.isNull()
    values = [F.when(live, F.col(c)).alias(c) for c in ("start_j", "end_j", "least_j")]
    return rows.select("key", *values, *(F.coalesce(c, F.lit(0)).alias(c) for c in ("valid_s", "gap_s")), why.alias("reason"))


def best_efforts(stream: DataFrame, curve: DataFrame, sports: DataFrame, durations: Sequence[int] = C.MMP_GRID_S) -> DataFrame:
    """A row for each key of ``sports(key, sport)`` and each duration: best_w, or the reason why there is none.

    ``curve`` is the keys' mean-maximal power. A sport without power comes first, then a recording without samples; a
    duration that no gap-free window reaches is insufficient data.
    """
    samples = stream.groupBy("key").agg(F.count(F.lit(1)).alias("samples"))
    grid = sports.join(samples, "key", "left").withColumn("duration_s", F.explode(F.array(*(F.lit(d).cast("long") for d in sorted(set(durations))))))
    rows = grid.join(curve.select("key", "duration_s", "best_w"), ["key", "duration_s"], "left")
    why = ladder(
        [
            (~F.col("sport").isin(*C.POWER_SPORTS), "not_applicable_for_sport"),
            (F.coalesce("samples", F.lit(0)) == 0, "missing_required_input"),
            (F.col("best_w").isNull(), "insufficient_data"),
        ]
    )
    return rows.select("key", "duration_s", F.when(why.isNull(), F.col("best_w")).alias("best_w"), why.alias("reason"))


def gated(metric: DataFrame, sports: DataFrame, applicable: Sequence[str] = C.POWER_SPORTS) -> DataFrame:
    """``metric(key, ..., reason)`` with every value taken from keys whose sport the metric isn't defined for.

    The gate stands before all others: such a key has the sport's reason, whatever its data.
    """
    outside = F.coalesce(~F.col("sport").isin(*applicable), F.lit(False))
    values = [F.when(~outside, F.col(c)).alias(c) for c in metric.columns if c not in ("key", "reason")]
    why = F.when(outside, "not_applicable_for_sport").otherwise(F.col("reason"))
    return metric.join(sports.select("key", "sport"), "key", "left").select("key", *values, why.alias("reason"))


def work_above(stream: DataFrame, cp: float) -> DataFrame:
    """``(key, t, power, work_j)``: the running work above critical power; gaps add nothing."""
    so_far = Window.partitionBy("key").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    return stream.withColumn("work_j", F.sum(F.greatest(F.lit(0.0), F.coalesce(F.col("power"), F.lit(cp)) - cp)).over(so_far))


def durability(stream: DataFrame, cp: float, w_prime: float, target: int = C.DURABILITY_TARGET_S, multiple: float = C.DURABILITY_MULTIPLE) -> DataFrame:
    """One row per key: fresh_w, fatigued_w, decrement_pct, split_t, reason.

    The stream is split at the first second at which the work above critical power reaches ``multiple * w_prime``. The
    best seeded mean of ``target`` seconds is taken on either side; no window crosses the split.
    """
    worked = work_above(stream, cp)
    tired = F.col("work_j") >= multiple * w_prime
    # The running work never falls, so a side is told without joining the split back.
    sides = seeded_mean(worked.withColumn("side", tired), "power", target, "m", ("key", "side"))
    rows = sides.groupBy("key").agg(
        F.min(F.when(F.col("side"), F.col("t"))).alias("split_t"), F.count("power").alias("valid"), F.max(F.when(~F.col("side"), F.col("m"))).alias("fresh"), F.max(F.when(F.col("side"), F.col("m"))).alias("fatigued")
    )
    why = ladder(
        [
            (F.lit(w_prime <= 0), "out_of_domain"), (F.col("valid") == 0, "missing_required_input"), (F.lit(cp <= 0), "out_of_domain"), (F.col("split_t").isNull(), "insufficient_data"),
            (F.col("fresh").isNull() | F.col("fatigued").isNull(), "insufficient_data"), (F.col("fresh") <= 0, "out_of_domain"),
        ]
    )
    rows = rows.withColumn("reason", why)
    live = F.col("reason").isNull()
    return rows.select("key", F.when(live, F.col("fresh")).alias("fresh_w"), F.when(live, F.col("fatigued")).alias("fatigued_w"), F.when(live, 100 * (1 - ratio(F.col("fatigued"), F.col("fresh")))).alias("decrement_pct"), "split_t", "reason")


def endurance_score(parts: DataFrame) -> DataFrame:
    """Score of ``parts(key, ctl, shape_ratio, decoupling_pct)``: weighted means of the components present; fitness is
    required. A drift below 0 is as good as none. Confidence is 0.7 where a component is missing."""
    clamp = lambda x: F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))
    low, high = C.ENDURANCE_SHAPE
    comps = [clamp(F.col("ctl") / C.ENDURANCE_FULL_CTL), clamp((F.col("shape_ratio") - low) / (high - low)), clamp(1 - F.col("decoupling_pct") / C.ENDURANCE_FULL_DRIFT)]
    present = [F.when(finite(F.col(c)), 1.0).otherwise(0.0) for c in ("ctl", "shape_ratio", "decoupling_pct")]
    weight = sum((F.lit(w) * p for w, p in zip(C.ENDURANCE_WEIGHTS, present)), F.lit(0.0))
    total = sum((F.lit(w) * F.when(p > 0, x).otherwise(0.0) for w, p, x in zip(C.ENDURANCE_WEIGHTS, present, comps)), F.lit(0.0))
    why = ladder([(~finite(F.col("ctl")), "missing_required_input"), (F.col("ctl").isNull(), "missing_required_input"), (weight <= 0, "out_of_domain")])
    whole = present[0] + present[1] + present[2] == 3
    return parts.select("key", why.alias("reason"), F.when(why.isNull(), 100 * ratio(total, weight)).alias("score"), F.when(why.isNull(), F.when(whole, 1.0).otherwise(0.7)).alias("confidence"))
