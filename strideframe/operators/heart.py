"""Heart-rate metrics: training impulse, variability, decoupling, perceived exertion."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strideframe.functions import constants as C
from strideframe.functions.result import finite, ladder, ratio


def banister_load(stream: DataFrame, rest: float | None, most: float | None, sex: str | None = None) -> DataFrame:
    """One row per key of ``(key, t, hr)``: trimp, clamped_fraction, confidence, reason.

    Sum over valid seconds of (1/60) * r * a * exp(b * r), r the heart-rate reserve held to 0..1. Constants by sex; the
    mean of both, with confidence 0.7, where it isn't given.
    """
    a, b = {"male": C.TRIMP_MALE, "m": C.TRIMP_MALE, "female": C.TRIMP_FEMALE, "f": C.TRIMP_FEMALE}.get((sex or "").strip().lower(), C.TRIMP_MEAN)
    raw = ratio(F.col("hr") - F.lit(rest).cast("double"), F.lit(most).cast("double") - F.lit(rest).cast("double"))
    r = F.least(F.greatest(raw, F.lit(0.0)), F.lit(1.0))
    sums = stream.groupBy("key").agg(F.count("hr").alias("valid"), F.sum(r * a * F.exp(b * r) / 60).alias("x"), F.count_if((raw < 0) | (raw > 1)).alias("clamped"))
    missing = rest is None or most is None
    why = ladder([(F.lit(missing), "missing_required_input"), (F.lit(not missing and most <= rest), "out_of_domain"), (F.col("valid") == 0, "insufficient_data")])
    live = why.isNull()
    return sums.select("key", F.when(live, F.col("x")).alias("trimp"), F.when(live, ratio(F.col("clamped"), F.col("valid"))).alias("clamped_fraction"), F.when(live, 1.0 if sex else 0.7).alias("confidence"), why.alias("reason"))


def zonal_load(stream: DataFrame, bounds: Sequence[float], weights: Sequence[float]) -> DataFrame:
    """One row per key: minutes in each zone times its weight; a rate on a bound belongs to the zone above."""
    sound = len(weights) == len(bounds) + 1 and list(bounds) == sorted(set(bounds)) and all(w >= 0 for w in weights)
    weight = F.lit(float(weights[0]) if weights else 0.0)
    for bound, w in zip(bounds, list(weights)[1:]):
        weight = F.when(F.col("hr") >= bound, float(w)).otherwise(weight)
    sums = stream.groupBy("key").agg(F.count("hr").alias("valid"), F.sum(F.when(F.col("hr").isNotNull(), weight) / 60).alias("x"))
    why = ladder([(F.lit(not sound), "out_of_domain"), (F.col("valid") == 0, "insufficient_data")])
    return sums.select("key", F.when(why.isNull(), F.col("x")).alias("zonal"), why.alias("reason"))


def session_load(sessions: DataFrame) -> DataFrame:
    """Adds srpe, foster_au and reason to ``sessions(rpe, moving_s, elapsed_s)``."""
    dur = F.coalesce("moving_s", "elapsed_s")
    why = ladder([(F.col("rpe").isNull() | dur.isNull(), "missing_required_input"), (~F.col("rpe").between(0, 10), "out_of_domain"), (dur <= 0, "out_of_domain")])
    live = why.isNull()
    return sessions.withColumns({"srpe": F.when(live, F.pow(F.col("rpe") / 10, F.lit(2.0)) * (dur / 3600) * 100), "foster_au": F.when(live, F.col("rpe") * dur / 60), "reason": why})


def load_chain(power_tss: Column, hr_load: Column, srpe: Column) -> tuple[Column, Column, Column]:
    """Load, model and whether it is substituted: power, else heart rate, else perceived exertion."""
    model = F.when(power_tss.isNotNull(), "power_tss").when(hr_load.isNotNull(), "hr_trimp").when(srpe.isNotNull(), "srpe_load")
    return F.coalesce(power_tss, hr_load, srpe), model, model.isNotNull() & (model != "power_tss")


def corrected_beats(beats: DataFrame, ectopic: float = C.HRV_ECTOPIC) -> DataFrame:
    """``(key, i, rr, nn, replaced)``: a beat further than ``ectopic`` from the median of the two beats to either side (fewer at
    the ends, itself left out, all uncorrected) is replaced by that median."""
    order = Window.partitionBy("key").orderBy("i")
    near = F.array_sort(F.filter(F.array(*(F.lag("rr", k).over(order) for k in (2, 1)), *(F.lead("rr", k).over(order) for k in (1, 2))), lambda x: x.isNotNull()))
    rows = beats.withColumn("near", near).withColumn("n", F.size("near"))
    low, high = F.expr("try_element_at(near, cast(floor((n + 1) / 2) as int))"), F.expr("try_element_at(near, cast(ceil((n + 1) / 2) as int))")
    rows = rows.withColumn("med", F.when(F.col("n") > 0, (low + high) / 2))
    off = F.coalesce(F.abs(F.col("rr") - F.col("med")) > ectopic * F.col("med"), F.lit(False))
    return rows.select("key", "i", "rr", F.when(off, F.col("med")).otherwise(F.col("rr")).alias("nn"), off.alias("replaced"))


def hrv_time_domain(beats: DataFrame, least_s: float = C.HRV_LEAST_S, most_corrected: float = C.HRV_MOST_CORRECTED) -> DataFrame:
    """One row per key of ``beats(key, i, rr)`` in ms: rmssd, sdnn, pnn50, mean_nn, corrected_fraction, reason."""
    order = Window.partitionBy("key").orderBy("i")
    rows = corrected_beats(beats).withColumn("d", F.col("nn") - F.lag("nn").over(order))
    sums = rows.groupBy("key").agg(
        F.count("rr").alias("n"), F.count_if(~finite(F.col("rr")) | (F.col("rr") <= 0) | F.col("rr").isNull()).alias("bad"), F.avg(F.col("replaced").cast("double")).alias("corrected"), F.sum("nn").alias("total"),
        F.sqrt(F.avg(F.col("d") * F.col("d"))).alias("rmssd"), F.stddev_pop("nn").alias("sdnn"), (100 * F.avg((F.abs("d") > 50).cast("double"))).alias("pnn50"), F.avg("nn").alias("mean_nn"),
    )
    why = ladder([(F.col("n") == 0, "missing_required_input"), (F.col("bad") > 0, "out_of_domain"), (F.col("corrected") > most_corrected, "insufficient_data"), ((F.col("n") < 2) | (F.col("total") < 1000 * least_s), "insufficient_data")])
    sums = sums.withColumn("reason", why)
    live = F.col("reason").isNull()
    return sums.select("key", *(F.when(live, F.col(c)).alias(c) for c in ("rmssd", "sdnn", "pnn50", "mean_nn")), F.col("corrected").alias("corrected_fraction"), "reason")


def band_powers(x: np.ndarray, rate: float) -> tuple[float, float]:
    """Low and high band of one segment: the one-sided density of x less its mean under a Hann window, and its trapezoid area in
    each half-open band."""
    n = len(x)
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)
    power = np.abs(np.fft.rfft((x - x.mean()) * window)) ** 2 / (rate * (window**2).sum())
    power[1 : -1 if n % 2 == 0 else None] *= 2
    f = np.fft.rfftfreq(n, 1 / rate)
    return tuple(float(np.trapezoid(power[k], f[k])) for k in ((f >= lo) & (f < hi) for lo, hi in (C.HRV_LF, C.HRV_HF)))


def tachogram(nn: DataFrame, rate: float) -> DataFrame:
    """``(key, k, v)``: corrected beats ``(key, i, nn)`` on an even grid at ``rate`` Hz from the first beat's end to before the
    last's. Each beat makes the samples up to the next one's end."""
    order = Window.partitionBy("key").orderBy("i")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    rows = nn.select("key", "i", "nn", (F.sum("nn").over(so_far) / 1000 - F.first("nn").over(so_far) / 1000).alias("at"))
    rows = rows.withColumns({"next": F.lead("nn").over(order), "until": F.lead("at").over(order)})
    first, last = F.ceil(F.col("at") * rate), F.ceil(F.col("until") * rate) - 1
    samples = rows.where(last >= first).select("key", "nn", "next", "at", "until", F.explode(F.sequence(first, last)).alias("k"))
    return samples.select("key", "k", (F.col("nn") + (F.col("next") - F.col("nn")) / (F.col("until") - F.col("at")) * (F.col("k") / rate - F.col("at"))).alias("v"))


def hrv_frequency_domain(beats: DataFrame, rate: float = 4.0, most: int = 256) -> DataFrame:
    """One row per key: lf, hf (ms squared), lf_hf, reason.

    Corrected beats on an even grid at ``rate`` Hz are cut into half-overlapping segments of min(n, ``most``) samples; a
    task works one segment, and a band is the mean over the segments' areas.
    """
    nn = corrected_beats(beats)
    sums = nn.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("nn").isNull() | ~finite(F.col("nn")) | (F.col("nn") <= 0)).alias("bad"), F.avg(F.col("replaced").cast("double")).alias("corrected"))
    early = ladder([(F.col("n") < 4, "insufficient_data"), (F.col("bad") > 0, "out_of_domain"), (F.col("corrected") > C.HRV_MOST_CORRECTED, "insufficient_data")])
    sums = sums.select("key", early.alias("why"))
    samples = tachogram(nn.join(sums.where("why IS NULL").select("key"), "key"), rate)
    sized = samples.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("key"))).where("n >= 4").withColumn("size", F.least(F.col("n"), F.lit(most)))
    step = F.col("size") - F.floor(F.col("size") / 2)
    first = F.greatest(F.lit(0), F.ceil((F.col("k") - F.col("size") + 1) / step))
    last = F.least(F.floor(F.col("k") / step), F.floor((F.col("n") - F.col("size")) / step))
    segments = sized.where(last >= first).select("key", "k", "v", F.explode(F.sequence(first, last)).alias("segment"))

    def bands(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        lf, hf = band_powers(pdf["v"].to_numpy(float)[pdf["k"].to_numpy().argsort()], rate)
        return pd.DataFrame({"key": [key[0]], "lf": lf, "hf": hf})

    kind = dict(beats.dtypes)["key"]
    areas = segments.groupBy("key", "segment").applyInPandas(bands, f"key {kind}, lf double, hf double").groupBy("key").agg(F.avg("lf").alias("lf"), F.avg("hf").alias("hf"))
    rows = sums.join(areas, "key", "left")
    why = F.coalesce(F.col("why"), F.when(F.coalesce(F.col("hf"), F.lit(0.0)) == 0, "insufficient_data"))
    return rows.select("key", *(F.when(why.isNull(), c).alias(n) for n, c in (("lf", F.col("lf")), ("hf", F.col("hf")), ("lf_hf", ratio(F.col("lf"), F.col("hf"))))), why.alias("reason"))


def decoupling(stream: DataFrame, least_s: int = C.DECOUPLING_LEAST_S, smooth: int = C.DECOUPLING_SMOOTH_S, least_half: int = C.DECOUPLING_LEAST_HALF, most_cv: float = C.DECOUPLING_MOST_CV) -> DataFrame:
    """One row per key of ``(key, t, power, hr)``: drift of output per heart beat from the first half to the second, in %.

    Seconds with both channels count; standing still (output 0) is left out before smoothing over the seconds that
    remain. Halves are told by the middle of the time from the first to the last second with both channels.
    """
    both = F.col("power").isNotNull() & F.col("hr").isNotNull()
    per_key = Window.partitionBy("key")
    rows = stream.withColumn("moving", both & (F.coalesce("power", F.lit(0.0)) != 0)).withColumn("a", F.min(F.when(both, F.col("t"))).over(per_key)).withColumn("b", F.max(F.when(both, F.col("t"))).over(per_key))
    last = Window.partitionBy("key", "moving").orderBy("t").rowsBetween(-(smooth - 1), 0)
    rows = rows.withColumn("out", F.when(F.col("moving") & (F.count("power").over(last) == smooth), F.avg("power").over(last)))
    counted = F.col("out").isNotNull()
    first = counted & (F.col("t") <= (F.col("a") + F.col("b")) / 2)
    second = counted & ~first
    half = lambda c, keep: F.avg(F.when(keep, F.col(c)))
    rows = rows.groupBy("key").agg(
        F.count("power").alias("np"), F.count("hr").alias("nh"), F.min("a").alias("a"), F.min("b").alias("b"), F.count("out").alias("n"), F.avg("out").alias("mean"), F.stddev_pop("out").alias("sd"), F.count_if(first).alias("n1"),
        F.count_if(second).alias("n2"), ratio(half("out", first), half("hr", first)).alias("e1"), ratio(half("out", second), half("hr", second)).alias("e2"),
    )
    why = ladder(
        [
            ((F.col("np") == 0) | (F.col("nh") == 0) | F.col("a").isNull(), "missing_required_input"), (F.col("b") - F.col("a") + 1 < least_s, "insufficient_data"), (F.coalesce("n", F.lit(0)) == 0, "insufficient_data"),
            (F.col("mean") <= 0, "out_of_domain"), (ratio(F.col("sd"), F.col("mean")) > most_cv, "insufficient_data"), ((F.col("n1") < least_half) | (F.col("n2") < least_half), "insufficient_data"), (F.col("e1") == 0, "out_of_domain"),
        ]
    )
    rows = rows.withColumn("reason", why)
    live = F.col("reason").isNull()
    return rows.select("key", F.when(live, 100 * ratio(F.col("e1") - F.col("e2"), F.col("e1"))).alias("drift_pct"), F.when(live, F.col("n")).alias("included_s"), "reason")


def with_summary(series: DataFrame, summary: DataFrame) -> DataFrame:
    """Time-domain variability of each key: from its beats where they gave a value, else the device's summary as it is.

    ``series(key, rmssd, sdnn, pnn50, mean_nn, reason)`` from :func:`hrv_time_domain`, ``summary`` with the same values.
    Beats that were rejected keep their reason; only a key without beats falls back, and one without either is missing.
    """
    values = ("rmssd", "sdnn", "pnn50", "mean_nn")
    s = summary.select("key", F.struct(*values).alias("summary"))
    both = series.select("key", F.struct(*values, "reason").alias("beats")).join(s, "key", "full_outer")
    given = F.greatest(F.lit(False), *(F.col(f"summary.{v}").isNotNull() for v in values))
    from_summary = F.col("beats").isNull() & F.coalesce(given, F.lit(False))
    why = F.when(F.col("beats").isNotNull(), F.col("beats.reason")).when(~from_summary, "missing_required_input")
    source = F.when(F.col("beats").isNotNull(), "beats").when(from_summary, "summary")
    return both.select("key", *(F.when(from_summary, F.col(f"summary.{v}")).otherwise(F.col(f"beats.{v}")).alias(v) for v in values), source.alias("source"), why.alias("reason"))


def baseline(low: Column, high: Column) -> Column:
    """The middle of a baseline band: the mean of those of its bounds that are finite numbers."""
    a, b = F.when(finite(low), low), F.when(finite(high), high)
    return F.when(a.isNotNull() & b.isNotNull(), (a + b) / 2).otherwise(F.coalesce(a, b))


def beats_of_day(sets: DataFrame) -> DataFrame:
    """Beats of each key and day from the first recording that carries them: ``sets(key, day, recording_id, rr array)``."""
    carrying = sets.where(F.coalesce(F.size("rr"), F.lit(0)) > 0)
    return carrying.groupBy("key", "day").agg(F.min("recording_id").alias("recording_id"), F.min_by("rr", "recording_id").alias("rr"))


def hr_load(rows: DataFrame, preferred: str | None = None) -> DataFrame:
    """The heart-rate load of ``(key, has_hr, zonal, banister)``: load, load_model, requested_load_model, load_model_substituted.

    Without heart rate there is none. The preferred model counts where it gave a value, else the other, which is marked;
    without a preference the zonal one comes first.
    """
    order = ("banister", "zonal") if preferred == "banister" else ("zonal", "banister")
    live = F.coalesce(F.col("has_hr"), F.lit(False))
    value = F.when(live, F.coalesce(*order))
    model = F.when(live, F.when(F.col(order[0]).isNotNull(), order[0]).when(F.col(order[1]).isNotNull(), order[1]))
    other = model.isNotNull() & (model != F.lit(preferred)) if preferred else F.lit(False)
    return rows.select("key", value.alias("load"), model.alias("load_model"), F.when(other, F.lit(preferred)).alias("requested_load_model"), F.coalesce(other, F.lit(False)).alias("load_model_substituted"))


def output_stream(stream: DataFrame, sports: DataFrame) -> DataFrame:
    """``(key, t, power, hr)`` for decoupling from ``(key, t, power, speed, hr)``: output is power for cycling and speed for
    sports on foot; other sports have none. Gate the metric with :func:`power.gated` over both kinds."""
    out = F.when(F.col("sport").isin(*C.POWER_SPORTS), F.col("power")).when(F.col("sport").isin(*C.PACE_SPORTS), F.col("speed"))
    return stream.join(sports.select("key", "sport"), "key").select("key", "t", out.alias("power"), "hr")
