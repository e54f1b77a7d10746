"""Closed-form values, and operators against small recurrences."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strideframe.functions.result import REASONS, ladder, result
from strideframe.operators import heart, load, power, resolve, serve, series, temporal, text


def stream(spark, power_w, hr=None, key=1):
    return spark.createDataFrame([(key, t, None if p is None else float(p), None if hr is None else float(hr)) for t, p in enumerate(power_w)], "key long, t long, power double, hr double")


def grid(spark, loads):
    return spark.createDataFrame([(1, i, x) for i, x in enumerate(loads)], "key long, i int, load double").select("key", F.date_add(F.to_date(F.lit("2020-01-01")), F.col("i")).alias("day"), "load", F.lit(False).alias("substituted"))


def test_fitness_first_days(spark):
    rows = load.pmc(grid(spark, [100.0, 0.0, 0.0])).orderBy("day").collect()
    assert rows[0].ctl == pytest.approx(2.3528313347756735) and rows[0].atl == pytest.approx(13.312210024981841) and rows[0].tsb == 0
    assert rows[1].ctl == pytest.approx(2.2974731818766507) and rows[1].atl == pytest.approx(11.54006066748957) and rows[1].tsb == pytest.approx(-10.959378690206167)


def test_a_load_that_is_not_finite_has_a_reason(spark):
    rows = load.pmc(grid(spark, [100.0, float("nan"), None, 5.0])).collect()
    assert {(r.ctl, r.atl, r.tsb, r.reason) for r in rows} == {(None, None, None, "out_of_domain")}
    assert {r.reason for r in load.pmc(grid(spark, [100.0, None])).collect()} == {None}


def test_fitness_over_many_blocks(spark):
    rng = random.Random(4)
    loads = [None if rng.random() < 0.05 else rng.random() * 200 for _ in range(3500)]
    ctl = atl = 0.0
    c, a = math.exp(-1 / 42), math.exp(-1 / 7)
    for x in loads:
        ctl, atl = c * ctl + (1 - c) * (x or 0), a * atl + (1 - a) * (x or 0)
    last = load.pmc(grid(spark, loads)).orderBy(F.desc("day")).first()
    assert last.ctl == pytest.approx(ctl, rel=1e-11) and last.atl == pytest.approx(atl, rel=1e-11)


def test_constant_power(spark):
    out = power.load_bundle(power.normalized_power(stream(spark, [250] * 3600)).withColumns({"ftp_w": F.lit(250.0), "avg_hr_bpm": F.lit(125.0)})).first()
    assert (out.np_w, out.window_s, out.duration_s) == (pytest.approx(250), 3571, 3600)
    assert (out.if_, out.tss, out.ef, out.vi, out.intensity_class) == (pytest.approx(1), pytest.approx(100), pytest.approx(2), pytest.approx(1), "threshold")


def test_power_reasons(spark):
    reason = lambda s: power.normalized_power(s).first().reason
    assert reason(stream(spark, [None] * 40)) == "missing_required_input"
    assert reason(stream(spark, [200, None] * 40)) == "insufficient_data"
    running = stream(spark, [200] * 40).withColumn("sport", F.lit("running"))
    assert power.normalized_power(running, sport="sport").first().reason == "not_applicable_for_sport"


def test_w_balance(spark):
    out = [r.w_bal_j for r in power.w_balance(stream(spark, [300, 400, 100, 0]), 250.0, 20000.0).orderBy("t").collect()]
    assert out == pytest.approx([19950, 19800, 19800.456278006666, 19801.008543236825])


def test_variability(spark):
    beats = spark.createDataFrame([(1, i, float(x)) for i, x in enumerate([800, 850, 820, 810, 805])], "key long, i long, rr double")
    out = heart.hrv_time_domain(beats, least_s=0).first()
    assert (out.rmssd, out.sdnn, out.pnn50, out.mean_nn) == pytest.approx((29.685855217594792, 17.776388834631177, 0, 817))


def test_best_windows_match_brute_force(spark):
    rng = random.Random(7)
    values = [None if rng.random() < 0.1 else rng.randint(0, 9) for _ in range(60)]
    found = {r.duration_s: r for r in power.mean_maximal_power(stream(spark, values), (1, 2, 5)).collect()}
    for d in (1, 2, 5):
        best = None
        for n in range(d, 61):
            for s in range(61 - n):
                w = values[s : s + n]
                if None not in w and (best is None or sum(w) / n > best[0]):
                    best = (sum(w) / n, n, s)
        assert (found[d].best_w, found[d].window_s, found[d].start_t) == best


def test_critical_power_of_a_line(spark):
    points = spark.createDataFrame([(1, d, 250 + 20000 / d) for d in (120, 300, 600, 1200)], "key long, duration_s long, best_w double")
    out = power.critical_power(points).first()
    assert (out.cp_w, out.w_prime_j) == pytest.approx((250, 20000)) and out.se_cp == pytest.approx(0, abs=1e-6) and out.reason is None
    assert power.critical_power(points.where("duration_s < 600")).first().reason == "insufficient_data"


@pytest.mark.parametrize("minutes", [1, 20])
def test_spectrum_finds_a_tone(spark, minutes):
    at, beats = 0.0, []
    while at < 60 * minutes:
        beats.append(1000 + 40 * np.sin(2 * np.pi * 0.1 * at) + 2 * np.sin(2 * np.pi * 0.25 * at))
        at += beats[-1] / 1000
    out = heart.hrv_frequency_domain(spark.createDataFrame([(1, i, float(x)) for i, x in enumerate(beats)], "key long, i long, rr double")).first()
    assert out.reason is None and out.lf == pytest.approx(800, rel=0.1) and out.hf < 10 and out.lf_hf == pytest.approx(out.lf / out.hf)


def test_resample_takes_the_first_of_equal_times_and_keeps_gaps(spark):
    s = spark.createDataFrame([(1, 0, 0, 1.0), (1, 1, 0, 9.0), (1, 2, 3, 4.0), (1, 3, 8, 9.0), (1, 4, 9, None)], "key long, pos long, t long, v double")
    out = [r.v for r in series.resample_1hz(s).orderBy("t").collect()]
    assert out == [1.0, 2.0, 3.0, 4.0, None, None, None, None, 9.0, None]


def test_as_of_gate_comes_after_the_choice(spark):
    v = spark.createDataFrame([(1, "2024-01-01", 200.0, 0.9), (1, "2024-02-01", 250.0, 0.1)], "key long, since string, ftp double, r2 double").withColumn("since", F.to_date("since"))
    p = spark.createDataFrame([(1, "2023-12-31"), (1, "2024-01-15"), (1, "2024-02-01")], "key long, day string").withColumn("day", F.to_date("day"))
    out = temporal.as_of(p, v, ["key"], "day", "since", ["ftp"], F.col("r2") > 0.5).orderBy("day").collect()
    assert [r.ftp for r in out] == [None, 200.0, None]


def test_one_session_from_three_sources(spark):
    rows = spark.createDataFrame(
        [(1, "raw_stream", 1.0, 250.0, "a"), (1, "platform_computed", 1.0, 251.0, "b"), (1, "summary_only", 1.0, 248.0, "c")], "key long, tier string, confidence double, value double, source string"
    ).withColumns({"observed": F.to_timestamp(F.lit("2024-01-01")), "completeness": F.lit(1.0)})
    out = resolve.winners(rows, ["key"]).first()
    assert (out.w.value, out.rule, out.n, out.disputed) == (250.0, "trust_tier", 3, False)


def test_ladder_knows_its_reasons(spark):
    with pytest.raises(ValueError):
        ladder([(F.lit(True), "because")])
    row = spark.range(1).select(result(F.lit(float("nan")), F.lit(None).cast("string")).alias("r")).first().r
    assert (row.available, row.value, row.reason) == (False, None, "out_of_domain") and row.reason in REASONS


def test_readiness_steps_down_when_suppressed(spark):
    rows = spark.createDataFrame([(1, 6.0, 40.0, 50.0), (2, 6.0, 50.0, 50.0), (3, -30.0, 1.0, 50.0), (4, None, 1.0, 50.0)], "key long, form double, hrv_rmssd double, hrv_baseline double")
    assert [r.verdict for r in serve.readiness(rows).orderBy("key").collect()] == ["MAINTAIN", "GO", "REST", None]


def test_constraint_gate_and_negation(spark):
    t = spark.createDataFrame([(1, "Run hills today. Rest tomorrow."), (2, "Do not run today"), (3, "")], "id long, text string")
    out = text.constraint_gate(t, "id", "text", ["run"], ["rest"], ["not"]).orderBy("id", "place").collect()
    assert [(r.id, r.place, r.action) for r in out] == [(1, 0, "remove"), (1, 1, "caution")]


def test_track_keeps_corners(spark):
    pts = spark.createDataFrame([(1, t, float(min(t, 50)), float(max(0, t - 50))) for t in range(101)], "key long, t long, lat double, lng double")
    assert [r.t for r in serve.simplified_track(pts, 5).orderBy("t").collect()] == [0, 50, 100]


def test_empty_tables(spark):
    none = stream(spark, [1]).where("false")
    assert power.normalized_power(none).count() == power.mean_maximal_power(none).count() == heart.decoupling(none).count() == series.runs(none, "power").count() == 0


def test_sessions_are_matched_in_order(spark):
    from strideframe.operators import lifecycle

    rows = [("a", 0, 600.0, None), ("b", 100, 610.0, None), ("c", 200, 600.0, None), ("d", 90_000, 600.0, "p"), ("e", 300_000, 50.0, "p"), ("f", 210, 5000.0, None)]
    df = spark.createDataFrame([(1, "cycling", i, s, d, p) for i, s, d, p in rows], "athlete long, sport string, id string, s long, duration_s double, fingerprint string").withColumn("start", F.col("s").cast("timestamp"))
    out = {r.id: r.session_id for r in lifecycle.identities(df).collect()}
    assert out == {"a": "a", "b": "a", "c": "c", "d": "d", "e": "d", "f": "f"}


def test_bucket_and_context(spark):
    from strideframe.operators import lifecycle

    r = spark.createDataFrame([(1, i, float(t)) for i, t in enumerate([0, 0, 0, 1, 2])], "u long, id long, at double")
    assert [x.admitted for x in lifecycle.token_bucket(r, ["u"], "at", 1.0, 2.0).orderBy("id").collect()] == [True, True, False, True, True]
    c = spark.createDataFrame([(1, 1, 9.0, 50), (1, 2, 8.0, 60), (1, 3, 7.0, 40)], "u long, id long, relevance double, tokens long")
    assert sorted(x.id for x in lifecycle.greedy_context(c, ["u"], 100).collect()) == [1, 3]


def test_cursor_is_bound_and_signed():
    c = serve.encode_cursor([1.5, "2024-01-01", 7], {"sport": "cycling"}, b"k")
    assert serve.decode_cursor(c, {"sport": "cycling"}, b"k") == [1.5, "2024-01-01", 7]
    for bad in ((c, {"sport": "running"}, b"k"), (c, {"sport": "cycling"}, b"x"), ("!", {}, b"k")):
        with pytest.raises(ValueError):
            serve.decode_cursor(*bad)
    assert serve.clamp_limit(500) == 200


def test_capabilities(spark):
    from strideframe.plans import engine

    s = stream(spark, [250] * 1300, 120)
    daily = grid(spark, [100.0, 0.0]).select("key", "day", "load", "substituted")
    beats = spark.createDataFrame([(1, i, 800.0) for i in range(200)], "key long, i long, rr double")
    x = engine.Inputs(s, daily, beats, spark.createDataFrame([(1, 250.0)], "key long, ftp_w double"))
    run = lambda name, **p: engine.run(spark, name, x, **p).collect()
    assert run("load_metrics")[0].tss == pytest.approx(1300 / 36, rel=1e-6) and run("hrv")[0].rmssd == 0 and run("decoupling")[0].drift_pct == pytest.approx(0)
    assert len(run("weekly_load", first="2020-01-01", last="2020-01-07")) == 7 and run("trimp", rest=50, most=190, sex="m")[0].trimp > 0
    assert run("nothing")[0].reason == "missing_dependency" and run("trimp")[0].reason == "missing_required_input"
