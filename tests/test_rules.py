"""Rules of balance, identity and files against closed forms and direct recursions."""

import datetime as dt
import math
import struct
import tempfile
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from strideframe.operators import contribute, power, series
from strideframe.sources import files


def test_balance_over_days_of_seconds(spark):
    """300,000 s with sparse work: the recursion second by second."""
    rng = np.random.default_rng(3)
    p = np.where(rng.random(300_000) < 0.001, 600.0, rng.uniform(0, 240, 300_000))
    p[rng.random(300_000) < 0.01] = np.nan
    want, b = np.empty(len(p)), 20_000.0
    for t, x in enumerate(p):
        if not math.isnan(x):
            b = b - (x - 250) if x >= 250 else b + (20_000 - b) * (1 - math.exp(-1 / (546 * math.exp(-0.01 * (250 - x)) + 316)))
        want[t] = b
    import pandas as pd

    stream = spark.createDataFrame(pd.DataFrame({"key": 1, "t": range(len(p)), "power": p})).withColumn("power", F.when(~F.isnan("power"), F.col("power")))
    got = power.w_balance(stream, 250.0, 20_000.0).orderBy("t").toPandas()["w_bal_j"].to_numpy()
    assert np.isfinite(got).all() and np.allclose(got, want, atol=1e-6)
    for cp, w in ((None, 1.0), (0.0, 1.0), (250.0, float("nan")), (250.0, -1.0)):
        assert power.w_balance(stream.where("t < 3"), cp, w).where("w_bal_j IS NOT NULL").count() == 0


def test_power_curve_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(power, "MMP_BLOCK_S", 64)
    rng = np.random.default_rng(1)
    v = [None if x < 20 else float(x) for x in rng.integers(0, 400, 700)]
    got = {r.duration_s: (round(r.best_w, 9), r.window_s, r.start_t) for r in power.mean_maximal_power(spark.createDataFrame([(1, t, x) for t, x in enumerate(v)], "key long, t long, power double"), (1, 5, 16)).collect()}
    for d in (1, 5, 16):
        best = max(((np.mean(v[a : a + n]), -n, -a) for n in range(d, 2 * d) for a in range(len(v) - n + 1) if None not in v[a : a + n]))
        assert got[d] == (round(best[0], 9), -best[1], -best[2])


def test_resampling_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(series, "BLOCK_S", 7)
    rows = [(1, 0, 0.0, 1.0), (1, 1, 2.0, 3.0), (1, 2, 30.5, 5.0), (1, 3, 31.5, 7.0)]
    got = {r.t: r.v for r in series.resample_1hz(spark.createDataFrame(rows, "key long, pos long, t double, v double")).collect()}
    assert got == {t: {0: 1.0, 1: 2.0, 2: 3.0, 31: 6.0}.get(t) for t in range(32)}


def test_decisions_name_their_rule(spark):
    at = dt.datetime(2024, 5, 1, 6)
    rows = [("a", at, "p"), ("b", at + dt.timedelta(seconds=60), None), ("c", at + dt.timedelta(days=3), "p")]
    rec = spark.createDataFrame(rows, "id string, start timestamp, fingerprint string")
    named = spark.createDataFrame([("a", "a"), ("b", "a"), ("c", "a")], "id string, session_id string")
    out = {r.id: (r.rule, r.score) for r in contribute.decision_records(rec, named).collect()}
    assert out == {"a": ("opened", 1.0), "b": ("window", pytest.approx(1 - 60 / 7200)), "c": ("fingerprint", 1.0)}


def fit_session() -> bytes:
    def message(local, number, fields, *values):
        head = struct.pack("<BBBHB", 0x40 | local, 0, 0, number, len(fields)) + b"".join(bytes(f) for f in fields)
        codes = {0x86: "I", 0x84: "H", 0x02: "B", 0x00: "B"}
        return head + bytes([local]) + b"".join(struct.pack(f"<{size // struct.calcsize(codes[base])}{codes[base]}", *(v if isinstance(v, tuple) else (v,))) for (_, size, base), v in zip(fields, values))

    body = message(0, 0, [(1, 2, 0x84), (2, 2, 0x84), (3, 4, 0x8C), (4, 4, 0x86)][:2] + [(4, 4, 0x86)], 1, 2697, 1_000_000_000)
    body += message(1, 19, [(2, 4, 0x86), (7, 4, 0x86), (8, 4, 0x86), (9, 4, 0x86), (15, 1, 0x02)], 1_000_000_000, 65_000, 60_000, 50_000, 151)
    body += message(2, 78, [(0, 6, 0x84)], (800, 0xFFFF, 815))
    body += message(3, 18, [(2, 4, 0x86), (5, 1, 0x00), (8, 4, 0x86)], 1_000_000_000, 2, 60_000)
    return struct.pack("<BBHI4s", 12, 16, 0, len(body), b".FIT") + body + b"\0\0"


TCX = b"""<TrainingCenterDatabase><Activities><Activity Sport="Biking"><Lap StartTime="2024-05-01T06:00:00Z"><TotalTimeSeconds>61.5</TotalTimeSeconds><DistanceMeters>500</DistanceMeters>
<AverageHeartRateBpm><Value>140</Value></AverageHeartRateBpm></Lap><Lap><TotalTimeSeconds>NaN</TotalTimeSeconds><DistanceMeters>20.25</DistanceMeters></Lap></Activity></Activities></TrainingCenterDatabase>"""
GPX = b"""<gpx><trk><type>run</type><trkseg><trkpt lat="1" lon="2"><time>2024-05-01T06:00:00Z</time></trkpt><trkpt lat="1" lon="2"><time>2024-05-01T06:00:09.5Z</time></trkpt></trkseg></trk></gpx>"""


def test_sessions_of_files(spark):
    at = Path(tempfile.mkdtemp(prefix="spark-"))
    for name, data in (("a.fit", fit_session()), ("b.tcx", TCX), ("c.gpx", GPX), ("d.gpx", b"<gpx></gpx>"), ("e.fit", b"what")):
        (at / name).write_bytes(data)
    a, b, c, d, e = files.read_sessions(spark, str(at)).orderBy("path").collect()
    assert (a.sport, a.duration_s, a.n_records, a.tier, a.rr_ms, a.strong_fingerprint) == ("cycling", 60.0, 0, "summary_only", [800.0, 815.0], None)
    assert a.fingerprint == "1|2697||2021-09-08T01:46:40+00:00" == a.native_id and [(x.duration_s, x.distance_m, x.avg_hr_bpm, x.avg_power_w) for x in a.laps] == [(60.0, 500.0, 151.0, None)]
    assert b.fingerprint == "2024-05-01T06:00:00+00:00|61.500|520.250" and [(x.lap_index, x.duration_s, x.avg_hr_bpm) for x in b.laps] == [(0, 61.5, 140.0), (1, None, None)] and b.sport == "Biking"
    assert (c.fingerprint, c.sport, c.tier, c.laps) == ("2024-05-01T06:00:00+00:00|9.500|2", "run", "raw_stream", [])
    assert (len(d.native_id), d.fingerprint, d.start_time, d.error) == (64, None, None, None) and e.error and e.native_id is None
