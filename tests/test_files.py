"""Decoding of recordings, and streams to the end of their input."""

import gzip
import struct
import tempfile
from pathlib import Path

import pytest

from strideframe.sources import files
from strideframe.streaming import ingest

GPX = b"""<?xml version="1.0"?><gpx xmlns="http://www.topografix.com/GPX/1/1"><trk><trkseg>
<trkpt lat="50.1" lon="8.6"><ele>100</ele><time>2024-05-01T06:00:00Z</time><extensions><power>210</power><x:hr xmlns:x="y">140</x:hr></extensions></trkpt>
<trkpt lat="50.2" lon="8.7"><time>2024-05-01T08:00:01+02:00</time></trkpt></trkseg></trk></gpx>"""
TCX = b"""<TrainingCenterDatabase><Lap><Track><Trackpoint><Time>2024-05-01T06:00:00Z</Time><HeartRateBpm><Value>150</Value></HeartRateBpm><DistanceMeters>NaN</DistanceMeters>
<Extensions><TPX><Watts>199</Watts><Speed>8.5</Speed></TPX></Extensions></Trackpoint></Track></Lap></TrainingCenterDatabase>"""


def fit() -> bytes:
    fields = [(253, 4, 0x86), (7, 2, 0x84), (3, 1, 0x02), (0, 4, 0x85), (78, 4, 0x86)]
    body = struct.pack("<BBBHB", 0x40, 0, 0, 20, len(fields)) + b"".join(map(bytes, fields))
    body += struct.pack("<BIHBiI", 0, 1_000_000_000, 250, 150, 2**30, 5 * 600) + struct.pack("<BIHBiI", 0, 1_000_000_001, 0xFFFF, 0xFF, 0x7FFFFFFF, 5 * 600)
    return struct.pack("<BBHI4s", 12, 16, 0, len(body), b".FIT") + body + b"\0\0"


def test_recordings(spark):
    at = Path(tempfile.mkdtemp(prefix="spark-"))
    for name, data in (("a.gpx", GPX), ("b.tcx.gz", gzip.compress(TCX)), ("c.fit", fit()), ("d.gpx", b"<gpx><trkpt>"), ("e.bin", b"what")):
        (at / name).write_bytes(data)
    rows = {}
    for r in files.read_recordings(spark, str(at)).orderBy("path", "pos").collect():
        rows.setdefault(r.path.rpartition("/")[2], []).append(r)
    a, b, c = rows["a.gpx"], rows["b.tcx.gz"][0], rows["c.fit"]
    assert [(r.power_w, r.hr_bpm, r.lat, r.altitude_m) for r in a] == [(210, 140, 50.1, 100), (None, None, 50.2, None)]
    assert (a[1].time - a[0].time).total_seconds() == 1
    assert (b.power_w, b.hr_bpm, b.speed_mps, b.distance_m, b.format) == (199, 150, 8.5, None, "tcx")
    assert [(r.power_w, r.hr_bpm, r.altitude_m) for r in c] == [(250, 150, 100), (None, None, 100)] and c[0].lat == pytest.approx(90)
    assert rows["d.gpx"][0].error and rows["e.bin"][0].error == "unknown format"


def test_entities_are_refused():
    with pytest.raises(files.Undecodable):
        files.decoded("x.gpx", b'<!DOCTYPE x [<!ENTITY a "b">]><gpx/>')


def test_log_keeps_latest_version_and_reruns_change_nothing(spark):
    at = tempfile.mkdtemp(prefix="spark-")
    for n, rows in enumerate([[(1, 5.0), (2, 6.0)], [(1, 7.0)]]):
        spark.createDataFrame(rows, "id long, v double").write.mode("append").parquet(f"{at}/in")
        source = spark.readStream.schema("id long, v double").parquet(f"{at}/in")
        ingest.append_versions(source, f"{at}/log", f"{at}/ck", "id").awaitTermination()
        ingest.append_versions(source, f"{at}/log", f"{at}/ck", "id").awaitTermination()
    assert sorted((r.id, r.v) for r in ingest.current_rows(spark, f"{at}/log", "id").collect()) == [(1, 7.0), (2, 6.0)]


def test_payloads(spark):
    import json

    from strideframe.sources import payloads

    at = tempfile.mkdtemp(prefix="spark-")
    ride = {"id": "a1", "type": "Ride", "start_date": "2024-05-01T06:00:00Z", "icu_average_watts": 200, "icu_joules": 3000, "icu_rpe": 11, "feel": 3, "streams": [{"type": "watts", "data": [1, None, 3]}, {"type": "cadence", "data": [None, None]}, {"type": "w", "data": [1]}]}
    rows = [ride, {"type": "Kite", "start_date": "2024-05-01T06:00:00Z"}, {"id": "a3", "start_date": "2024-05-01T06:00:00"}]
    Path(f"{at}/a.json").write_text("\n".join(map(json.dumps, rows)))
    Path(f"{at}/w.json").write_text('{"id": "2024-05-01", "hrv": 55, "weight": 70.5}\n{"id": "today"}')
    out = {r.native_id: r for r in payloads.read_activities(spark, f"{at}/a.json").collect()}
    a = out["a1"]
    assert (a.sport, a.energy_kj, a.perceived_exertion, a.feel, a.has_power, a.has_hr, a.has_cadence, a.streams, a.rejected) == ("cycling", 3.0, None, 3, True, False, False, {"power_w": [1, None, 3]}, None)
    assert (out[None].rejected, out[None].sport, out["a3"].rejected) == ("missing:id", "other", "invalid:start_date")
    assert [(r.t, r.v) for r in payloads.stream_rows(payloads.read_activities(spark, f"{at}/a.json")).orderBy("t").collect()] == [(0, 1), (1, None), (2, 3)]
    w = payloads.read_wellness(spark, f"{at}/w.json").collect()
    assert [(str(r.local_date), r.hrv_rmssd_ms, r.body_mass_kg, r.rejected) for r in w] == [("2024-05-01", 55, 70.5, None), ("None", None, None, "invalid:id")]
