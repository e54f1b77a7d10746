"""Recordings from GPX, TCX and FIT files, gzipped or not, as rows of samples.

Files are read by Spark's ``binaryFile`` source; each task decodes the files of its partition one at a time. A file that
can't be decoded gives one row with an error and no sample, so that one bad file never fails a job.
"""

from __future__ import annotations

import datetime as dt
import gzip
import hashlib
import struct
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SAMPLE = "path string, format string, pos long, time timestamp, power_w double, hr_bpm double, cadence_rpm double, speed_mps double, altitude_m double, distance_m double, temp_c double, lat double, lng double, error string"
FIELDS = [c.split()[0] for c in SAMPLE.split(", ")][4:13]
FIT_EPOCH = dt.datetime(1989, 12, 31)
SEMICIRCLE = 180 / 2**31

#: Element names of the two XML formats and their fields.
XML_FIELDS = {
    "power": "power_w", "powerinwatts": "power_w", "watts": "power_w", "hr": "hr_bpm", "heartratebpm": "hr_bpm", "cad": "cadence_rpm", "cadence": "cadence_rpm", "runcadence": "cadence_rpm", "speed": "speed_mps",
    "ele": "altitude_m", "altitudemeters": "altitude_m", "distancemeters": "distance_m", "atemp": "temp_c", "latitudedegrees": "lat", "longitudedegrees": "lng",
}
#: Field numbers of a FIT record message with their scale and offset.
FIT_RECORD = {0: ("lat", SEMICIRCLE, 0), 1: ("lng", SEMICIRCLE, 0), 2: ("altitude_m", 1 / 5, 500), 3: ("hr_bpm", 1, 0), 4: ("cadence_rpm", 1, 0), 5: ("distance_m", 1 / 100, 0), 6: ("speed_mps", 1 / 1000, 0), 7: ("power_w", 1, 0), 13: ("temp_c", 1, 0), 73: ("speed_mps", 1 / 1000, 0), 78: ("altitude_m", 1 / 5, 500)}
#: Field numbers of FIT lap and session messages (timer time counts before elapsed time), and sport numbers.
FIT_LAP = {
    7: ("duration_s", 1 / 1000, 0), 8: ("duration_s", 1 / 1000, 0), 9: ("distance_m", 1 / 100, 0), 15: ("avg_hr_bpm", 1, 0), 16: ("max_hr_bpm", 1, 0), 17: ("avg_cadence_rpm", 1, 0), 19: ("avg_power_w", 1, 0), 20: ("max_power_w", 1, 0),
}
FIT_SESSION = {7: ("duration_s", 1 / 1000, 0), 8: ("duration_s", 1 / 1000, 0), 9: ("distance_m", 1 / 100, 0)}
FIT_SPORTS = {0: "generic", 1: "running", 2: "cycling", 5: "swimming", 10: "training", 11: "walking", 15: "rowing", 17: "hiking"}
#: Elements of a TCX lap and their fields.
TCX_LAP = {"totaltimeseconds": "duration_s", "distancemeters": "distance_m", "averageheartratebpm": "avg_hr_bpm", "maximumheartratebpm": "max_hr_bpm", "cadence": "avg_cadence_rpm"}
#: FIT base types with their struct codes and invalid values.
FIT_TYPES = {0x00: ("B", 0xFF), 0x01: ("b", 0x7F), 0x02: ("B", 0xFF), 0x83: ("h", 0x7FFF), 0x84: ("H", 0xFFFF), 0x85: ("i", 0x7FFFFFFF), 0x86: ("I", 0xFFFFFFFF), 0x88: ("f", None), 0x89: ("d", None), 0x0A: ("B", 0), 0x8B: ("H", 0), 0x8C: ("I", 0)}


class Undecodable(ValueError):
    """A file that is in none of the formats, or breaks its own."""


def format_of(name: str, data: bytes) -> str:
    """fit, tcx or gpx, by suffix or by the file's first bytes, asked in this order."""
    name, head = name.lower(), data[:512]
    for kind, seen in (("fit", data[8:12] == b".FIT" and data[:1] in (b"\x0c", b"\x0e")), ("tcx", b"TrainingCenterDatabase" in head), ("gpx", b"<gpx" in head or head.lstrip().startswith(b"<?xml"))):
        if name.endswith("." + kind) or seen:
            return kind
    raise Undecodable("unknown format")


def _number(text: str | None) -> float | None:
    try:
        x = float(text)
    except (TypeError, ValueError):
        return None
    return x if x == x and abs(x) != float("inf") else None


def _instant(text: str | None) -> dt.datetime | None:
    try:
        found = dt.datetime.fromisoformat((text or "").strip().replace("Z", "+00:00"))
    except ValueError:
        return None
    return found.astimezone(dt.UTC).replace(tzinfo=None) if found.tzinfo else found


def xml_samples(data: bytes, point: str) -> Iterator[dict]:
    """Points in order; names are read without namespace and the first value of a field counts."""
    if b"<!DOCTYPE" in data or b"<!ENTITY" in data:
        raise Undecodable("declarations are refused")
    try:
        tree = ElementTree.fromstring(data)
    except ElementTree.ParseError as e:
        raise Undecodable(str(e)) from None
    local = lambda e: e.tag.rpartition("}")[2].lower()
    for p in tree.iter():
        if local(p) != point:
            continue
        row = {"lat": _number(p.get("lat")), "lng": _number(p.get("lon"))}
        for e in p.iter():
            name = local(e)
            text = next((v.text for v in e if local(v) == "value"), None) if name == "heartratebpm" else e.text
            if name == "time":
                row.setdefault("time", _instant(text))
            elif name in XML_FIELDS and row.get(XML_FIELDS[name]) is None:
                row[XML_FIELDS[name]] = _number(text)
        yield row


def fit_messages(data: bytes) -> Iterator[tuple[int, dict[int, object], int | None]]:
    """Data messages of a FIT file in order: number, values by field (a tuple for a field of several), time stamp so far.

    Definitions, compressed time headers and both byte orders are understood; invalid values are left out.
    """
    if len(data) < 12 or data[8:12] != b".FIT":
        raise Undecodable("no FIT header")
    at, end = data[0], data[0] + struct.unpack_from("<I", data, 4)[0]
    if end > len(data):
        raise Undecodable("truncated")
    kinds: dict[int, tuple] = {}
    stamp = None
    while at < end:
        head = data[at]
        at += 1
        packed = bool(head & 0x80)
        local = (head >> 5) & 3 if packed else head & 15
        if not packed and head & 0x40:
            order = ">" if data[at + 1] else "<"
            number, n = struct.unpack_from(order + "HB", data, at + 2)
            at += 5
            fields = [tuple(data[at + 3 * i : at + 3 * i + 3]) for i in range(n)]
            at += 3 * n
            extra = 0
            if head & 0x20:
                extra = sum(data[at + 2 + 3 * i] for i in range(data[at]))
                at += 1 + 3 * data[at]
            kinds[local] = (order, number, fields, extra)
            continue
        if local not in kinds:
            raise Undecodable("data before its definition")
        order, number, fields, extra = kinds[local]
        row: dict[int, object] = {}
        for field, size, base in fields:
            code, invalid = FIT_TYPES.get(base, (None, None))
            if code and size and size % struct.calcsize(code) == 0:
                values = struct.unpack_from(f"{order}{size // struct.calcsize(code)}{code}", data, at)
                known = tuple(v for v in values if v != invalid and v == v)
                if known:
                    row[field] = known[0] if len(values) == 1 else known
            at += size
        at += extra
        stamp = row.get(253, stamp)
        if packed and stamp is not None:
            stamp += ((head & 31) - stamp) & 31
        yield number, row, stamp


def _fit_time(seconds: object) -> dt.datetime | None:
    return None if seconds is None else FIT_EPOCH + dt.timedelta(seconds=seconds)


def _scaled(row: dict[int, object], fields: dict[int, tuple[str, float, float]]) -> dict:
    """Named values of a message; of several fields of one name the one listed last counts."""
    return {name: row[f] * scale - offset for f, (name, scale, offset) in fields.items() if isinstance(row.get(f), (int, float))}


def fit_samples(data: bytes) -> Iterator[dict]:
    """Record messages of a FIT file in order."""
    for number, row, stamp in fit_messages(data):
        if number == 20:
            yield _scaled(row, FIT_RECORD) | {"time": _fit_time(stamp)}


def fit_session(data: bytes) -> dict:
    """First session, laps, device identity and beats of a FIT file."""
    out: dict = {"laps": [], "rr_ms": [], "n_records": 0}
    device: dict[int, object] | None = None
    first = session = None
    for number, row, stamp in fit_messages(data):
        if number == 20:
            out["n_records"] += 1
            first = first or _fit_time(stamp)
        elif number == 18 and session is None:
            session = row
        elif number == 19:
            out["laps"].append({"start_time": _fit_time(row.get(2)), **_scaled(row, FIT_LAP)})
        elif number == 0 and device is None:
            device = row
        elif number == 78:
            beats = row.get(0, ())
            out["rr_ms"] += [float(x) for x in (beats if isinstance(beats, tuple) else (beats,)) if x > 0]
    if session is None and not out["n_records"]:
        raise Undecodable("neither records nor a session")
    out |= _scaled(session or {}, FIT_SESSION)
    out["sport"] = FIT_SPORTS.get((session or {}).get(5))
    out["start_time"] = _fit_time((session or {}).get(2)) or first or next((x["start_time"] for x in out["laps"] if x["start_time"]), None)
    identity = [(device or {}).get(f) for f in (1, 2, 3)] + [_fit_time((device or {}).get(4))]
    if any(x is not None for x in identity):
        out["fingerprint"] = "|".join("" if x is None else x.replace(tzinfo=dt.UTC).isoformat() if isinstance(x, dt.datetime) else str(x) for x in identity)
        # Only a device that names itself and the instant is the same recording wherever it turns up.
        out["strong_fingerprint"] = out["fingerprint"] if identity[2] is not None and identity[3] is not None else None
    return out


def xml_session(data: bytes, kind: str) -> dict:
    """Start, sport, laps and fingerprint of a GPX or TCX file."""
    samples = list(xml_samples(data, "trkpt" if kind == "gpx" else "trackpoint"))
    tree = ElementTree.fromstring(data)
    local = lambda e: e.tag.rpartition("}")[2].lower()
    times = [s["time"] for s in samples if s.get("time")]
    iso = lambda t: t.replace(tzinfo=dt.UTC).isoformat()
    out: dict = {"laps": [], "rr_ms": [], "n_records": len(samples)}
    if kind == "gpx":
        out["sport"] = next((t.text for e in tree.iter() if local(e) == "trk" for t in e if local(t) == "type" and t.text), None)
        if times:
            out |= {"start_time": times[0], "fingerprint": f"{iso(times[0])}|{(times[-1] - times[0]).total_seconds():.3f}|{len(samples)}"}
        return out
    for e in tree.iter():
        if local(e) == "activity" and "sport" not in out:
            out["sport"] = e.get("Sport")
        if local(e) != "lap":
            continue
        lap: dict = {"start_time": _instant(e.get("StartTime"))}
        for child in e:
            name = TCX_LAP.get(local(child))
            if name:
                lap[name] = _number(next((v.text for v in child if local(v) == "value"), child.text))
        out["laps"].append(lap)
    start = next((lap["start_time"] for lap in out["laps"] if lap["start_time"]), times[0] if times else None)
    if start is not None:
        total = lambda c: sum(lap.get(c) or 0.0 for lap in out["laps"])
        out |= {"start_time": start, "fingerprint": f"{iso(start)}|{total('duration_s'):.3f}|{total('distance_m'):.3f}"}
    return out


def session_of(name: str, data: bytes) -> dict:
    if data[:2] == b"\x1f\x8b":
        data, name = gzip.decompress(data), name.removesuffix(".gz")
    kind = format_of(name, data)
    found = fit_session(data) if kind == "fit" else xml_session(data, kind)
    # A file without an identity of its own is named by its content.
    return {"format": kind, "native_id": found.get("fingerprint") or hashlib.sha256(data).hexdigest(), **found}


LAP = "lap_index:int,start_time:timestamp,duration_s:double,distance_m:double,avg_power_w:double,max_power_w:double,avg_hr_bpm:double,max_hr_bpm:double,avg_cadence_rpm:double"
SESSION = f"path string, format string, native_id string, fingerprint string, strong_fingerprint string, start_time timestamp, sport string, duration_s double, distance_m double, n_records long, tier string, rr_ms array<double>, laps array<struct<{LAP}>>, error string"


def read_sessions(spark: SparkSession, path: str) -> DataFrame:
    """One row per file under ``path``: start, sport, laps, beats between heart beats in ms, and the file's identity.

    The start is the session's, else the first record's, else the first lap's. ``tier`` is raw_stream with records and
    summary_only without. A file that can't be decoded has its error and nothing else.
    """
    names = [c.split()[0] for c in SESSION.split(", ")]
    lap_names = [c.split(":")[0] for c in LAP.split(",")]

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for name, data in zip(frame["path"], frame["content"]):
                try:
                    row = session_of(name, data)
                    row["tier"] = "raw_stream" if row["n_records"] else "summary_only"
                    row["laps"] = [{c: {"lap_index": i, **lap}.get(c) for c in lap_names} for i, lap in enumerate(row["laps"])]
                except (Undecodable, OSError, EOFError, IndexError, struct.error, ElementTree.ParseError) as e:
                    row = {"error": str(e) or type(e).__name__}
                out.append([{"path": name, **row}.get(c) for c in names])
            yield pd.DataFrame(out, columns=names).astype(object)

    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    typed = found.mapInPandas(rows, SESSION)
    return typed.select(*(F.when(~F.isnan(c), F.col(c)).alias(c) if c in ("duration_s", "distance_m") else F.col(c) for c in names))


def decoded(name: str, data: bytes) -> tuple[str, list[dict]]:
    if data[:2] == b"\x1f\x8b":
        data, name = gzip.decompress(data), name.removesuffix(".gz")
    kind = format_of(name, data)
    return kind, list(fit_samples(data) if kind == "fit" else xml_samples(data, "trkpt" if kind == "gpx" else "trackpoint"))


def read_recordings(spark: SparkSession, path: str) -> DataFrame:
    """One row per sample of every file under ``path`` (a folder or glob), or one row with the error of a bad file."""

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, data in zip(frame["path"], frame["content"]):
                try:
                    kind, samples = decoded(name, data)
                    error = None if samples else "no samples"
                except (Undecodable, OSError, EOFError, IndexError, struct.error) as e:
                    kind, samples, error = None, [], str(e) or type(e).__name__
                out = pd.DataFrame(samples or [{}]).reindex(columns=["time", *FIELDS])
                out["time"] = pd.to_datetime(out["time"])
                out[FIELDS] = out[FIELDS].astype(float)
                out.insert(0, "path", name)
                out.insert(1, "format", kind)
                out.insert(2, "pos", range(len(out)))
                out["error"] = error
                yield out

    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    typed = found.mapInPandas(rows, SAMPLE)
    # pandas has NaN where a sample lacks a field; a gap is null.
    return typed.select(*(F.when(~F.isnan(c), F.col(c)).alias(c) if c in FIELDS else F.col(c) for c in typed.columns))
