"""Serving operators: keyset pages, ranked recall, decimation, quantiles, rates, verdicts, coverage, exports."""

from __future__ import annotations

import base64
import hashlib
import hmac
import json
import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strideframe.functions import constants as C
from strideframe.functions.result import finite, ratio
from strideframe.operators.ranks import HOT_ROWS, values_at

MOST_PAGE = 200


def clamp_limit(limit: int) -> int:
    if limit < 1:
        raise ValueError("limit must be at least 1")
    return min(limit, MOST_PAGE)


def encode_cursor(values: Sequence, filters: dict, secret: bytes) -> str:
    """An opaque cursor, signed and bound to the filters of its listing."""
    bound = hashlib.sha256(json.dumps(filters, sort_keys=True, default=str).encode()).hexdigest()[:16]
    body = json.dumps([bound, *values], default=str).encode()
    return base64.urlsafe_b64encode(hmac.new(secret, body, hashlib.sha256).digest() + body).decode()


def decode_cursor(cursor: str, filters: dict, secret: bytes) -> list:
    """The values of a cursor; ValueError for one that is forged or belongs to another listing."""
    try:
        raw = base64.urlsafe_b64decode(cursor.encode())
    except ValueError:
        raise ValueError("not a cursor") from None
    sign, body = raw[:32], raw[32:]
    if not hmac.compare_digest(sign, hmac.new(secret, body, hashlib.sha256).digest()):
        raise ValueError("not a cursor of this service")
    bound, *values = json.loads(body)
    if bound != hashlib.sha256(json.dumps(filters, sort_keys=True, default=str).encode()).hexdigest()[:16]:
        raise ValueError("a cursor of another listing")
    return values


def keyset_page(rows: DataFrame, order: Sequence[tuple[str, bool]], limit: int, cursor: Sequence | None = None) -> DataFrame:
    """One page after the cursor's row, and a row more to tell that another page follows.

    ``order`` lists (column, descending); together the columns must be unique and not null. The cursor is compared column
    by column, so that a filter on the first reaches the files.
    """
    if cursor is not None:
        after, equal = F.lit(False), F.lit(True)
        for (name, down), value in zip(order, cursor):
            after = after | (equal & ((F.col(name) < F.lit(value)) if down else (F.col(name) > F.lit(value))))
            equal = equal & (F.col(name) == F.lit(value))
        first, down = order[0]
        rows = rows.where((F.col(first) <= F.lit(cursor[0])) if down else (F.col(first) >= F.lit(cursor[0]))).where(after)
    return rows.orderBy(*(F.desc(c) if down else F.asc(c) for c, down in order)).limit(clamp_limit(limit) + 1)


def nullable_axis(column: str, floor: str = "0001-01-01") -> Column:
    """A date axis on which rows without a date page after all others."""
    return F.coalesce(F.col(column), F.to_date(F.lit(floor)))


def ranked_recall(rows: DataFrame, terms: Sequence[str], text: str, recency: str, ident: str, k: int) -> DataFrame:
    """The k rows with most of the terms in their text, the newest first among equals, then the smaller id."""
    hits = sum((F.coalesce(F.contains(F.lower(F.col(text)), F.lit(t.lower())).cast("int"), F.lit(0)) for t in terms), F.lit(0))
    return rows.withColumn("hits", hits).orderBy(F.desc("hits"), F.desc(recency), ident).limit(k)


def decimated(stream: DataFrame, columns: Sequence[str], most: int) -> DataFrame:
    """At most about ``most`` samples of each key: an even stride, the last sample, and each channel's first lowest and
    highest sample, so that the shape's extremes stay."""
    live = lambda c, key: F.when(F.col(c).isNotNull(), F.struct(key, F.col("t")))
    ends = [F.min_by("t", live(c, F.col(c))).alias(f"lo_{c}") for c in columns] + [F.min_by("t", live(c, -F.col(c))).alias(f"hi_{c}") for c in columns]
    per_key = stream.groupBy("key").agg(F.count(F.lit(1)).alias("n_"), *ends)
    rows = stream.withColumn("i_", F.row_number().over(Window.partitionBy("key").orderBy("t")) - 1).join(per_key, "key")
    m = F.least(F.lit(most), F.col("n_"))
    # i is floor(j * n / m) for some j exactly if the next multiple of n at or after i * m lies within the step.
    stride = F.floor((F.ceil(F.col("i_") * m / F.col("n_")) * F.col("n_")) / m) == F.col("i_")
    keep = stride | (F.col("i_") == F.col("n_") - 1)
    for end in (f"{x}_{c}" for c in columns for x in ("lo", "hi")):
        keep = keep | F.coalesce(F.col("t") == F.col(end), F.lit(False))
    return rows.where(keep).select("key", "t", *columns)


def simplified_track(points: DataFrame, budget: int) -> DataFrame:
    """Ramer-Douglas-Peucker over ``(key, t, lat, lng)``: the tolerance doubles from 1e-6 until at most ``budget`` points are
    left or it reaches 1. A track is one recording and is worked whole in a task."""

    def kept(xy: np.ndarray, eps: float) -> np.ndarray:
        keep = np.zeros(len(xy), bool)
        keep[[0, -1]] = True
        todo = [(0, len(xy) - 1)]
        while todo:
            a, b = todo.pop()
            if b - a < 2:
                continue
            line, inner = xy[b] - xy[a], xy[a + 1 : b] - xy[a]
            size = np.hypot(*line)
            away = np.abs(line[0] * inner[:, 1] - line[1] * inner[:, 0]) / size if size else np.hypot(*inner.T)
            far = int(away.argmax())
            if away[far] > eps:
                keep[a + 1 + far] = True
                todo += [(a, a + 1 + far), (a + 1 + far, b)]
        return keep

    def simplify(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.dropna(subset=["lat", "lng"]).sort_values("t")
        xy, eps = pdf[["lat", "lng"]].to_numpy(float), 1e-6
        keep = np.ones(len(xy), bool)
        while len(xy) > 2 and keep.sum() > budget and eps < 1:
            keep, eps = kept(xy, eps), eps * 2
        return pdf[keep]

    return points.select("key", "t", "lat", "lng").groupBy("key").applyInPandas(simplify, points.select("key", "t", "lat", "lng").schema)


def quantiles(rows: DataFrame, on: Sequence[str], value: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Median and nearest-rank 95th percentile of each group that has a value."""
    of = lambda column, number: lambda n: column(n) if isinstance(n, Column) else number(n)
    ranks = {"low": of(lambda n: F.floor((n + 1) / 2), lambda n: (n + 1) // 2), "high": of(lambda n: F.floor(n / 2) + 1, lambda n: n // 2 + 1), "p95": of(lambda n: F.ceil(0.95 * n), lambda n: math.ceil(0.95 * n))}
    found = values_at(rows, on, value, ranks, hot_rows)
    return found.select(*on, "n", ((F.col("low") + F.col("high")) / 2).alias("median"), "p95")


def conformal_thresholds(examples: DataFrame, alpha: float, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Split-conformal threshold of each group of ``(example_id, group, score, supported)``.

    An example counts with the highest score among its unsupported claims, 0 without one; the threshold is the score of
    rank ceil((n + 1)(1 - alpha)), or 1 where the rank exceeds n.
    """
    per_example = examples.groupBy("group", "example_id").agg(F.coalesce(F.max(F.when(~F.col("supported"), F.col("score"))), F.lit(0.0)).alias("score"))
    rank = lambda n: F.ceil((n + 1) * (1 - alpha)) if isinstance(n, Column) else min(math.ceil((n + 1) * (1 - alpha)), n + 1)
    found = values_at(per_example, ["group"], "score", {"threshold": rank}, hot_rows)
    return found.select("group", "n", F.coalesce("threshold", F.lit(1.0)).alias("threshold"))


def rates(labelled: DataFrame, on: Sequence[str], predicted: Column, actual: Column) -> DataFrame:
    """Counts, precision and recall (null without a case) and whether every row agrees."""
    hit = F.count_if(predicted & actual)
    return labelled.groupBy(*on).agg(
        F.count(F.lit(1)).alias("n"), ratio(hit, F.count_if(predicted)).alias("precision"), ratio(hit, F.count_if(actual)).alias("recall"), F.bool_and(predicted == actual).alias("all_agree")
    )


def regressions(base: DataFrame, now: DataFrame, on: Sequence[str], value: str = "value", slack: float = 1e-9) -> DataFrame:
    """Each metric of either run: ``regressed`` below the base by more than the slack, ``new`` and ``gone`` where one run lacks it."""
    both = base.withColumnRenamed(value, "base").join(now.withColumnRenamed(value, "now"), list(on), "full_outer")
    status = F.when(F.col("base").isNull(), "new").when(F.col("now").isNull(), "gone").when(F.col("now") < F.col("base") - slack, "regressed").otherwise("kept")
    return both.withColumn("status", status)


def readiness(rows: DataFrame) -> DataFrame:
    """Verdict of ``(key, form, hrv_rmssd, hrv_baseline)``: by form, one step more cautious where variability is suppressed."""
    good, fair, low = C.READINESS_FORM
    form = F.col("form")
    step = F.when(form > good, 0).when(form >= fair, 1).when(form >= low, 2).otherwise(3)
    usable = F.coalesce(finite(F.col("hrv_rmssd")) & finite(F.col("hrv_baseline")) & (F.col("hrv_baseline") > 0), F.lit(False))
    suppressed = usable & (F.col("hrv_rmssd") < (1 - C.READINESS_HRV_DROP) * F.col("hrv_baseline"))
    known = F.coalesce(finite(form), F.lit(False))
    names = F.array(*(F.lit(n) for n in C.READINESS_NAMES))
    verdict = F.get(names, F.least(step + suppressed.cast("int"), F.lit(3)))
    why = F.when(~known, "form_unavailable").when(suppressed, "hrv_suppressed").otherwise("form")
    return rows.select("key", F.when(known, verdict).alias("verdict"), why.alias("rationale"), (~usable).alias("hrv_unavailable"))


def sufficiency(rows: DataFrame, ref: Column) -> DataFrame:
    """Staleness of ``(key, last_day, suspect)``: a record is stale after 2 days and insufficient after 14 on a suspect
    connection; one never observed is insufficient. A day in the future has no staleness."""
    days = F.greatest(F.lit(0), F.datediff(ref, "last_day"))
    never = F.col("last_day").isNull()
    stale = F.coalesce((days > C.STALE_DAYS) & F.col("suspect"), F.lit(False))
    short = never | F.coalesce((days > C.INSUFFICIENT_DAYS) & F.col("suspect"), F.lit(False))
    fidelity = F.when(short, "degraded").when(stale, "partial").otherwise("full")
    return rows.select("key", F.when(~never, days).alias("staleness_days"), stale.alias("stale"), short.alias("insufficient"), fidelity.alias("fidelity"))


def dashboard(days: DataFrame, on: Column) -> DataFrame:
    """Today's fitness, fatigue and form of ``(key, day, load, ctl, atl, tsb)``, change over a week, and the week's load (null
    where no day is known)."""
    last = Window.partitionBy("key").orderBy("day")
    week = last.rowsBetween(-6, 0)
    ago = {f"{c}_change": F.col(c) - F.lag(c, 7).over(last) for c in ("ctl", "atl", "tsb")}
    rows = days.withColumns({**ago, "week_load": F.sum("load").over(week), "known_days": F.count("load").over(week)})
    return rows.where(F.col("day") == on).drop("load")


def coverage(inputs: dict[str, DataFrame], keys: DataFrame) -> DataFrame:
    """Which inputs each key has: ``present`` and ``missing`` sorted by name, and a status. Each frame lists keys that have it."""
    probes = None
    for name, frame in inputs.items():
        one = frame.select("key").distinct().withColumn("input", F.lit(name))
        probes = one if probes is None else probes.unionByName(one)
    # At most one row for each input and key.
    found = keys.select("key").distinct().join(probes.groupBy("key").agg(F.array_sort(F.collect_set("input")).alias("present")), "key", "left")
    present = F.coalesce("present", F.array().cast("array<string>"))
    names = F.array(*(F.lit(n) for n in sorted(inputs)))
    return found.select("key", present.alias("present"), F.array_except(names, present).alias("missing"), F.when(F.size(present) > 0, "completed").otherwise("degraded").alias("status"))


def recent_coverage(keys: DataFrame, on: Column, fitness: DataFrame, curve: DataFrame, fits: DataFrame, hrv: DataFrame, signatures: DataFrame, days: int = C.DIAGNOSIS_DAYS, least_ctl: float = C.LEAST_FITNESS) -> DataFrame:
    """``coverage`` of every key's five inputs on a day, probed over the ``days`` before it and the day itself.

    Training load needs a day of ``fitness(key, day, ctl)`` with a finite fitness of ``least_ctl`` at least, as fitness that
    merely starts from zero says nothing; the power curve any computed value of ``curve(key, day, best_w)``; critical power
    a fit of ``fits(key, cp_w)``, which come from the window's efforts; heart-rate variability a value of ``hrv(key, day, value)``
    on the day itself; the signature a threshold or critical power in the version of ``signatures(key, effective_date, ftp_w,
    cp_w)`` in force. Each probe stands alone; a value that isn't finite is none.
    """
    known = lambda c: finite(F.col(c))
    recent = F.col("day").between(F.date_sub(on, days), on)
    in_force = signatures.where(F.col("effective_date") <= on).groupBy("key").agg(F.max_by(F.struct("ftp_w", "cp_w"), "effective_date").alias("v")).select("key", "v.*")
    return coverage(
        {
            "training_load": fitness.where(recent & known("ctl") & (F.col("ctl") >= least_ctl)), "power_curve": curve.where(recent & known("best_w")), "critical_power": fits.where(known("cp_w")),
            "hrv": hrv.where((F.col("day") == on) & known("value")), "signature": in_force.where(known("ftp_w") | known("cp_w")),
        },
        keys,
    )


def coverage_of(flags: DataFrame, inputs: Sequence[str]) -> DataFrame:
    """``coverage`` from one row for each key with a flag for each input; a null flag counts as missing."""
    names = sorted(inputs)
    present = F.array_compact(F.array(*(F.when(F.col(n), F.lit(n)) for n in names)))
    missing = F.array_except(F.array(*(F.lit(n) for n in names)), present)
    return flags.select("key", present.alias("present"), missing.alias("missing"), F.when(F.size(present) > 0, "completed").otherwise("degraded").alias("status"))


def export_rows(tables: dict[str, DataFrame]) -> DataFrame:
    """``(table, row)`` with each row as JSON, parents first: the lines of a full export."""
    out = None
    for name, frame in tables.items():
        one = frame.select(F.lit(name).alias("table"), F.to_json(F.struct("*")).alias("row"))
        out = one if out is None else out.unionByName(one)
    return out


def pass_rates(trials: DataFrame, on: Sequence[str]) -> DataFrame:
    """Trials ``(*on, case_id, passed)`` of each suite: cases, trials, share of cases that pass in all their trials (pass^k),
    share of trials passed, and whether everything passed."""
    per_case = trials.groupBy(*on, "case_id").agg(F.bool_and("passed").alias("all_"), F.count(F.lit(1)).alias("n_"), F.count_if("passed").alias("ok_"))
    share = lambda a, b: ratio(a, b)
    return per_case.groupBy(*on).agg(
        F.count(F.lit(1)).alias("cases"), F.sum("n_").alias("trials"), share(F.count_if("all_"), F.count(F.lit(1))).alias("pass_all"), share(F.sum("ok_"), F.sum("n_")).alias("pass_rate"), F.bool_and("all_").alias("passed")
    )


def readiness_consistent(rows: DataFrame) -> DataFrame:
    """Whether a given ``verdict`` is the one that the row's form and variability lead to; false where there is none."""
    want = readiness(rows).select("key", F.col("verdict").alias("want"))
    return rows.join(want, "key").select("key", F.coalesce(F.col("verdict") == F.col("want"), F.lit(False)).alias("consistent"))


def write_artifact(rows: DataFrame, path: str, kind: str, oldest_first: str) -> None:
    """An export of rows in order of ``oldest_first``: ``json`` (a row a line) or ``csv`` with a header, gzipped."""
    if kind not in ("json", "csv"):
        raise ValueError(f"not a kind of export: {kind}")
    ordered = rows.orderBy(oldest_first, *(c for c, t in rows.dtypes if c != oldest_first and not t.startswith(("map", "array", "struct"))))
    writer = ordered.write.mode("errorifexists").option("compression", "gzip")
    writer.json(path) if kind == "json" else writer.option("header", True).csv(path)
