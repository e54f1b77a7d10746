"""Fitness and fatigue of a stream of loads, in keyed state that lives on between batches and runs.

For each key a value holds its fitness as of its latest day, and another the records of late, packed in columns, so that
one that comes again counts once and one that comes changed is corrected. A record that can't be used becomes a row of its own with its
reason and takes no other with it. State is kept in RocksDB, which the operator needs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from strideframe.functions import constants as C

#: What such a stream needs: state that can hold timers, and no batches without data, of which processing time
#: would otherwise make one after the other, so that a stream that is to end never does.
NEEDS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}
OUT = "key long, kind string, id long, day int, ctl double, atl double, reason string"
DAY_MS = 86_400_000


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """Streams that start inside run with the settings of NEEDS; the session's own come back behind."""
    before = {k: spark.conf.get(k, None) for k in NEEDS}
    try:
        for k, v in NEEDS.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


class FitnessProcessor(StatefulProcessor):
    """``(id long, key long, day int, load string)`` in, rows of OUT out.

    Kinds of rows: ``fitness``, the key's state after a batch; ``rejected``, a record without a usable load or day;
    ``quiet``, the state of a key that has had no record for ``quiet_ms`` of processing time, told with the next batch. Records are known again for
    ``known_ms`` after the last one of their key; a load decays from its day on, whenever it comes.
    """

    def __init__(self, known_ms: int = 60 * DAY_MS, quiet_ms: int | None = None):
        self.known_ms, self.quiet_ms = known_ms, quiet_ms
        self.keep = {"ctl": math.exp(-1 / C.CTL_DAYS), "atl": math.exp(-1 / C.ATL_DAYS)}

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.form = handle.getValueState("form", "day int, ctl double, atl double")
        # One value for all records of a key: a list is read and written record by record.
        self.recent = handle.getValueState("recent", "id binary, day binary, load binary", ttlDurationMs=self.known_ms)

    def handleInitialState(self, key: tuple, initialState: pd.DataFrame, timerValues) -> None:
        seed = initialState.sort_values("day").iloc[-1]
        self.form.update((int(seed["day"]), float(seed["ctl"]), float(seed["atl"])))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frames = list(rows)
        batch = frames[0] if len(frames) == 1 else pd.concat(frames)
        ids, days, given = (batch[c].to_numpy() for c in ("id", "day", "load"))
        load = pd.to_numeric(batch["load"], errors="coerce").to_numpy(float)
        no_id, no_day = pd.isna(ids), pd.isna(days)
        usable = np.isfinite(load) & ~no_day & ~no_id
        told = []
        if not usable.all():
            bad = np.flatnonzero(~usable)
            absent = no_id | no_day | pd.isna(given)
            told += [("rejected", None if no_id[n] else int(ids[n]), None if no_day[n] else int(days[n]), None, None, "missing_required_input" if absent[n] else "out_of_domain") for n in bad]
        if usable.any():
            told.append(("fitness", None, *self._advance(ids[usable].astype(np.int64), days[usable].astype(np.int32), load[usable]), None))
            if self.quiet_ms is not None:
                for timer in list(self.handle.listTimers()):
                    self.handle.deleteTimer(timer)
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.quiet_ms)
        yield self._rows(key, told)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        day, ctl, atl = self.form.get()
        yield self._rows(key, [("quiet", None, day, ctl, atl, None)])

    def close(self) -> None:
        pass

    def _advance(self, ids: np.ndarray, days: np.ndarray, loads: np.ndarray) -> tuple[int, float, float]:
        last_of = {i: n for n, i in enumerate(ids.tolist())}
        once = np.fromiter(last_of.values(), np.int64, len(last_of))
        ids, days, loads = ids[once], days[once], loads[once]
        held = self.recent.get() or (b"", b"", b"")
        old_ids, old_days, old_loads = (np.frombuffer(bytes(b), t) for b, t in zip(held, (np.int64, np.int32, np.float64)))
        again = np.isin(old_ids, ids)  # what a record gave before is taken back
        self.recent.update(tuple(np.concatenate([old[~again], new]).tobytes() for old, new in ((old_ids, ids), (old_days, days), (old_loads, loads))))
        days, loads = np.concatenate([days, old_days[again]]), np.concatenate([loads, -old_loads[again]])
        day, ctl, atl = self.form.get() or (int(days.min()), 0.0, 0.0)
        last = max(day, int(days.max()))
        ctl, atl = (old * k ** (last - day) + float(((1 - k) * loads * k ** (last - days)).sum()) for old, k in ((ctl, self.keep["ctl"]), (atl, self.keep["atl"])))
        self.form.update((last, ctl, atl))
        return last, ctl, atl

    @staticmethod
    def _rows(key: tuple, told: list[tuple]) -> pd.DataFrame:
        kind, ident, day, ctl, atl, reason = zip(*told)
        out = {"key": [key[0]] * len(told), "kind": kind, "id": pd.array(ident, "Int64"), "day": pd.array(day, "Int32"), "ctl": np.array(ctl, float), "atl": np.array(atl, float), "reason": np.array(reason, object)}
        return pd.DataFrame(out)


def fitness_states(records: DataFrame, seeds: DataFrame | None = None, known_ms: int = 60 * DAY_MS, quiet_ms: int | None = None) -> DataFrame:
    """The stream of OUT rows of a stream of ``records(id, key, day, load)``; ``seeds(key, day, ctl, atl)`` is the state that
    keys start from."""
    rows = records.select(F.col("id").cast("long").alias("id"), F.col("key").cast("long").alias("key"), F.col("day").cast("int").alias("day"), F.col("load").cast("string").alias("load"))
    start = None if seeds is None else seeds.select(F.col("key").cast("long").alias("key"), F.col("day").cast("int").alias("day"), F.col("ctl").cast("double").alias("ctl"), F.col("atl").cast("double").alias("atl")).groupBy("key")
    return rows.groupBy("key").transformWithStateInPandas(statefulProcessor=FitnessProcessor(known_ms, quiet_ms), outputStructType=OUT, outputMode="update", timeMode="processingTime", initialState=start)


def land_states(states: DataFrame, path: str, checkpoint: str, until_empty: bool = True):
    """Write a stream of states with a folder for each micro-batch and, in it, each kind of row, in one pass; a batch that
    runs again replaces its folder. Rejected records are in ``kind=rejected``."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").partitionBy("kind").parquet(f"{path}/batch={batch_id}")

    with keyed_state(states.sparkSession):
        writer = states.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if until_empty else writer).start()


def landed(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """The landed rows of a kind, with their batch; an empty table where none has landed."""
    schema = ", ".join(c for c in OUT.split(", ") if c != "kind string") + ", batch long, kind string"
    return spark.read.schema(schema).parquet(path).where(F.col("kind") == kind).drop("kind")


def current_fitness(spark: SparkSession, path: str) -> DataFrame:
    """``(key, day, ctl, atl)`` of each key's last batch."""
    rows = landed(spark, path, "fitness")
    return rows.groupBy("key").agg(F.max_by(F.struct("day", "ctl", "atl"), "batch").alias("s")).select("key", "s.*")
