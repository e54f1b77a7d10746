"""Adapters of sources: what each can deliver, and the table of those that may be used.

An adapter reads its source as a DataFrame of candidates. Packages offer adapters as entry points of GROUP; one that
doesn't conform, or whose key is taken, is refused with its reason and the others stay.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from importlib.metadata import entry_points

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

GROUP = "strideframe.adapters"
WRITABLE = ("activity", "daily_wellness")
PHASES = {"poll": ("discover", "fetch", "map"), "file": ("map",)}


@dataclass(frozen=True)
class Adapter:
    """``read(spark, **options)`` gives candidates with a column ``gbo_type``."""

    key: str
    sync_mode: str
    declared: tuple[str, ...]
    phases: tuple[str, ...]
    read: Callable[..., DataFrame]


def nonconformity(adapter: object) -> str | None:
    """Why an object can't be used as an adapter, None if it can."""
    if not isinstance(adapter, Adapter):
        return "not an adapter"
    if not adapter.declared:
        return "nothing declared"
    if unknown := sorted(set(adapter.declared) - set(WRITABLE)):
        return f"not writable: {', '.join(unknown)}"
    if adapter.sync_mode not in PHASES:
        return f"unknown sync mode: {adapter.sync_mode}"
    if lacking := [p for p in PHASES[adapter.sync_mode] if p not in adapter.phases]:
        return f"phases missing: {', '.join(lacking)}"
    return None


@dataclass
class Registry:
    adapters: dict[str, Adapter] = field(default_factory=dict)
    refused: dict[str, str] = field(default_factory=dict)

    def add(self, name: str, adapter: object) -> None:
        why = nonconformity(adapter)
        if why is None and adapter.key in self.adapters:
            why = f"key is taken: {adapter.key}"
        if why is None:
            self.adapters[adapter.key] = adapter
        else:
            self.refused[name] = why

    def candidates(self, spark: SparkSession, key: str, **options) -> DataFrame:
        """The source's candidates. A batch that holds a record type the adapter hasn't declared fails whole."""
        adapter = self.adapters[key]
        rows = adapter.read(spark, **options)
        declared = F.coalesce(F.col("gbo_type").isin(*adapter.declared), F.lit(False))
        refusal = F.raise_error(F.concat(F.lit(f"schema_mismatch: {key} hasn't declared "), F.coalesce("gbo_type", F.lit("null"))))
        return rows.withColumn("gbo_type", F.when(declared, F.col("gbo_type")).otherwise(refusal.cast("string")))


def load_registry(found: Iterable | None = None) -> Registry:
    """The adapters that installed packages offer, in order of their names; one that can't be loaded is refused."""
    registry = Registry()
    for point in sorted(entry_points(group=GROUP) if found is None else found, key=lambda p: p.name):
        try:
            registry.add(point.name, point.load())
        except Exception as e:  # whatever a package's own code raises, it must not take the others with it
            registry.refused[point.name] = f"{type(e).__name__}: {e}"
    return registry
