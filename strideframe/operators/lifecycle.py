"""Records over their lifetime: identity, never-regress writes, erasure, retention, exports, run counters."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strideframe.functions import constants as C
from strideframe.operators.resolve import tier_rank


#: Parts that a group is dealt into where it is cut down before it meets in one place.
SALTS = 64


def identities(recordings: DataFrame) -> DataFrame:
    """Adds ``session_id`` to ``(athlete, sport, id, start, duration_s, fingerprint)``: the id of the recording that opened the session.

    Recordings come in order of (start, id). Each joins the first open session of its athlete and sport whose opener has
    its fingerprint, or starts within 120 s and lasts as long but for the larger of 60 s and 5 %; else it opens one. The
    order matters, so a chain of starts 100 s apart is not one session. Starts further apart than the reach of a match
    can't meet: runs between such pauses are worked in order, as streams of rows with the openers within reach. Recordings are
    shuffled twice, by athlete and by the recording that they follow.
    """
    order = Window.partitionBy("athlete", "sport").orderBy("start", "id")
    # Equal fingerprints meet at any distance: the earliest of each print stands for it. Only printed recordings are shuffled for that.
    first = F.min_by("id", F.struct("start", "id")).over(Window.partitionBy("athlete", "sport", "fingerprint"))
    plain = recordings.where("fingerprint IS NULL").withColumn("lead_", F.col("id"))
    printed = recordings.where("fingerprint IS NOT NULL").withColumn("lead_", F.coalesce(first, F.col("id")))
    heads = plain.unionByName(printed).where("lead_ = id")
    pause = F.coalesce(F.unix_timestamp("start") - F.lag(F.unix_timestamp("start")).over(order) > C.MATCH_START_S, F.lit(True))
    runs = heads.withColumn("pause_", pause).withColumn("alone_", F.col("pause_") & F.lead("pause_", 1, True).over(order))
    runs = runs.select("*", (F.unix_micros("start") / 1e6).alias("s_"), F.col("duration_s").cast("double").alias("d_"))

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Rows come run by run in order; a run may go on in the next batch.
        opened = deque()
        for batch in batches:
            found = batch["id"].to_pylist()
            go = np.flatnonzero(~batch["alone_"].to_numpy(zero_copy_only=False))
            pauses, starts, durations = (batch[c].to_numpy(zero_copy_only=False)[go].tolist() for c in ("pause_", "s_", "d_"))
            for n, paused, start, duration in zip(go.tolist(), pauses, starts, durations):
                if paused:
                    opened.clear()
                # Openers that no later recording can reach go, so that a run of any length is carried in a few.
                while opened and start - opened[0][0] > C.MATCH_START_S:
                    opened.popleft()
                for at, lasting, ident in opened:
                    if abs(start - at) <= C.MATCH_START_S and abs(duration - lasting) <= max(C.MATCH_DURATION_S, C.MATCH_DURATION_SHARE * max(lasting, duration)):
                        found[n] = ident
                        break
                else:
                    opened.append((start, duration, found[n]))
            yield batch.select(names).append_column("session_id", pa.array(found, batch["id"].type))

    names = [*recordings.columns, "lead_"]
    matched = runs.mapInArrow(match, T.StructType([*heads.select(names).schema.fields, T.StructField("session_id", recordings.schema["id"].dataType)]))
    rows = matched.unionByName(printed.where("lead_ <> id OR id IS NULL").withColumn("session_id", F.lit(None).cast(recordings.schema["id"].dataType)))
    # Rows of an athlete and sport that repeat an id are one recording, and those of a print follow its first.
    named = F.min("session_id").over(Window.partitionBy("athlete", "sport", "lead_"))
    return rows.withColumn("session_id", named).where("lead_ IS NOT NULL").drop("lead_")


def kept_channels(stored: DataFrame, incoming: DataFrame, on: Sequence[str]) -> DataFrame:
    """Channels after a write that never regresses: the incoming one counts unless its tier is worse than the stored one's."""
    both = stored.select(*on, F.struct(*(c for c in stored.columns if c not in on)).alias("old")).join(incoming.select(*on, F.struct(*(c for c in incoming.columns if c not in on)).alias("new")), list(on), "full_outer")
    keep = F.col("new").isNull() | (F.col("old").isNotNull() & (tier_rank(F.col("new.tier")) > tier_rank(F.col("old.tier"))))
    return both.select(*on, F.when(keep, F.col("old")).otherwise(F.col("new")).alias("w")).select(*on, "w.*")


def erased(tables: dict[str, DataFrame], parents: dict[str, tuple[str, str, str]], scope: DataFrame, key: str) -> dict[str, tuple[DataFrame, DataFrame]]:
    """For each table the rows that stay and those that go when the keys of ``scope`` are erased.

    A table without an entry in ``parents`` carries ``key`` itself; others name (parent, own column, parent's column)
    and lose the rows whose parent goes. Tables are given parents first.
    """
    gone: dict[str, DataFrame] = {}
    out = {}
    for name, frame in tables.items():
        if name in parents:
            parent, own, theirs = parents[name]
            ids, on = gone[parent].select(F.col(theirs).alias(own)).distinct(), own
        else:
            ids, on = scope.select(key).distinct(), key
        gone[name] = frame.join(ids, on, "left_semi")
        out[name] = (frame.join(ids, on, "left_anti"), gone[name])
    return out


def purged(rows: DataFrame, created: str, now: Column, days: int) -> DataFrame:
    """Rows that are kept: younger than ``days``; all where days is 0 or less."""
    return rows if days <= 0 else rows.where(F.col(created) >= now - F.expr(f"interval {days} days"))


def recent_summary(rows: DataFrame, on: Sequence[str], value: str, order: Sequence[Column], keep: int = 1024) -> DataFrame:
    """Count and sum of all observations, and nearest-rank median and 95th percentile of the last ``keep`` of each group.

    A group is dealt into SALTS parts, each of which is cut to its last ``keep`` before the parts meet. ``order`` must be
    total within a group.
    """
    whole = rows.groupBy(*on).agg(F.count(value).alias("n"), F.sum(value).alias("total"))
    dealt = rows.withColumn("salt_", F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)))
    place = lambda *keys: F.row_number().over(Window.partitionBy(*on, *keys).orderBy(*order))
    few = dealt.withColumn("rn_", place("salt_")).where(F.col("rn_") <= keep)
    last = few.withColumn("rn_", place()).where(F.col("rn_") <= keep)
    rank = lambda q: F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY {value})")
    return whole.join(last.groupBy(*on).agg(rank(0.5).alias("p50"), rank(0.95).alias("p95")), list(on))


def metric_lines(summary: DataFrame, name: str, label: str) -> DataFrame:
    """Text exposition of a summary: quantile lines, and its sum and count over all observations."""
    tag = lambda extra: F.concat(F.lit(f'{{{label}="'), F.col(label), F.lit(f'"{extra}}}'))
    lines = F.array(
        F.concat(F.lit(name), tag(',quantile="0.5"'), F.lit(" "), F.format_string("%.3f", "p50")), F.concat(F.lit(name), tag(',quantile="0.95"'), F.lit(" "), F.format_string("%.3f", "p95")),
        F.concat(F.lit(name + "_sum"), tag(""), F.lit(" "), F.format_string("%.3f", "total")),
        F.concat(F.lit(name + "_count"), tag(""), F.lit(" "), F.col("n").cast("string")),
    )
    return summary.select(F.explode(lines).alias("line"))


def token_bucket(requests: DataFrame, on: Sequence[str], at: str, rate: float, burst: float) -> DataFrame:
    """``admitted`` for each request of a bucket that refills at ``rate`` a second up to ``burst``; requests in order of (at, id).

    The state is a fold over a bucket's requests, which stream through a task in order and are never held. A pause in
    which the bucket refills from empty forgets what was before it, so a bucket is cut there and its pieces are dealt out.
    """
    full = Window.partitionBy(*on).orderBy(at, "id")
    rested = F.coalesce(F.col(at) - F.lag(at).over(full) >= burst / rate, F.lit(True))
    pieces = requests.select(*on, "id", at).withColumn("piece_", F.sum(rested.cast("long")).over(full.rowsBetween(Window.unboundedPreceding, 0)))
    keys = [*on, "piece_"]

    def admit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        piece, level, before = None, burst, 0.0
        for pdf in frames:
            out = []
            for key, now in zip(pdf[keys].itertuples(index=False, name=None), pdf[at]):
                level = burst if key != piece else min(burst, level + (now - before) * rate)
                piece, before = key, now
                out.append(level >= 1)
                level -= level >= 1
            yield pdf.drop(columns="piece_").assign(admitted=out)

    schema = requests.select(*on, "id", at).schema.add("admitted", "boolean")
    return pieces.repartition(*keys).sortWithinPartitions(*keys, at, "id").mapInPandas(admit, schema)


def greedy_context(records: DataFrame, on: Sequence[str], budget: int) -> DataFrame:
    """Records taken by relevance while they fit a token budget; one too large is passed over and smaller ones are still tried.

    ``(id, relevance, tokens)``; ties go to the smaller id. Records without tokens always fit and meet in no group. Of those of
    one size only the best ``budget / size`` can ever fit, so the others are left out before a group's records meet in a
    task, where no more than the budget's share of each size is left.
    """
    rows = records.select(*on, "id", "relevance", "tokens")
    rank = F.row_number().over(Window.partitionBy(*on, "tokens").orderBy(F.desc("relevance"), "id"))
    top = rows.where(F.col("tokens").between(1, budget)).withColumn("rank_", rank).where(F.col("rank_") * F.col("tokens") <= budget)

    def pick(frames: pd.DataFrame) -> pd.DataFrame:
        frames = frames.sort_values(["relevance", "id"], ascending=[False, True])
        left, keep = budget, []
        for tokens in frames["tokens"]:
            keep.append(tokens <= left)
            left -= tokens if tokens <= left else 0
        return frames[keep]

    return top.select(rows.columns).groupBy(*on).applyInPandas(pick, rows.schema).unionByName(rows.where("tokens <= 0"))


def ensured(stored: DataFrame, wanted: DataFrame, on: Sequence[str]) -> DataFrame:
    """``stored`` and the rows of ``wanted`` whose key it lacks, the least of a key's once; what is stored is never changed."""
    rest = [c for c in wanted.columns if c not in on]
    once = wanted.groupBy(*on).agg(F.min(F.struct(*rest)).alias("r")).select(*on, "r.*")
    return stored.unionByName(once.join(stored.select(*on), list(on), "left_anti"))


def owned_by_either(children: DataFrame, branches: Sequence[tuple[DataFrame, str, str, str]]) -> DataFrame:
    """Children that belong to any of several kinds of parents: ``branches`` of (parents, kind, parent's key, child's key);
    a child's ``parent_kind`` says to which kind its key refers. Each child comes once."""
    found = None
    for parents, kind, theirs, own in branches:
        one = children.where(F.col("parent_kind") == kind).join(parents.select(F.col(theirs).alias(own)).distinct(), own, "left_semi")
        found = one if found is None else found.unionByName(one)
    return found.distinct()


def table_order(parents: dict[str, Sequence[str]], first: Sequence[str] = (), delete: bool = False) -> list[str]:
    """Tables with every parent before its children, by name where that leaves a choice; reversed to delete, with ``first``
    hoisted to the front then. ValueError for tables that depend on each other in a ring."""
    left, out = {t: set(p) & set(parents) for t, p in parents.items()}, []
    while left:
        ready = sorted(t for t, p in left.items() if not p)
        if not ready:
            raise ValueError(f"tables in a ring: {sorted(left)}")
        out.append(ready[0])
        del left[ready[0]]
        for p in left.values():
            p.discard(ready[0])
    if not delete:
        return out
    return [t for t in first if t in parents] + [t for t in reversed(out) if t not in first]
