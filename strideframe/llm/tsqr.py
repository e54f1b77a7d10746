"""Embedding whitening by a tall and skinny QR.

Rows are fixed-point integers, so their sums are exact, and each row is centred by them. A task takes the QR of the rows
of its partition block by block and gives one R; R factors are merged in a tree; the singular values and right vectors
of the last R are those of all centred rows. They whiten without a covariance matrix ever being formed.

Vectors of different widths are separate populations: everything is keyed by the width.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strideframe.llm.common import saved

SCALE = 256
COMPONENTS = 4
#: R factors that one task of the tree merges.
MERGE = 8
#: Entries of the rows that a task factorises or whitens at a time.
BLOCK = 1 << 20
#: Sums and right vectors of so many dimensions are sent to tasks together; wider sets of widths go in turns.
SENT_DIMENSIONS = 1 << 20
LIMIT = 2**63


def fixed_point(values: np.ndarray) -> np.ndarray:
    """floor(256 c) as 64-bit integers; beyond their range the end of it."""
    with np.errstate(over="ignore"):
        scaled = np.floor(values * SCALE)
    inside = np.abs(scaled) < LIMIT
    return np.where(inside, np.where(inside, scaled, 0).astype(np.int64), np.where(scaled > 0, LIMIT - 1, -LIMIT))


def sound_rows(vectors: DataFrame) -> DataFrame:
    """``(vec_id, width, x)``: x has the row's integers as little-endian bytes. Rows whose vector is null or empty, or has a
    null or non-finite entry, are left out."""

    def fixed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("embedding")
            widths = np.array([n or 0 for n in lists.value_lengths().to_pylist()], np.int64)
            values = lists.flatten().to_numpy(zero_copy_only=False).astype(float)
            starts = np.cumsum(widths) - widths
            for width in np.unique(widths[widths > 0]).tolist():
                at = np.nonzero(widths == width)[0]
                rows = values[starts[at][:, None] + np.arange(width)]
                sound = np.isfinite(rows).all(axis=1)
                x = fixed_point(rows[sound]).astype("<i8")
                yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(pa.array(at[sound])), pa.array(np.full(len(x), width, np.int32)), pa.array([r.tobytes() for r in x], pa.binary())], names=["vec_id", "width", "x"])

    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return rows.mapInArrow(fixed, "vec_id long, width int, x binary")


def blocks(batches: Iterator[pa.RecordBatch], of: set[int] | dict) -> Iterator[tuple[int, pa.RecordBatch, np.ndarray]]:
    """Width, rows and integer matrix of parts of a task's rows, for the widths in ``of``."""
    for batch in batches:
        widths = batch.column("width").to_numpy()
        for width in np.unique(widths).tolist():
            if width in of:
                rows = batch.filter(pa.array(widths == width))
                step = max(1, BLOCK // width)
                for i in range(0, rows.num_rows, step):
                    part = rows.slice(i, step)
                    yield width, part, np.frombuffer(b"".join(part.column("x").to_pylist()), "<i8").reshape(-1, width)


def moments(fit: DataFrame) -> DataFrame:
    """``(width, n, sums array<decimal(38,0)>)``, exact; a row for each width."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for width, _, x in blocks([batch], set(batch.column("width").to_pylist())):
                small = np.abs(x.astype(float)).max(initial=0) * len(x) < LIMIT / 4
                sums = x.sum(axis=0).tolist() if small else x.astype(object).sum(axis=0).tolist()
                yield pa.RecordBatch.from_arrays([pa.array([width] * width, pa.int32()), pa.array(range(width), pa.int32()), pa.array([len(x)] * width, pa.int64()), pa.array(list(map(str, sums)))], names=["width", "dim", "n", "s"])

    parts = fit.select("width", "x").mapInArrow(summed, "width int, dim int, n long, s string")
    dims = parts.groupBy("width", "dim").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).cast("decimal(38,0)").alias("s"))
    return dims.groupBy("width").agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("dim", "s"))).alias("by_dim")).select("width", "n", F.col("by_dim.s").alias("sums"))


class Centre:
    """A population's size and sums; centred rows to double precision, and exact deviations."""

    def __init__(self, n: int, sums: list[int]):
        self.n, self.exact = n, np.array(sums, object)
        self.fits = np.abs(self.exact).max(initial=0) < LIMIT // 4
        self.sums = self.exact.astype(np.int64) if self.fits else self.exact

    def differences(self, x: np.ndarray) -> np.ndarray:
        """n x - S, exactly."""
        if self.fits and int(np.abs(x.astype(float)).max(initial=0)) * self.n < LIMIT // 4:
            return self.n * x - self.sums
        return self.n * x.astype(object) - self.exact

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (self.differences(x) / self.n).astype(float)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """The sum of squares of n x - S; None where it is no 64-bit integer."""
        d = self.differences(x)
        if d.dtype == object or float(np.abs(d).max(initial=0)) ** 2 * d.shape[1] >= LIMIT / 2:
            return [v if v < LIMIT else None for v in (d.astype(object) ** 2).sum(axis=1).tolist()]
        return (d * d).sum(axis=1).tolist()


def r_of(rows: np.ndarray) -> np.ndarray:
    return np.linalg.qr(rows, mode="r")


R_FACTOR = "width int, node long, r binary"


def r_factors(fit: DataFrame, centres: dict[int, Centre]) -> DataFrame:
    """``(width, node, r)``: one R of each partition's centred rows for each width; node is the partition's number."""

    def factorised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        found: dict[int, np.ndarray] = {}
        for width, _, x in blocks(batches, centres):
            found[width] = r_of(np.vstack([found.get(width, np.zeros((0, width))), centres[width].centred(x)]))
        node = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_pydict({"width": list(found), "node": [node] * len(found), "r": [r.tobytes() for r in found.values()]}, schema=pa.schema([("width", pa.int32()), ("node", pa.int64()), ("r", pa.binary())]))

    return fit.select("width", "x").mapInArrow(factorised, R_FACTOR)


def merged(factors: DataFrame) -> DataFrame:
    """One R for each width: MERGE neighbours at a time, as many rounds as that takes."""

    def merge(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        stacked = np.vstack([np.frombuffer(r).reshape(-1, key[0]) for r in rows.sort_values("node")["r"]])
        return pd.DataFrame({"width": key[0], "node": [key[1]], "r": [r_of(stacked).tobytes()]})

    nodes = (factors.agg(F.max("node")).first()[0] or 0) + 1
    while nodes > 1:
        factors = factors.groupBy("width", F.floor(F.col("node") / MERGE).alias("up")).applyInPandas(merge, R_FACTOR)
        nodes = math.ceil(nodes / MERGE)
    return factors


class Whitener:
    """Unit eigenvectors (rows) and eigenvalues of a covariance, from R, for the components that have variance."""

    def __init__(self, centre: Centre, r: np.ndarray, most: int):
        _, s, right = np.linalg.svd(r, full_matrices=False)
        e = s * s / centre.n
        rank = int((s > s[:1].max(initial=0) * max(r.shape) * np.finfo(float).eps).sum())
        self.centre, self.vectors, self.values, self.trace = centre, right[: min(most, rank)], e[: min(most, rank)], float(e.sum())

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return self.centre.centred(x) @ self.vectors.T / np.sqrt(self.values)


def identity_errors(fit: DataFrame, models: dict[int, Whitener]) -> dict[int, float]:
    """For each width the largest entry of the covariance of its whitened fit rows, less the identity."""

    def multiplied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for width, _, x in blocks(batches, models):
            w = models[width](x)
            w = np.column_stack([w, np.ones(len(w))])  # means come along
            i, j = np.triu_indices(w.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array([width] * len(i), pa.int32()), pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array((w.T @ w)[i, j])], names=["width", "i", "j", "v"])

    sums = fit.select("width", "x").mapInArrow(multiplied, "width int, i int, j int, v double").groupBy("width", "i", "j").agg(F.sum("v").alias("v"))
    found = {(r.width, r.i, r.j): r.v for r in sums.collect()}  # a few numbers for each width
    errors = {}
    for width, model in models.items():
        k, n = len(model.values), model.centre.n
        mean = [found[width, i, k] / n for i in range(k)] if k else []
        errors[width] = max((abs(found[width, i, j] / n - mean[i] * mean[j] - (i == j)) for i in range(k) for j in range(i, k)), default=0.0)
    return errors


def _turns(widths: list[tuple[int, int]]) -> Iterator[list[int]]:
    """Widths in groups of at most SENT_DIMENSIONS dimensions, a wider one by itself."""
    turn, held = [], 0
    for width, _ in sorted(widths):
        if turn and held + width > SENT_DIMENSIONS:
            yield turn
            turn, held = [], 0
        turn.append(width)
        held += width
    if turn:
        yield turn


def _fitted(fit: DataFrame, known: DataFrame, widths: list[int], most: int) -> dict[int, Whitener]:
    centres = {r.width: Centre(r.n, [int(s) for s in r.sums]) for r in known.where(F.col("width").isin(widths)).collect()}
    last = merged(saved(r_factors(fit, centres), "r-factors")).collect()  # one for each of these widths
    return {r.width: Whitener(centres[r.width], np.frombuffer(r.r).reshape(-1, r.width), most) for r in last}


OUT = {"vec_id": "long", "component": "int", "n": "long", "deviation": "long", "whitened": "double", "explained": "double", "identity_error": "double"}


def whitened(vectors: DataFrame, most: int = COMPONENTS) -> DataFrame:
    """``(vec_id, component, n, deviation, whitened, explained, identity_error)`` for each sound row of
    ``vectors(vec_id, embedding)`` and each of its first ``most`` components.

    Rows whose vector is null, empty, or holds a null or non-finite entry give nothing. Repeated rows and null vec_ids are
    whitened each; a vector counts once in the fit, however often it occurs. Each width is fitted by itself. Integers
    beyond 64 bits stay at the end of that range; a deviation that doesn't fit is null. A direction without variance is
    no component, so that a population of one vector gives no rows. Eigenvectors of equal eigenvalues are any basis of
    their space. Other columns change nothing.
    """
    rows = sound_rows(vectors)
    fit = saved(rows.select("width", "x").distinct(), "fit-vectors")
    known = saved(moments(fit), "moments")
    out = None
    for widths in _turns([(r.width, r.n) for r in known.select("width", "n").collect()]):
        models = _fitted(fit, known, widths, most)
        errors = identity_errors(fit, models)

        def applied(batches: Iterator[pa.RecordBatch], models=models, errors=errors) -> Iterator[pa.RecordBatch]:
            for width, part, x in blocks(batches, models):
                model = models[width]
                k, m = len(model.values), len(x)
                each = np.repeat(np.arange(m), k)
                columns = [
                    part.column("vec_id").take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, model.centre.n)), pa.array(model.centre.deviations(x), pa.int64()).take(pa.array(each)),
                    pa.array(model(x).ravel()), pa.array(np.tile(model.values / model.trace, m)), pa.array(np.full(m * k, errors[width])),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=list(OUT))

        part = rows.mapInArrow(applied, ", ".join(f"{c} {t}" for c, t in OUT.items()))
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = rows.sparkSession.createDataFrame([], ", ".join(f"{c} {t}" for c, t in OUT.items()))
    return out
