"""Near copies by exact Jaccard similarity of five-word shingles: at least 0.8 links two texts.

Candidates come from MinHash bands: texts that agree in all ROWS values of one of BANDS bands share a bucket. A pair of
similarity s shares one with probability 1 - (1 - s**ROWS)**BANDS, 0.9999 at s = 0.8 and more above. Each candidate is
confirmed on the whole shingle sets. Equal sets are one unit, named by its hash.

Within a bucket every unit first meets the bucket's least. Then each unit that isn't like the least meets all others of
the bucket, so that any two of them are compared or both like the least. What meets is laid out in tiles: a task holds
a bounded part of a bucket's units and streams the units that ask against them; the numbers of common shingles are one
matrix product. A tile returns a spanning forest of its links, not its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strideframe.llm.common import as_bytes, saved, slices
from strideframe.llm.components import components, spanning_forest

SHINGLE = 5
BANDS, ROWS = 30, 6
#: A tile holds about so many units, and about so many bytes of their sets.
TILE_UNITS, TILE_BYTES = 1_024, 32 << 20
#: Units asked at a time, and shingles of one matrix product.
ASKED, COLUMNS = 256, 4_096
DEALS = 64
STEP = 2048
SEED = 42
_UPPER = bytes(range(ord("A"), ord("Z") + 1))
_LOWER_CASE = bytes.maketrans(_UPPER, _UPPER.lower())
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_DRAWS = np.random.default_rng(SEED).integers(0, 2**64, BANDS * ROWS, np.uint64) | np.uint64(1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: bytes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles; a text of fewer words is one shingle, without words none."""
    w = text.translate(_LOWER_CASE).split()
    h = np.fromiter((xxhash.xxh64_intdigest(x, SEED) for x in w), np.uint64, len(w))
    n = min(SHINGLE, len(w))
    out = np.full(len(w) - n + 1 if n else 0, n, np.uint64)
    for i in range(n):
        out = _mixed(out * _FACTOR + h[i : i + len(out)])
    return np.unique(out)


def key_of(shingles: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(shingles.tobytes(), SEED)


def bands(shingles: np.ndarray) -> np.ndarray:
    """One 64-bit bucket for each band; none for an empty set."""
    if not len(shingles):
        return np.empty(0, np.uint64)
    least = np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
    for start in range(0, len(shingles), STEP):
        np.minimum(least, (shingles[None, start : start + STEP] * _DRAWS[:, None]).min(1), out=least)
    out = np.arange(BANDS, dtype=np.uint64)
    for column in least.reshape(BANDS, ROWS).T:
        out = _mixed(out * _FACTOR + column)
    return out


def alike(one: list[np.ndarray], two: list[np.ndarray]) -> np.ndarray:
    """Which sets of ``one`` have a similarity of 0.8 or more to which of ``two``."""
    size = [np.array([len(x) for x in side]) for side in (one, two)]
    words, column = np.unique(np.concatenate(one), return_inverse=True)
    other = np.concatenate(two)
    at = np.minimum(np.searchsorted(words, other), len(words) - 1)
    hit = words[at] == other
    rows = np.repeat(np.arange(len(one)), size[0]), np.repeat(np.arange(len(two)), size[1])[hit]
    used, at = np.unique(at[hit], return_inverse=True)
    place = np.full(len(words), -1)
    place[used] = np.arange(len(used))
    column = place[column]
    common = np.zeros((len(one), len(two)), np.float32)
    for start in range(0, len(used), COLUMNS):
        factors = []
        for row, c in ((rows[0], column), (rows[1], at)):
            inside = (c >= start) & (c < start + COLUMNS)
            factor = np.zeros((common.shape[len(factors)], min(COLUMNS, len(used) - start)), np.float32)
            factor[row[inside], c[inside] - start] = 1
            factors.append(factor)
        common += factors[0] @ factors[1].T
    return 5 * common >= 4 * (size[0][:, None] + size[1][None] - common)


def _sets(docs: DataFrame, units: DataFrame, wanted: DataFrame) -> DataFrame:
    """``(key, shingles)`` of the wanted units, each from one of its rows in ``docs``."""

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            found = [shingle_set(t) for t in as_bytes(part.column(0))]
            keys = np.array([key_of(s) for s in found], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array([s.tobytes() for s in found], pa.binary())], names=["key", "shingles"])

    ids = units.join(wanted, "key").select(F.col("least_id").alias("wanted_id")).distinct()
    texts = docs.select("doc_id", "text").join(ids, F.col("doc_id").cast("long").eqNullSafe(F.col("wanted_id")), "left_semi").select("text")
    return texts.mapInArrow(per_batch, "key long, shingles binary").join(wanted, "key", "left_semi").groupBy("key").agg(F.first("shingles").alias("shingles"))


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (tile, part, asks, key, label, shingles) sorted by the first three: a spanning forest of the links between a tile's
    asking units and its others, as pairs of a unit and the least one that it is linked to."""
    tile, held, labels, sets = None, [], np.empty(0, np.int64), []
    found = np.empty((2, 0), np.int64)

    def links(keys: list[int], own: list[int], asked: list[np.ndarray]) -> np.ndarray:
        near = alike(asked, sets) & (np.array(own)[:, None] != labels[None])
        a, b = np.nonzero(near)
        return np.stack([np.array(keys, np.int64)[a], np.array(held, np.int64)[b]])

    def out() -> pa.RecordBatch:
        tree = spanning_forest(found)
        return pa.RecordBatch.from_arrays([pa.array(tree[0]), pa.array(tree[1])], names=["a", "b"])

    for batch in batches:
        for part in slices([batch], ASKED):
            rows = list(zip(*(part.column(c).to_pylist() for c in ("tile", "part", "asks", "key", "label", "shingles"))))
            start = 0
            for end in range(1, len(rows) + 1):
                if end < len(rows) and rows[end][:3] == rows[start][:3]:
                    continue
                at, asks = rows[start][:2], rows[start][2]
                if at != tile:
                    if found.shape[1]:
                        yield out()
                    tile, held, labels, sets, found = at, [], np.empty(0, np.int64), [], found[:, :0]
                keys, own = [r[3] for r in rows[start:end]], [r[4] for r in rows[start:end]]
                some = [np.frombuffer(r[5], np.uint64) for r in rows[start:end]]
                if not asks:
                    held, labels, sets = held + keys, np.r_[labels, np.array(own, np.int64)], sets + some
                elif held:
                    found = np.concatenate([found, links(keys, own, some)], axis=1)
                    if found.shape[1] > 65_536:
                        found = spanning_forest(found)
                start = end
    if found.shape[1]:
        yield out()


def _linked(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """Links ``(a, b)`` of like units in ``rows(tile, part, asks, key, label)``: a spanning forest, for each tile and part, of those
    between units that ask and the others, where labels differ; b is the least unit of its tree."""
    return rows.join(sets, "key").repartition("tile", "part").sortWithinPartitions("tile", "part", "asks").mapInArrow(_met, "a long, b long")


def classes(prints: DataFrame, docs: DataFrame, links: DataFrame) -> DataFrame:
    """``(node, root)`` of fingerprints, from the ``links(u, v)`` among them and from all near copies.

    ``prints(doc_id, fp, key, n_shingles, bands)`` has a row for each row of ``docs``.
    """
    units = saved(prints.groupBy("key").agg(F.min("fp").alias("fp"), F.min("doc_id").alias("least_id"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands")), "units")
    print_of = units.select("key", "fp")
    same = prints.select("key", F.col("fp").alias("u")).distinct().join(print_of.withColumnRenamed("fp", "v"), "key").where("u <> v").select("u", "v")
    in_buckets = units.select("key", "n_shingles", F.explode("bands").alias("bucket"))
    least = in_buckets.groupBy("bucket").agg(F.min("key").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    shared = saved(in_buckets.join(least, "bucket"), "shared-buckets")
    sets = saved(_sets(docs, units, shared.select("key").distinct()), "shingle-sets")

    def edges(found: DataFrame) -> DataFrame:
        left, right = print_of.toDF("a", "u"), print_of.toDF("b", "v")
        return found.join(left, "a").join(right, "b").select("u", "v")

    # The askers of one least unit are dealt out, so that a hot one is many tasks'; each deal holds that one unit.
    asks = shared.where("key <> least").select(F.col("least").alias("tile"), F.pmod(F.xxhash64("key"), F.lit(DEALS)).cast("int").alias("part"), F.lit(True).alias("asks"), "key", F.col("key").alias("label")).distinct()
    leasts = asks.select("tile", "part", F.lit(False).alias("asks"), F.col("tile").alias("key"), F.col("tile").alias("label")).distinct()
    starred = saved(_linked(asks.unionByName(leasts), sets), "star-links")

    # In a bucket, a unit like the least is labelled with it and any other with itself.
    like = starred.select(F.col("a").alias("key"), F.col("b").alias("least"), F.lit(True).alias("like"))
    labelled = shared.join(like, ["key", "least"], "left")
    label = F.when(F.col("like") | (F.col("key") == F.col("least")), F.col("least")).otherwise(F.col("key"))
    labelled = labelled.select("bucket", "key", "n_shingles", label.alias("label"), ((F.col("key") != F.col("least")) & F.col("like").isNull()).alias("asks"))
    # Buckets without such a unit are done, and buckets of the same units are one.
    n = F.count(F.lit(1))
    hashed = labelled.groupBy("bucket").agg(
        F.bool_or("asks").alias("open"), n.alias("n"), F.min("key").alias("low"), F.max("key").alias("high"), F.sum(F.xxhash64("key").bitwiseAND(F.lit((1 << 40) - 1))).alias("sum"),
        F.greatest(F.ceil(n / TILE_UNITS), F.ceil(8 * F.sum("n_shingles") / TILE_BYTES)).cast("int").alias("parts"),
    ).where("open")
    once = hashed.groupBy("n", "low", "high", "sum", "parts").agg(F.min("bucket").alias("bucket")).select("bucket", "parts")
    open_ = saved(labelled.join(once, "bucket").select(F.col("bucket").alias("tile"), "key", "label", "asks", "parts"), "open-buckets")
    held = open_.select("tile", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int").alias("part"), F.lit(False).alias("asks"), "key", "label")
    asking = open_.where("asks").select("tile", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "asks", "key", "label")
    late = _linked(held.unionByName(asking), sets)
    return components(links.union(same).union(edges(starred)).union(edges(late)))
