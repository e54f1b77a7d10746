"""Embedding near-duplicates by product quantisation.

The index is fitted on a bounded sample of vectors: coarse centroids, and for each subspace a codebook of the residuals
to them. Every vector is stored in the list of its nearest centroid, as one code for each subspace. Every vector is also
a query: it probes the lists of its nearest centroids, takes asymmetric distances from its tables, and reranks exactly
by cosine in double precision. A stored vector carries its quantisation error, so that the distance to its code less
that error bounds the true distance from below: the tables lose no link inside a probed list.

Equal vectors meet as one. A list whose rows exceed a task's fair share is dealt into parts, and every pair of a query
part and a base part is worked in a task of its own. What leaves a task is counts and a spanning forest, not pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strideframe.llm.common import dropped, hash_sample, saved
from strideframe.llm.components import components, spanning_forest

LEAST_COSINE = 0.9
#: The index is fitted on at most so many vectors.
TRAIN = 16_384
MOST_LISTS = 2_048
SUBSPACES = 8
CODES = 256
PROBES = 8
ROWS_AT_ONCE = 2_048


def _nearest(x: np.ndarray, centres: np.ndarray, k: int = 1) -> np.ndarray:
    """Places of the k nearest centres of each row, nearest first."""
    out = []
    norms = (centres**2).sum(1)
    for start in range(0, len(x), 512):
        d = norms[None] - 2 * x[start : start + 512] @ centres.T
        if k == 1:
            out.append(d.argmin(1)[:, None])
        else:
            near = np.argpartition(d, k - 1, axis=1)[:, :k] if k < d.shape[1] else np.tile(np.arange(d.shape[1]), (len(d), 1))
            out.append(np.take_along_axis(near, np.take_along_axis(d, near, 1).argsort(1, kind="stable"), 1))
    return np.concatenate(out) if out else np.empty((0, k), np.int64)


def k_means(x: np.ndarray, k: int, rounds: int = 6, seed: int = 5) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)].astype(np.float64)
    for _ in range(rounds):
        own = _nearest(x, centres)[:, 0]
        n = np.bincount(own, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


@dataclass(frozen=True)
class Index:
    """Coarse centroids (lists x d) and codebooks (subspaces x codes x d/subspaces), of bounded size."""

    coarse: np.ndarray
    books: np.ndarray
    cuts: np.ndarray  # d + padding is cut into equal subspaces

    @classmethod
    def fit(cls, sample: np.ndarray, lists: int, subspaces: int = SUBSPACES, codes: int = CODES) -> Index:
        coarse = k_means(sample, lists)
        rest = cls._padded(sample - coarse[_nearest(sample, coarse)[:, 0]], subspaces)
        width = rest.shape[1] // subspaces
        books = np.zeros((subspaces, codes, width))
        for s in range(subspaces):
            found = k_means(rest[:, s * width : (s + 1) * width], codes)
            books[s] = np.resize(found, (codes, width)) if len(found) < codes else found
        return cls(coarse, books, np.arange(subspaces) * width)

    @staticmethod
    def _padded(x: np.ndarray, subspaces: int) -> np.ndarray:
        return np.pad(x, ((0, 0), (0, -x.shape[1] % subspaces)))

    def encode(self, x: np.ndarray, lists: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes and quantisation errors of unit vectors in their lists."""
        rest = self._padded(x - self.coarse[lists], len(self.books))
        width = self.books.shape[2]
        codes = np.stack([_nearest(rest[:, c : c + width], book)[:, 0] for c, book in zip(self.cuts, self.books)], 1)
        back = np.concatenate([book[codes[:, s]] for s, book in enumerate(self.books)], 1)
        return codes.astype(np.uint8), np.linalg.norm(rest - back, axis=1)

    def distances(self, queries: np.ndarray, which: int, codes: np.ndarray) -> np.ndarray:
        """Squared asymmetric distances of queries to the stored codes of one list, from lookup tables."""
        rest = self._padded(queries - self.coarse[which], len(self.books))
        width = self.books.shape[2]
        total = np.zeros((len(queries), len(codes)))
        for s, (c, book) in enumerate(zip(self.cuts, self.books)):
            table = ((rest[:, c : c + width][:, None] - book[None]) ** 2).sum(2)
            total += table[:, codes[:, s]]
        return total


def _matrix(column: pa.Array) -> np.ndarray:
    return np.stack(column.to_numpy(zero_copy_only=False)).astype(np.float64) if len(column) else np.empty((0, 1))


def _scaled(x: np.ndarray) -> np.ndarray:
    """Rows by a power of two each, so that the largest component is between a half and one: squares of very small and very
    large vectors stay in range, and no digit changes."""
    _, exponent = np.frexp(np.abs(x).max(axis=1, keepdims=True)) if len(x) else (x, np.zeros((0, 1), int))
    return np.ldexp(x, -exponent)


def _unit(x: np.ndarray) -> np.ndarray:
    x = _scaled(x)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def with_vectors(embeddings: DataFrame) -> DataFrame:
    """``(vec_id, v)``: v is the vector in its own floating type, or in doubles; null where it can link with nothing."""
    kind = embeddings.schema["embedding"].dataType.elementType.simpleString()
    v = F.col("embedding") if kind in ("float", "double") else F.transform("embedding", lambda x: x.cast("double"))
    sound = F.forall("d", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("d", lambda x: x != 0)
    return embeddings.select("vec_id", v.alias("d")).select("vec_id", F.when(F.col("vec_id").isNotNull() & sound, F.col("d")).alias("v"))


def fitted(vectors: DataFrame, lists: int | None = None) -> Index:
    """The index for ``vectors(vid, v)``, which has a row, from the TRAIN vectors of least hash."""
    n = vectors.count()
    sample = hash_sample(vectors, "vid", TRAIN).select("v").toPandas()["v"]
    x = _unit(np.stack(sample).astype(np.float64))
    return Index.fit(x, lists or min(MOST_LISTS, max(1, int(2 * n**0.5))))


PLACED = "vid long, copies long, v array<%s>, lists array<int>, codes binary, error double"


def _placed(vectors: DataFrame, index: Index, probes: int) -> DataFrame:
    """Each vector with the lists that it probes, the first of which stores it, its codes there and their error."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(start, ROWS_AT_ONCE)
                x = _unit(_matrix(part.column("v")))
                lists = _nearest(x, index.coarse, probes)
                codes, error = index.encode(x, lists[:, 0])
                yield pa.RecordBatch.from_arrays(
                    [part.column("vid"), part.column("copies"), part.column("v"), pa.array(list(lists.astype(np.int32)), pa.list_(pa.int32())), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(error)],
                    names=["vid", "copies", "v", "lists", "codes", "error"],
                )

    return vectors.select("vid", "copies", "v").mapInArrow(place, PLACED % vectors.schema["v"].dataType.elementType.simpleString())


def _searched(index: Index, least: float):
    """Rows (list, q_part, b_part, base, ...) sorted by the first three: links of each tile of queries and base rows."""
    reach = (2 - 2 * least) ** 0.5 + 1e-6

    def tile(rows: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        base, asks = rows["base"], ~rows["base"]
        which = int(rows["list"][0])
        b = {k: v[base] for k, v in rows.items()}
        codes = np.stack([np.frombuffer(c, np.uint8) for c in b["codes"]]) if len(b["codes"]) else np.empty((0, SUBSPACES), np.uint8)
        bv = _scaled(np.stack(b["v"]).astype(np.float64)) if len(codes) else np.empty((0, 1))
        q = {k: v[asks] for k, v in rows.items()}
        if not len(q["vid"]) or not len(codes):
            return
        links, edges = {}, []
        bn = np.linalg.norm(bv, axis=1)
        b_probes = np.stack(b["lists"])
        counts = np.zeros(len(codes), np.int64)
        for start in range(0, len(q["vid"]), 32):
            cut = slice(start, start + 32)
            qv = _scaled(np.stack(q["v"][cut]).astype(np.float64))
            near = np.sqrt(index.distances(_unit(qv), which, codes)) <= reach + b["error"][None]
            home = np.array([x[0] for x in q["lists"][cut]])
            ids = q["vid"][cut]
            near &= np.where((home == which)[:, None], ids[:, None] < b["vid"][None], True)
            cols = np.nonzero(near.any(0))[0]
            if not len(cols):
                continue
            cosine = (qv @ bv[cols].T) / (np.linalg.norm(qv, axis=1)[:, None] * bn[cols][None])
            near = near[:, cols] & (cosine >= least)
            # The base row may have found this query too, in the query's list: the lower of the two lists counts the pair.
            near &= (home >= which)[:, None] | ~(b_probes[cols][None] == home[:, None, None]).any(2)
            if near.any():
                counts[cols] += (near * q["copies"][cut][:, None]).sum(0)
                for i in np.nonzero(near.any(1))[0]:
                    links[ids[i]] = links.get(ids[i], 0) + int(b["copies"][cols][near[i]].sum())
                i, j = np.nonzero(near)
                edges.append(np.stack([ids[i], b["vid"][cols[j]]]))
                if sum(e.shape[1] for e in edges) > 65_536:
                    edges = [spanning_forest(np.concatenate(edges, 1))]
        out_id = np.r_[np.fromiter(links, np.int64, len(links)), b["vid"][counts > 0]]
        out_n = np.r_[np.fromiter(links.values(), np.int64, len(links)), counts[counts > 0]]
        if len(out_id):
            tree = spanning_forest(np.concatenate(edges, 1))
            nothing = np.full(len(out_id) + tree.shape[1], None)
            u, v, i, n = nothing.copy(), nothing.copy(), nothing.copy(), nothing.copy()
            i[: len(out_id)], n[: len(out_id)] = out_id, out_n
            u[len(out_id) :], v[len(out_id) :] = tree
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (i, n, u, v)], names=["vid", "n", "u", "v"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, held, key = ("base", "vid", "copies", "v", "lists", "codes", "error", "list"), [], None
        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in ("list", "q_part", "b_part"))))
            rows = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in names}
            start = 0
            for end in range(1, len(keys) + 1):
                if end == len(keys) or keys[end] != keys[start]:
                    if key is not None and keys[start] != key and held:
                        yield from tile({c: np.concatenate([h[c] for h in held]) for c in names})
                        held = []
                    key = keys[start]
                    held.append({c: v[start:end] for c, v in rows.items()})
                    start = end
        if held:
            yield from tile({c: np.concatenate([h[c] for h in held]) for c in names})

    return search


def _links(placed: DataFrame, index: Index, least: float, fair_share: int | None) -> DataFrame:
    spark = placed.sparkSession
    asks = placed.select("*", F.explode("lists").alias("list"))
    # At most MOST_LISTS rows.
    sizes = asks.groupBy("list").agg(F.count(F.lit(1)).alias("q_rows"), F.sum((F.element_at("lists", 1) == F.col("list")).cast("long")).alias("b_rows"))
    if fair_share is None:
        parallel = int(spark.conf.get("spark.sql.shuffle.partitions"))
        fair_share = max(256, PROBES * placed.count() // (8 * parallel))
    parts = lambda c: F.ceil(F.greatest(F.col(c), F.lit(1)) / fair_share).cast("int")
    sizes = F.broadcast(sizes.select("list", parts("q_rows").alias("q_parts"), parts("b_rows").alias("b_parts")))
    own = lambda n: F.pmod(F.xxhash64("vid"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    q = asks.join(sizes, "list").withColumn("q_part", own("q_parts")).withColumn("b_part", every("b_parts")).withColumn("base", F.lit(False))
    b = placed.withColumn("list", F.element_at("lists", 1)).join(sizes, "list").withColumn("b_part", own("b_parts")).withColumn("q_part", every("q_parts")).withColumn("base", F.lit(True))
    columns = ["list", "q_part", "b_part", "base", "vid", "copies", "v", "lists", "codes", "error"]
    keys = columns[:3]
    tiles = q.select(columns).unionByName(b.select(columns)).repartition(*keys).sortWithinPartitions(*keys)
    return tiles.mapInArrow(_searched(index, least), "vid long, n long, u long, v long")


def embedding_classes(embeddings: DataFrame, least: float = LEAST_COSINE, probes: int = PROBES, lists: int | None = None, fair_share: int | None = None) -> DataFrame:
    """One row per row of ``embeddings(vec_id, embedding)``: vec_id, n_links, component_id, kept.

    Vectors that are null, empty, zero, or hold null or non-finite components, and rows with a null vec_id, link with
    nothing (component_id is their own vec_id, null where that is null). Vectors of different widths don't link; each
    width has an index of its own. Rows that repeat a vec_id count as vectors of their own, equal or not. Other columns
    are not read.
    """
    every = with_vectors(embeddings.select("vec_id", "embedding"))
    good = every.where("v IS NOT NULL")
    alone = every.where("v IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    equal = good.groupBy("v").agg(F.min("vec_id").alias("least_id"), F.count(F.lit(1)).alias("copies"))
    distinct = saved(equal.withColumn("vid", F.monotonically_increasing_id()), "vectors")
    classes = alone
    # One row for each width in use.
    for width in sorted(r.w for r in distinct.select(F.size("v").alias("w")).distinct().collect()):
        of_width = distinct.where(F.size("v") == width)
        index = fitted(of_width, lists)
        placed = saved(_placed(of_width, index, min(probes, len(index.coarse))), "placed")
        found = saved(_links(placed, index, least, fair_share), "links")
        dropped(placed)
        counts = found.where("vid IS NOT NULL").groupBy("vid").agg(F.sum("n").alias("n"))
        roots = components(found.where("u IS NOT NULL").select("u", "v")).withColumnRenamed("node", "vid")
        named = saved(of_width.join(counts, "vid", "left").join(roots, "vid", "left").withColumn("root", F.coalesce("root", "vid")), "named")
        least_ids = named.groupBy("root").agg(F.min("least_id").alias("component_id"))
        of_vector = named.join(least_ids, "root").select(F.col("v").alias("key"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
        rows = good.where(F.size("v") == width).join(of_vector, F.col("v") == F.col("key"))
        classes = classes.unionByName(rows.select("vec_id", "n_links", "component_id"))
    return classes.select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))
