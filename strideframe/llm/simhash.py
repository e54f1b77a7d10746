"""SimHash near-duplicates by tiled exact comparison of all fingerprints.

A fingerprint bit is set where it is set in over half of the text's shingle hashes (XXH64, seed 42). Two fingerprints
link at ``RADIUS`` or fewer differing bits. All distinct fingerprints are compared exactly, tile against tile, with
numpy exclusive-or and bit counts. Tile pairs that cannot hold a link are skipped:

* links of at most 3 bits leave one of the four 16-bit words untouched, so tiles are laid out along each of those
  words and only fingerprints that share the word's value meet (no link is lost);
* inside such a group the fingerprints stand in order of population count, and tile pairs whose counts differ by more
  than the radius are skipped.

Exact copies meet as one fingerprint. A group larger than a task's fair share is dealt into parts, and every pair of
parts is compared in a task of its own. A comparison returns a spanning forest of what it linked, not its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strideframe.llm import near_copies
from strideframe.llm.common import as_bytes, row_of, saved, slices
from strideframe.llm.components import components

RADIUS = 3
SHINGLE = 3
SEED = 42
WORDS = 4
WORD_BITS = 16
TILE = 512
_UPPER = bytes(range(ord("A"), ord("Z") + 1))
_LOWER_CASE = bytes.maketrans(_UPPER, _UPPER.lower())


def fingerprint(text: bytes) -> int:
    """The text's fingerprint as an unsigned 64-bit integer; zero for a text without words."""
    w = text.translate(_LOWER_CASE).split()
    if not w:
        return 0
    shingles = [b"%b %b %b" % three for three in zip(w, w[1:], w[2:])] or [b" ".join(w)]
    hashes = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles), np.uint64, len(shingles))
    ones = np.zeros(64, np.int64)
    for start in range(0, len(hashes), 4096):
        ones += np.unpackbits(hashes[start : start + 4096].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """``(doc_id, fp)``: the fingerprint's 64 bits as a signed long. Null and empty texts have fingerprint 0."""

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            fps = np.array([fingerprint(t) for t in as_bytes(part.column("text"))], np.uint64)
            yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(per_batch, "doc_id long, fp long")


def _roots(n: int, pairs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Component of each of n nodes, numbered by its least node, from link arrays."""
    root = np.arange(n)
    while True:
        before = root.copy()
        for a, b in pairs:
            low = np.minimum(root[a], root[b])
            np.minimum.at(root, a, low)
            np.minimum.at(root, b, low)
        root = root[root]
        if (root == before).all():
            return root


def forest(left: np.ndarray, right: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of the links within ``left``, or between ``left`` and ``right`` (uint64 arrays)."""
    within = right is None
    one = left[np.argsort(np.bitwise_count(left), kind="stable")]
    two = one if within else right[np.argsort(np.bitwise_count(right), kind="stable")]
    bits = [np.bitwise_count(x).astype(np.int16) for x in (one, two)]
    found = []
    for i in range(0, len(one), TILE):
        for j in range(i if within else 0, len(two), TILE):
            if bits[1][j] > bits[0][i : i + TILE][-1] + RADIUS or bits[0][i] > bits[1][j : j + TILE][-1] + RADIUS:
                continue
            near = np.bitwise_count(one[i : i + TILE, None] ^ two[None, j : j + TILE]) <= RADIUS
            a, b = np.nonzero(near)
            a, b = a + i, b + j
            if within:
                a, b = a[a < b], b[a < b]
            if len(a) > 4 * TILE:  # a dense tile pair: its forest says as much
                root = _roots(len(one) + (0 if within else len(two)), [(a, b if within else b + len(one))])
                child = np.nonzero(root != np.arange(len(root)))[0]
                a, b = root[child], child
                found.append((a, b))
            elif len(a):
                found.append((a, b if within else b + len(one)))
    every = one if within else np.concatenate([one, two])
    root = _roots(len(every), found) if found else np.arange(len(every))
    child = np.nonzero(root != np.arange(len(every)))[0]
    return every[child], every[root[child]]


def _one_tile_each(group: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest of the links inside many groups of at most a tile each, all compared at once.

    Rows stand by group and population count. The k-th step compares each row with the k-th after it; a row leaves when
    that one is of another group or its population count lies beyond the radius.
    """
    bits = np.bitwise_count(fp).astype(np.int16)
    order = np.lexsort((bits, group))
    group, fp, bits = group[order], fp[order], bits[order]
    rows, found = np.arange(len(fp)), []
    for step in range(1, len(fp)):
        rows = rows[rows + step < len(fp)]
        after = rows + step
        rows = rows[(group[after] == group[rows]) & (bits[after] - bits[rows] <= RADIUS)]
        if not len(rows):
            break
        near = rows[np.bitwise_count(fp[rows + step] ^ fp[rows]) <= RADIUS]
        found.append((near, near + step))
    if sum(len(a) for a, _ in found) > len(fp):
        root = _roots(len(fp), found)
        child = np.nonzero(root != np.arange(len(fp)))[0]
        found = [(child, root[child])]
    ends = [np.concatenate(x) for x in zip(*found)] if found else [np.empty(0, np.int64)] * 2
    return fp[ends[0]], fp[ends[1]]


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (tile, part_a, part_b, own, fp) sorted by the first three: links of each group of fingerprints."""

    def links(tile, a, b, own, fp):
        key = np.cumsum(np.r_[0, (tile[1:] != tile[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
        starts = np.r_[np.nonzero(np.r_[True, key[1:] != key[:-1]])[0], len(key)]
        size = np.diff(starts)
        single = (size <= TILE) & (a[starts[:-1]] == b[starts[:-1]])
        rows = np.repeat(single, size)
        out = [_one_tile_each(key[rows], fp[rows])] if rows.any() else []
        for k in np.nonzero(~single)[0]:
            rows = slice(starts[k], starts[k + 1])
            if a[starts[k]] == b[starts[k]]:
                out.append(forest(fp[rows]))
            else:
                mine = own[rows] == a[starts[k]]
                out.append(forest(fp[rows][mine], fp[rows][~mine]))
        for u, v in out:
            if len(u):
                yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["u", "v"])

    held: list[tuple] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        tile, a, b, own, fp = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("tile", "part_a", "part_b", "own", "fp"))
        now, last = (tile[-1], a[-1], b[-1]), (tile == tile[-1]) & (a == a[-1]) & (b == b[-1])
        rows = (tile, a, b, own, fp.view(np.uint64))
        if last.all() and held and all(x[0] == y for x, y in zip(held[0], now)):
            held.append(rows)  # a group of several batches
            continue
        done = [np.concatenate(x) for x in zip(*held, tuple(x[~last] for x in rows))]
        if len(done[0]):
            yield from links(*done)
        held = [tuple(x[last] for x in rows)]
    if held:
        yield from links(*(np.concatenate(x) for x in zip(*held)))


def linked(distinct: DataFrame, fair_share: int | None = None) -> DataFrame:
    """``(u, v)``: edges whose components are those of all links among the distinct fingerprints ``fp``.

    ``fair_share``: the most fingerprints of one group that a task takes; by default a quarter of a task's mean rows.
    """
    spark = distinct.sparkSession
    words = distinct.select("fp", F.explode(F.array(*(F.lit(i) for i in range(WORDS)))).alias("word"))
    shift = F.col("word") * WORD_BITS
    tiled = words.select("fp", (F.col("word") * (1 << WORD_BITS) + F.expr(f"shiftrightunsigned(fp, word * {WORD_BITS})").bitwiseAND(F.lit((1 << WORD_BITS) - 1))).cast("int").alias("tile"))
    if fair_share is None:
        parallel = int(spark.conf.get("spark.sql.shuffle.partitions"))
        fair_share = max(2 * TILE, WORDS * distinct.count() // (4 * parallel))
    # There are at most WORDS * 2**WORD_BITS groups, so this table has a fixed bound of 262,144 rows.
    large = tiled.groupBy("tile").count().where(F.col("count") > fair_share).select("tile", F.ceil(F.col("count") / fair_share).cast("int").alias("parts"))
    dealt = tiled.join(F.broadcast(large), "tile", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
    meets = dealt.select("tile", "own", "fp", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    pairs = meets.select("tile", F.least("own", "other").alias("part_a"), F.greatest("own", "other").alias("part_b"), "own", "fp")
    order = ["tile", "part_a", "part_b"]
    return pairs.repartition(*order).sortWithinPartitions(*order).mapInArrow(_compared, "u long, v long").distinct()


def simhash_classes(docs: DataFrame, fair_share: int | None = None) -> DataFrame:
    """``(doc_id, fp, component_id)``, one row per row of ``docs``.

    Null and empty texts share fingerprint 0 and link like any others. component_id is the smallest doc_id of the
    class; null doc_ids are passed over for it and it is null only where a class has no other. Rows that repeat a
    doc_id get a row each; rows of one doc_id with different texts are classed text by text. Other columns are not read.
    """
    prints = saved(fingerprints(docs), "fingerprints")
    distinct = saved(prints.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "distinct")
    classes = components(linked(distinct, fair_share)).withColumnRenamed("node", "fp")
    rooted = distinct.join(classes, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = rooted.join(least, "root").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def simhash_report(docs: DataFrame) -> DataFrame:
    """``simhash_classes`` with the fingerprint as 16 lowercase hexadecimal digits."""
    return simhash_classes(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def _prints(docs: DataFrame) -> DataFrame:
    """``(doc_id, fp, key, n_shingles, bands)``: fingerprint, name and size of the shingle set, and its bands, for each row."""

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            texts = as_bytes(part.column("text"))
            sets = [near_copies.shingle_set(t) for t in texts]
            fps = np.array([fingerprint(t) for t in texts], np.uint64)
            keys = np.array([near_copies.key_of(s) for s in sets], np.uint64)
            bands = pa.array([near_copies.bands(s).view(np.int64) for s in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array(fps.view(np.int64)), pa.array(keys.view(np.int64)), pa.array([len(s) for s in sets], pa.int64()), bands], names=["doc_id", "fp", "key", "n_shingles", "bands"])

    return docs.select("doc_id", "text").mapInArrow(per_batch, "doc_id long, fp long, key long, n_shingles long, bands array<long>")


def _marked(rows: DataFrame) -> DataFrame:
    """``rows(row, text)`` as ``(row, fp, key)``."""
    out = rows.select("row").withColumns({"fp": F.lit(0).cast("long"), "key": F.lit(0).cast("long")}).schema

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            texts = as_bytes(part.column("text"))
            fps = np.array([fingerprint(t) for t in texts], np.uint64)
            keys = np.array([near_copies.key_of(near_copies.shingle_set(t)) for t in texts], np.uint64)
            yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(fps.view(np.int64)), pa.array(keys.view(np.int64))], names=["row", "fp", "key"])

    return rows.mapInArrow(per_batch, out)


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of each class, all columns kept; rows with a null doc_id stay.

    Texts link by their fingerprints, and by a similarity of 0.8 or more (``near_copies``). The row that stays is that of
    the smallest doc_id, fingerprint and shingle set; of rows equal in these, the one least in text and then in all columns.
    A doc_id that is repeated with unrelated texts stays once in each of the classes in which it is the smallest.
    """
    prints = saved(_prints(docs), "prints")
    named = F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "key"))
    distinct = saved(prints.groupBy("fp").agg(F.min(named).alias("least")), "distinct")
    classes = near_copies.classes(prints, docs, linked(distinct)).withColumnRenamed("node", "fp")
    rooted = distinct.join(classes, "fp", "left").withColumn("root", F.coalesce("root", "fp")).where("least IS NOT NULL")
    best = rooted.groupBy("root").agg(F.min(F.struct("least.doc_id", "fp", "least.key")).alias("best")).select("best.*")
    again = prints.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id", F.lit(True).alias("again"))
    keep = saved(best.join(again, "doc_id", "left").select(F.col("doc_id").alias("keep_id"), F.col("fp").alias("keep_fp"), F.col("key").alias("keep_key"), "again"), "kept")
    of = F.col("doc_id").cast("long") == F.col("keep_id")
    once = docs.join(keep.where("again IS NULL").select("keep_id"), of, "left_semi")
    # Ids with several rows: which of them is meant is found by their texts.
    more = docs.join(keep.where("again").select("keep_id").distinct(), of, "left_semi").select(row_of(docs).alias("row"), "text")
    meant = _marked(more).join(keep.where("again"), (F.col("row.doc_id").cast("long") == F.col("keep_id")) & (F.col("fp") == F.col("keep_fp")) & (F.col("key") == F.col("keep_key")), "left_semi")
    chosen = meant.groupBy(F.col("row.doc_id").alias("id"), "fp", "key").agg(F.min_by("row", F.struct(F.col("row.text"), F.to_json("row"))).alias("row"))
    return once.unionByName(chosen.select("row.*")).unionByName(docs.where("doc_id IS NULL"))
