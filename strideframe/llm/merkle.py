"""Merkle manifest of documents: a tree for each language over its documents by doc_id, and one over the trees.

Superblock reduction: nodes are dealt into buckets of ``FANOUT ** LEVELS`` neighbours, and one task collapses a bucket
by that many levels; the buckets' roots are dealt and collapsed again until one node is left. A proof is the lower part
that a bucket gives, with the proof of the bucket's root behind it. No task sees more than a bucket, and no list of
documents reaches the driver.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strideframe.llm.common import saved, slices

FANOUT = 8
LEVELS = 4
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Offsets of up to so many runs of a sorted table are sent to every task; more meet their rows in a shuffle.
SENT_RUNS = 200_000
PATH = "array<struct<before: string, after: string>>"

Path = list[tuple[str, str]]  # for each level, the digests of the siblings before and after


def digest(*parts: bytes) -> str:
    return hashlib.sha256(b"".join(parts)).hexdigest()


def leaf(values: list[bytes | None]) -> str:
    return digest(*(b"-" if v is None else b"%d:%s" % (len(v), v) for v in values))


def depth(size: int) -> int:
    """Levels until one node is left of ``size``."""
    n = 0
    while size > 1:
        size, n = -(-size // FANOUT), n + 1
    return n


def collapsed(nodes: list[str], levels: int) -> list[list[str]]:
    """The nodes of a bucket level by level, its own first."""
    rows = [nodes]
    for _ in range(levels):
        rows.append([digest("".join(rows[-1][i : i + FANOUT]).encode()) for i in range(0, len(rows[-1]), FANOUT)])
    return rows


def path_of(rows: list[list[str]], i: int) -> Path:
    """The siblings of node i of a collapsed bucket, from its own level up."""
    path = []
    for level in rows[:-1]:
        run = i // FANOUT * FANOUT
        path.append(("".join(level[run:i]), "".join(level[i + 1 : run + FANOUT])))
        i //= FANOUT
    return path


def folded(node: str, path: Path) -> str:
    for before, after in path:
        node = digest((before + node + after).encode())
    return node


def leaves(docs: DataFrame) -> DataFrame:
    """``(tree, doc_id, leaf, fake)``: tree names the language, ``''`` for null; fake is the leaf of the tampered row."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            columns = [part.column(c).cast(pa.binary()).to_pylist() for c in FIELDS]
            real, fake = [], []
            for row in zip(*columns):
                real.append(leaf(row))
                changes = row[4] is not None and zlib.crc32(row[0] or b"") % 3 == 0
                fake.append(leaf([*row[:4], row[4].lower()]) if changes else real[-1])
            trees = [b"" if x is None else b"+" + x for x in columns[2]]
            yield pa.RecordBatch.from_arrays([pa.array(trees, pa.binary()).cast(pa.string()), part.column("id"), pa.array(real), pa.array(fake)], names=["tree", "doc_id", "leaf", "fake"])

    rows = docs.select(F.col("doc_id").cast("long").alias("id"), *(F.col(c).cast("string").alias(c) for c in FIELDS))
    return rows.mapInArrow(made, "tree string, doc_id long, leaf string, fake string")


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """``rows(tree, ...)`` with ``idx``, the place in its tree by ``order``, and ``size``, the number of the tree's rows.

    The rows are dealt by range and written; offsets come from the counts of each tree's run in each part.
    """
    mixed = F.monotonically_increasing_id()  # rows that are alike may change places
    dealt = rows.withColumn("mixed", mixed).repartitionByRange("tree", *order, "mixed").sortWithinPartitions("tree", *order).drop("mixed")
    dealt = saved(dealt.withColumn("at", F.monotonically_increasing_id()), "leaves").withColumn("part", F.shiftright("at", 33))
    runs = dealt.groupBy(F.col("tree").alias("r_tree"), F.col("part").alias("r_part")).agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    # A tree has one run in each part that it reaches: no more rows than parts and trees together.
    whole = Window.partitionBy("r_tree")
    before = F.sum("n").over(whole.orderBy("r_part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    runs = saved(runs.select("r_tree", "r_part", (before - F.col("first")).alias("shift"), F.sum("n").over(whole).alias("size")), "runs")
    sent = F.broadcast(runs) if runs.count() <= SENT_RUNS else runs
    placed = dealt.join(sent, (F.col("tree") == F.col("r_tree")) & (F.col("part") == F.col("r_part")))
    return placed.withColumn("idx", F.col("at") + F.col("shift")).drop("r_tree", "r_part", "shift", "at", "part")


def _bucket() -> Column:
    return F.floor(F.col("idx") / FANOUT**LEVELS).alias("bucket")


def climbed(nodes: DataFrame) -> list[DataFrame]:
    """``nodes(tree, idx, size, node)`` and above them the roots of buckets, stage by stage, down to one node a tree."""

    def collapse(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        size = int(rows["size"].iloc[0])
        top = collapsed(rows.sort_values("idx")["node"].tolist(), min(LEVELS, depth(size)))[-1]
        return pd.DataFrame({"tree": key[0], "idx": [key[1]], "size": [-(-size // FANOUT**LEVELS)], "node": top})

    stages = [nodes]
    most = nodes.agg(F.max("size")).first()[0] or 0
    while most:
        up = stages[-1].groupBy("tree", _bucket()).applyInPandas(collapse, "tree string, idx long, size long, node string")
        stages.append(saved(up, "nodes"))
        most = -(-most // FANOUT**LEVELS) if most > FANOUT**LEVELS else 0
    return stages


def _lower(rows: pd.DataFrame, upper: pd.DataFrame) -> tuple[pd.DataFrame, list[Path]]:
    """A bucket's nodes in order, with the whole proof of each: the bucket's part and that of its root."""
    nodes = rows.sort_values("idx")
    levels = collapsed(nodes["node"].tolist(), min(LEVELS, depth(int(nodes["size"].iloc[0]))))
    rest = [(p["before"], p["after"]) for p in upper["path"].iloc[0]]
    return nodes, [path_of(levels, i) + rest for i in range(len(nodes))]


def _stored(path: Path) -> list[dict]:
    return [{"before": b, "after": a} for b, a in path]


def descended(stages: list[DataFrame], above: DataFrame) -> DataFrame:
    """``(tree, idx, path)``: the proofs of the first stage's nodes, from those of the last stage's, ``above(tree, idx, path)``."""

    def down(key: tuple, rows: pd.DataFrame, upper: pd.DataFrame) -> pd.DataFrame:
        nodes, paths = _lower(rows, upper)
        return pd.DataFrame({"tree": key[0], "idx": nodes["idx"].to_numpy(), "path": [_stored(p) for p in paths]})

    for nodes in reversed(stages[:-1]):
        above = nodes.groupBy("tree", _bucket()).cogroup(above.groupBy("tree", "idx")).applyInPandas(down, f"tree string, idx long, path {PATH}")
    return above


def manifest(docs: DataFrame) -> DataFrame:
    """``(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified, path)`` of every row; path has for each level the
    digests before and after the node, from the leaf up to the root.

    Nulls are leaves' ``-``; a null language is a tree of its own, the first; null doc_ids come first in their tree and
    count as the empty text where tampering is decided; rows that share a doc_id go by their leaf's digest, and alike
    ones stand in any order. A tree of one document is its leaf. Columns of other names change nothing; an empty table
    gives no row.
    """
    placed = numbered(leaves(docs), "doc_id", "leaf").withColumnRenamed("leaf", "node")
    stages = climbed(placed.select("tree", "idx", "size", "node"))
    subroots = stages[-1].select(F.lit("").alias("tree"), F.col("tree").alias("lang"), "node")
    tops = climbed(saved(numbered(subroots, "lang"), "languages"))
    root = getattr(tops[-1].first(), "node", None)
    apex = tops[-1].select("tree", "idx", F.array().cast(PATH).alias("path"))
    proofs = tops[0].select(F.col("lang").alias("tree"), F.col("idx").alias("place")).join(descended(tops, apex).select(F.col("idx").alias("place"), "path"), "place")

    def proven(key: tuple, rows: pd.DataFrame, upper: pd.DataFrame) -> pd.DataFrame:
        nodes, paths = _lower(rows, upper)
        subroot = folded(nodes["node"].iloc[0], paths[0][: depth(int(nodes["size"].iloc[0]))])
        proof = [digest("".join(b + a for b, a in p).encode()) for p in paths]
        back = [folded(fake, p) for fake, p in zip(nodes["fake"], paths)]
        return pd.DataFrame({"doc_id": nodes["doc_id"].to_numpy(), "leaf": nodes["node"].to_numpy(), "subroot": subroot, "proof_sha256": proof, "folded_root": back, "path": [_stored(p) for p in paths]})

    above = descended(stages[1:], proofs.select("tree", F.lit(0).cast("long").alias("idx"), "path"))
    schema = f"doc_id long, leaf string, subroot string, proof_sha256 string, folded_root string, path {PATH}"
    out = placed.groupBy("tree", _bucket()).cogroup(above.groupBy("tree", "idx")).applyInPandas(proven, schema)
    return out.select("doc_id", "leaf", "subroot", F.lit(root).cast("string").alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == root).alias("verified"), "path")
