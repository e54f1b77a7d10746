"""Mixing sources to target weights by temperature.

Source token shares p are raised to an exponent a between 0 and 1 and normalised: w = p**a / sum(p**a). The exponent
is bisected to the largest one whose weights reach a target entropy and keep every source within a repetition limit.
The weights are then realised as budgets of tokens. A source's documents lie in hash blocks; a pass over the source
takes its blocks in an order permuted for that pass. Whole passes come first; the last pass takes blocks in order
while they fit, and of the block at the edge the documents that still fit, in hash order.

A null source is a source of its own. Sources without any token are passed over once. Documents weigh their number of
words (runs between ASCII white space).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strideframe.llm.common import as_bytes, row_of, saved, slices

BLOCK_DOCS = 256
#: Up to so many blocks a source's blocks hold BLOCK_DOCS documents each; beyond, their number and their size grow alike.
FEW_BLOCKS = 1024
SEED = 17
#: Tables of sources or blocks up to this size are sent to every task.
SENT_BYTES = 32 << 20
SALTS = 64


def n_blocks(docs: int) -> int:
    """Blocks of a source of so many documents."""
    least = max(1, -(-docs // BLOCK_DOCS))
    return least if least <= FEW_BLOCKS else int(math.sqrt(least * FEW_BLOCKS))


@dataclass(frozen=True)
class Share:
    """A source, or ``n`` sources of as many tokens and documents each."""

    source: str | None
    tokens: int
    docs: int
    n: int = 1


def weights_at(shares: list[Share], exponent: float) -> list[float]:
    """The weight of each source; of one of the sources where a share stands for several."""
    total = sum(s.tokens * s.n for s in shares) or 1
    raw = [(s.tokens / total) ** exponent if s.tokens else 0.0 for s in shares]
    every = sum(x * s.n for x, s in zip(raw, shares)) or 1.0
    return [x / every for x in raw]


def entropy(weights: list[float], counts: list[int] | None = None) -> float:
    return -sum(w * math.log(w) * n for w, n in zip(weights, counts or [1] * len(weights)) if w > 0)


def repetitions(shares: list[Share], weights: list[float], budget: float | None) -> list[float]:
    """Passes over each source; without a budget, the least pass is 1."""
    rates = [w / s.tokens if s.tokens else 0.0 for s, w in zip(shares, weights)]
    budget = 1 / min((r for r in rates if r), default=1.0) if budget is None else budget
    return [r * budget for r in rates]


def _bisect(holds, steps: int = 60) -> float:
    """The largest exponent at which ``holds``, for a condition that holds below some exponent; 0 where none does."""
    if holds(1.0):
        return 1.0
    low, high = 0.0, 1.0
    for _ in range(steps):
        mid = (low + high) / 2
        low, high = (mid, high) if holds(mid) else (low, mid)
    return low


def solve_exponent(shares: list[Share], budget: float | None, entropy_share: float | None, max_repeats: float | None) -> float:
    """The exponent for a target entropy, as a share of that of equal weights, under a repetition limit.

    Entropy falls and the largest repetition falls as the exponent grows: the target asks for a small exponent and the
    limit for a large one. The limit wins.
    """
    live = [s for s in shares if s.tokens]
    if not live:
        return 1.0
    aim = 1.0
    if entropy_share is not None:
        counts = [s.n for s in live]
        target = entropy_share * math.log(sum(counts)) - 1e-12
        aim = _bisect(lambda a: entropy(weights_at(live, a), counts) >= target)
    if max_repeats is not None:
        within = lambda a: max(repetitions(live, weights_at(live, a), budget)) <= max_repeats + 1e-12
        if not within(aim):
            aim = 1 - _bisect(lambda b: within(1 - b))
    return aim


def token_counts(docs: DataFrame) -> DataFrame:
    """``(doc_id, source, n_tokens)``."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            n = pa.array([len(t.split()) for t in as_bytes(part.column("text"))], pa.int64())
            yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), part.column("source").cast(pa.string()), n], names=["doc_id", "source", "n_tokens"])

    return docs.select("doc_id", F.col("source").cast("string").alias("source"), "text").mapInArrow(counted, "doc_id long, source string, n_tokens long")


@dataclass(frozen=True)
class Mix:
    """A solved mixture: ``recipe`` has a row for each source, ``blocks`` one for each block of each source."""

    exponent: float
    recipe: DataFrame  # src, tokens, docs, n_blocks, weight, whole, rest
    blocks: DataFrame  # src, block, weight, whole, takes, edge (null: not the edge block)


def _draw(doc_id="doc_id"):
    return F.xxhash64(F.lit(SEED), F.col(doc_id))


def _edge_draw(doc_id="doc_id"):
    return F.xxhash64(F.lit(SEED + 1), F.col(doc_id))


def _met(rows: DataFrame, table: DataFrame, source: str, keys: dict[str, str], how: str = "inner") -> DataFrame:
    """``rows`` joined to a table by source (null meets null) and the columns ``keys`` names (rows' -> table's).

    A table of at most SENT_BYTES is sent to every task. A larger one meets the rows in a shuffle in which a source is
    spread over SALTS keys, so that a hot one is many tasks'.
    """
    on = F.col(source).eqNullSafe(F.col("src"))
    for mine, theirs in keys.items():
        on = on & (F.col(mine) == F.col(theirs))
    size = table.agg(F.count(F.lit(1)), F.sum(F.coalesce(F.octet_length("src"), F.lit(0)))).first()
    if 64 * size[0] + (size[1] or 0) <= SENT_BYTES:
        return rows.join(F.broadcast(table), on, how)
    salted = rows.withColumn("salt_", F.pmod(F.xxhash64("doc_id", F.lit(SEED + 2)), F.lit(SALTS)))
    copies = table.withColumn("their_salt_", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(copies, on & (F.col("salt_") == F.col("their_salt_")), how).drop("salt_", "their_salt_")


def solve(items: DataFrame, budget_tokens: int | None, entropy_share: float | None, max_repeats: float | None) -> Mix:
    """The mixture of ``items(doc_id, source, n_tokens)``. Without a budget every source is passed over at least once.

    The driver sees one row for each number of tokens that a source has, at most the square root of twice the corpus's
    tokens and no more than there are sources.
    """
    totals = saved(items.groupBy(F.col("source").alias("src")).agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("docs")), "sources")
    shares = [Share(None, r.tokens, 0, r.n) for r in totals.groupBy("tokens").agg(F.count(F.lit(1)).alias("n")).orderBy("tokens").collect()]
    exponent = solve_exponent(shares, budget_tokens, entropy_share, max_repeats)
    total = sum(s.tokens * s.n for s in shares) or 1
    norm = sum((s.tokens / total) ** exponent * s.n for s in shares if s.tokens) or 1.0
    if budget_tokens is None:
        rates = [w / s.tokens for s, w in zip(shares, weights_at(shares, exponent)) if s.tokens]
        budget_tokens = 1 / min((r for r in rates if r), default=1.0)
    live = F.col("tokens") > 0
    least = F.greatest(F.lit(1), F.ceil(F.col("docs") / BLOCK_DOCS)).cast("long")
    blocks = F.when(least <= FEW_BLOCKS, least).otherwise(F.floor(F.sqrt(least * FEW_BLOCKS))).cast("long")
    recipe = totals.withColumn("n_blocks", blocks).withColumn("weight", F.when(live, F.pow(F.col("tokens") / F.lit(float(total)), F.lit(float(exponent))) / F.lit(float(norm))).otherwise(0.0))
    recipe = recipe.withColumn("passes", F.when(live, F.try_divide(F.col("weight"), F.col("tokens")) * F.lit(float(budget_tokens))).otherwise(1.0))
    recipe = recipe.withColumn("whole", F.floor(F.col("passes") + 1e-9)).withColumn("rest", F.greatest(F.lit(0), F.floor((F.col("passes") - F.col("whole")) * F.col("tokens") + 1e-6)))
    recipe = saved(recipe.drop("passes"), "recipe")
    placed = _met(items, recipe.drop("tokens", "docs"), "source", {}).withColumn("block", F.pmod(_draw(), F.col("n_blocks")))
    sums = placed.groupBy("src", "block", "weight", "whole", "rest").agg(F.sum("n_tokens").alias("tokens"))
    # A row for each block of a source.
    order = Window.partitionBy("src").orderBy(F.xxhash64(F.lit(SEED), "src", "block", "whole"), "block")
    sums = sums.withColumn("upto", F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    sums = saved(sums.withColumn("takes", F.col("upto") <= F.col("rest")).withColumn("room", F.when((F.col("upto") > F.col("rest")) & (F.col("upto") - F.col("tokens") < F.col("rest")), F.col("rest") - F.col("upto") + F.col("tokens"))), "blocks")
    edges = sums.where("room IS NOT NULL").select("src", F.col("block").alias("e_block"), "room")
    inside = _met(placed.select("doc_id", "source", "n_tokens", "block"), edges, "source", {"block": "e_block"}).withColumn("draw", _edge_draw())
    # One block of each source.
    along = Window.partitionBy("src").orderBy("draw")
    inside = inside.withColumn("filled", F.sum("n_tokens").over(along))
    edge = inside.where("filled <= room").groupBy(F.col("src").alias("e_src"), "e_block").agg(F.max("draw").alias("edge"))
    blocks = sums.join(edge, F.col("src").eqNullSafe(F.col("e_src")) & (F.col("block") == F.col("e_block")), "left")
    return Mix(exponent, recipe, saved(blocks.select("src", "block", "weight", "whole", "takes", "edge"), "mixture"))


def _located(docs: DataFrame, mix: Mix) -> DataFrame:
    """``docs(doc_id, source, ...)`` with its block's row and ``copies``, the number of times that a document is taken."""
    rows = docs.withColumn("n_src", F.col("source").cast("string"))
    placed = _met(rows, mix.recipe.select("src", "n_blocks"), "n_src", {}).withColumn("mix_block", F.pmod(_draw(), F.col("n_blocks"))).drop("src", "n_blocks")
    found = _met(placed, mix.blocks, "n_src", {"mix_block": "block"})
    partly = F.coalesce(F.col("takes") | (_edge_draw() <= F.col("edge")), F.lit(False))
    return found.withColumn("copies", F.col("whole") + partly.cast("long"))


def mixture(docs: DataFrame, budget_tokens: int | None = None, entropy_share: float | None = 0.97, max_repeats: float | None = 4.0) -> DataFrame:
    """One row per document and pass in which it is taken: ``(doc_id, source, n_tokens, weight, epoch, block, block_rank)``.

    ``budget_tokens`` is the corpus's own size by default. (epoch, block_rank, doc_id) is the order of the mixture
    within a source. Repeated rows are taken together or not at all, null doc_ids likewise; an empty table gives none.
    """
    items = saved(token_counts(docs), "tokens")
    if budget_tokens is None:
        budget_tokens = items.agg(F.sum("n_tokens")).first()[0] or 0
    mix = solve(items, budget_tokens, entropy_share, max_repeats)
    taken = _located(items, mix)
    passes = mix.blocks.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("whole"))))
    order = Window.partitionBy("src", "epoch").orderBy(F.xxhash64(F.lit(SEED), "src", "block", "epoch"), "block")
    ranks = passes.select(F.col("src").alias("r_src"), F.col("block").alias("r_block"), F.col("epoch").alias("r_epoch"), F.row_number().over(order).alias("block_rank"))
    copies = taken.where("copies > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    # Rows that only the last, partial pass takes carry the number of that pass.
    ranked = _met(copies.drop("src"), ranks.withColumnRenamed("r_src", "src"), "n_src", {"mix_block": "r_block", "epoch": "r_epoch"})
    return ranked.select("doc_id", "source", "n_tokens", "weight", F.col("epoch").cast("long").alias("epoch"), F.col("mix_block").alias("block"), "block_rank")


def mixed_documents(docs: DataFrame, entropy_share: float | None = None, max_repeats: float = 1.25) -> DataFrame:
    """``docs`` with each row as often as the mixture takes it, at least once and at most ``ceil(max_repeats)`` times.

    The budget is the least that passes over every source at least once, so no document is left out; small sources are
    repeated towards equal weights. Columns as in ``docs``.
    """
    items = saved(token_counts(docs), "tokens")
    mix = solve(items, None, 1.0 if entropy_share is None else entropy_share, max_repeats)
    inner = docs.select(row_of(docs).alias("row"), "doc_id", "source")
    taken = _located(inner, mix)
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("pass")).select("row.*")
