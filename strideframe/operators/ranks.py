"""Values of given ranks in groups of any size, exactly, with no group in one task.

Small groups: counts of equal values and their running sum. Groups of over ``hot_rows`` rows, of which there are few, are
narrowed down pass by pass: a grid of approximate percentiles brackets each rank, the rows below and inside the bracket
are counted, and the next grid is taken inside. Counts prove each bracket, so that the sketches only decide how many
passes it takes. The last bracket holds few distinct values, which are counted.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOT_ROWS = 1 << 20
#: At most so many groups are narrowed down; with more rows a group may be larger before it counts as hot.
HOT_GROUPS = 50_000
GRID = 256
#: Distinct values in a bracket that are counted at once.
LAST = 50_000

Ranks = dict[str, Callable]  # name -> rank of a number of rows, as a column or a number


@dataclass
class _Search:
    """One rank of one hot group."""

    group: int
    name: str
    rank: int
    n: int
    low: float | None = None  # a proven bracket, ends included; None is open
    high: float | None = None
    grid: list[float] = field(default_factory=list)  # of what is inside the proven bracket
    below: int = 0
    inside: int = 0
    margin: int = 1
    tried: tuple[float | None, float | None] = (None, None)
    done: bool = False

    def __post_init__(self) -> None:
        self.done = not 1 <= self.rank <= self.n  # there is no such value

    def narrow(self) -> None:
        """Try the part of the grid around the rank."""
        at = (self.rank - self.below) * GRID // max(self.inside, 1)
        a, b = at - self.margin, at + 1 + self.margin
        self.tried = (self.grid[a] if a > 0 else self.low, self.grid[b] if b < GRID else self.high)

    def learn(self, below: int, inside: int, distinct: int, grid: list[float]) -> None:
        """Take a counted bracket if it holds the rank, else try a wider one."""
        if below < self.rank <= below + inside:
            smaller = inside < self.inside or not self.grid
            (self.low, self.high), self.below, self.inside, self.grid = self.tried, below, inside, grid
            self.margin = 1 if smaller else 2 * self.margin
            self.done = distinct <= LAST or not smaller
        else:
            self.margin *= 4
        if not self.done:
            self.narrow()


def _same(a: Sequence[str], b: Sequence[str]) -> Column:
    on = F.lit(True)
    for x, y in zip(a, b):
        on = on & F.col(x).eqNullSafe(F.col(y))
    return on


def _by_counts(rows: DataFrame, on: Sequence[str], ranks: Ranks) -> DataFrame:
    counts = rows.groupBy(*on, "v").agg(F.count(F.lit(1)).alias("m"))
    whole = Window.partitionBy(*on)
    upto = counts.withColumn("upto", F.sum("m").over(whole.orderBy("v").rowsBetween(Window.unboundedPreceding, 0))).withColumn("n", F.sum("m").over(whole))
    return upto.groupBy(*on).agg(F.max("n").alias("n"), *(F.min(F.when(F.col("upto") >= rank(F.col("n")), F.col("v"))).alias(name) for name, rank in ranks.items()))


def _of_hot(rows: DataFrame, on: Sequence[str], groups: list, ranks: Ranks) -> DataFrame:
    spark = rows.sparkSession
    keys = spark.createDataFrame([(i, *(r[c] for c in on)) for i, r in enumerate(groups)], ", ".join(["g int", *(f"`k{j}` {rows.schema[c].dataType.simpleString()}" for j, c in enumerate(on))]))
    own = rows.join(F.broadcast(keys), _same(on, [f"k{j}" for j in range(len(on))])).select("g", "v")
    kind = rows.schema["v"].dataType.simpleString()
    searches = [_Search(i, name, int(rank(r["n"])), r["n"]) for i, r in enumerate(groups) for name, rank in ranks.items()]

    def inside_of(todo: list[_Search], bracket: Callable) -> DataFrame:
        brackets = spark.createDataFrame([(s.group, s.name, s.rank, *bracket(s)) for s in todo], f"g int, name string, rank long, low {kind}, high {kind}")
        return own.join(F.broadcast(brackets), "g").withColumn("below", F.coalesce(F.col("v") < F.col("low"), F.lit(False))).where(F.col("high").isNull() | (F.col("v") <= F.col("high")))

    while todo := [s for s in searches if not s.done]:
        v = F.when(~F.col("below"), F.col("v"))
        grid = F.percentile_approx(v, [i / GRID for i in range(GRID + 1)], 4 * GRID)
        counted = inside_of(todo, lambda s: s.tried).groupBy("g", "name").agg(F.count_if("below").alias("below"), F.count(v).alias("inside"), F.approx_count_distinct(v).alias("distinct"), grid.alias("grid")).collect()
        found = {(r.g, r.name): r for r in counted}
        for s in todo:
            r = found.get((s.group, s.name))
            s.learn(*((r.below, r.inside, r.distinct, list(r.grid or [])) if r else (0, 0, 0, [])))
    last = inside_of(searches, lambda s: (s.low, s.high))
    # What lies below a bracket counts as one value, so that a key has no more rows than the bracket has values.
    below = last.where("below").groupBy("g", "name", "rank").agg(F.min("v").alias("v"), F.count(F.lit(1)).alias("m"))
    inside = last.where("NOT below").groupBy("g", "name", "rank", "v").agg(F.count(F.lit(1)).alias("m"))
    upto = F.sum("m").over(Window.partitionBy("g", "name").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    ranked = inside.unionByName(below).withColumn("upto", upto)
    per_name = ranked.groupBy("g").agg(*(F.min(F.when((F.col("name") == name) & (F.col("upto") >= F.col("rank")), F.col("v"))).alias(name) for name in ranks))
    sizes = spark.createDataFrame([(i, r["n"]) for i, r in enumerate(groups)], "g int, n long")
    return keys.join(F.broadcast(per_name), "g").join(F.broadcast(sizes), "g").select(*(F.col(f"k{j}").alias(c) for j, c in enumerate(on)), "n", *ranks)


def values_at(rows: DataFrame, on: Sequence[str], value: str, ranks: Ranks, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``(*on, n, *names)``: for each group the number of its values and the value of each rank, counted from 1; null for a
    rank beyond them. Null values don't count, and a group of nulls alone has no row."""
    given = rows.where(F.col(value).isNotNull()).select(*on, F.col(value).alias("v"))
    sizes = given.groupBy(*on).agg(F.count(F.lit(1)).alias("n"))
    most = sizes.agg(F.max("n"), F.sum("n")).first()
    many = max(hot_rows, (most[1] or 0) // HOT_GROUPS)
    if (most[0] or 0) <= many:
        return _by_counts(given, on, ranks)
    hot = sizes.where(F.col("n") > many).collect()  # at most HOT_GROUPS
    names = [f"k_{j}" for j in range(len(on))]
    table = rows.sparkSession.createDataFrame([tuple(r[c] for c in on) for r in hot], ", ".join(f"{k} {rows.schema[c].dataType.simpleString()}" for k, c in zip(names, on)))
    rest = given.join(F.broadcast(table), _same(on, names), "left_anti")
    return _by_counts(rest, on, ranks).unionByName(_of_hot(given, on, hot, ranks))
