"""Values of given ranks against sorted lists, with one group of nearly all rows."""

import numpy as np
import pytest

from strideframe.operators import ranks, serve


@pytest.mark.parametrize("kind", ["smooth", "ties", "heavy tail", "two values", "one value", "negative"])
def test_hot_groups_are_narrowed_down(spark, kind, monkeypatch):
    monkeypatch.setattr(ranks, "LAST", 40)
    rng = np.random.default_rng(len(kind))
    n = 20_000
    values = {"smooth": rng.random(n), "ties": rng.integers(0, 300, n) + 0.5, "heavy tail": np.exp(rng.normal(0, 30, n)), "two values": rng.integers(0, 2, n) * 1.0, "one value": np.full(n, 3.0), "negative": -rng.random(n) ** 9 * 1e6}[kind]
    rows = [("hot", float(v)) for v in values] + [(None, 2.0), (None, 1.0), ("nulls", None), ("few", 5.0), ("few", None)]
    table = spark.createDataFrame(rows, "k string, x double").repartition(7)
    wanted = {"first": lambda n: n * 0 + 1, "mid": lambda n: n // 2 + 1 if isinstance(n, int) else (n / 2).cast("long") + 1, "last": lambda n: n * 1, "beyond": lambda n: n + 1}
    out = {r.k: r.asDict() for r in ranks.values_at(table, ["k"], "x", wanted, hot_rows=1000).collect()}
    order = sorted(values.tolist())
    assert out["hot"] == {"k": "hot", "n": n, "first": order[0], "mid": order[n // 2], "last": order[-1], "beyond": None}
    assert out[None] == {"k": None, "n": 2, "first": 1.0, "mid": 2.0, "last": 2.0, "beyond": None} and out["few"]["mid"] == 5.0 and "nulls" not in out


def test_quantiles_are_the_same_either_way(spark):
    table = spark.range(30_000).selectExpr("if(id % 10 = 0, id % 3, 7) AS k", "CAST(pow(hash(id), 3) AS double) AS x")
    one, other = (sorted(map(tuple, serve.quantiles(table, ["k"], "x", hot_rows=h).collect())) for h in (100_000, 5000))
    assert one == other
    want = {r.k: r.p for r in table.groupBy("k").agg({"x": "count"}).select("k").join(table.selectExpr("k", "x"), "k").groupBy("k").agg(__import__("pyspark.sql.functions", fromlist=["expr"]).expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY x)").alias("p")).collect()}
    assert {r[0]: r[3] for r in one} == want
