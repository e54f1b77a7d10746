"""Records of resolved fields: candidates are shuffled once, and the rows are those of the winners of each field by itself."""

import random
from datetime import datetime

from pyspark.sql import functions as F
from support import DATA

from strideframe.operators import contribute, resolve
from strideframe.plans import contributing


def test_candidates_are_shuffled_once(spark):
    plan = contributing.coverage_records(spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 2  # candidates, failures


def test_records_are_those_of_each_field_alone(spark):
    rng = random.Random(6)
    pick = lambda *x: rng.choice(x)
    rows = [
        (rng.randrange(120), f"c{rng.randrange(400)}", pick("a", "b", "c"), pick("raw_stream", "modeled", "other", None), pick(None, 0.5, 1.0), pick(None, datetime(2024, 1, 1), datetime(2024, 1, 2)), pick(None, True, False), pick(None, 100.0, 104.0, 120.0), pick(None, 5.0, 9.0), pick(None, "run", "ride"))
        for _ in range(700)
    ]
    rows = list({(r[0], r[1]): r for r in rows}.values())
    df = spark.createDataFrame(rows, "key long, candidate_id string, source string, tier string, confidence double, observed timestamp, has_streams boolean, value double, start_time double, sport string")
    got = {(r.key, r.field): r for r in contribute.field_records(df, ["key"], ["value", "start_time"], ["sport"]).collect()}
    long = contribute._by_field(df, ["key"], ["value", "start_time"], ["sport"]).withColumn("compared", F.when(F.col("field") == "value", F.col("number")))
    want = {(r.key, r.field): r for r in resolve.winners(long, ["key", "field"], ["candidate_id"], value="compared").collect()}
    assert len(got) == 3 * len({r[0] for r in rows}) and {k for k, r in got.items() if r.present} == set(want)
    for k, r in want.items():
        g = got[k]
        assert (g.number, g.word, g.source, g.candidate_id, g.rule, g.n_considered, g.disputed) == (r.w.number, r.w.word, r.w.source, r.w.candidate_id, r.rule, r.n, r.disputed), k
