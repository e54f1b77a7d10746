"""Session identity shuffles its recordings twice, and those with a fingerprint once more before."""

from support import DATA

from strideframe.operators import lifecycle
from strideframe.plans import lifecycle as queries

SCHEMA = "athlete long, sport string, id string, start timestamp, duration_s double, fingerprint long"


def test_shuffles_of_session_identity(spark):
    plan = queries.session_identity(spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") <= 4


def test_repeated_and_missing_fields(spark):
    from datetime import datetime, timedelta

    at = lambda s: None if s is None else datetime(2024, 1, 1) + timedelta(seconds=s)
    rows = [
        (1, "a", "p", 0, 100.0, 5), (1, "a", "q", 900, 100.0, 5), (1, "a", "q", 5000, 100.0, None), (1, "a", "r", 60, 900.0, None), (1, "a", "s", 70, 120.0, None), (1, "a", "t", 70, None, None),
        (1, None, "u", 10, 100.0, None), (1, None, "v", 20, 100.0, None), (2, "a", "w", None, 100.0, None), (2, "a", "x", 10, 100.0, None), (2, "a", None, 10, 100.0, None), (1, "b", "p", 0, 100.0, 5),
    ]
    df = spark.createDataFrame([(a, s, i, at(t), d, f) for a, s, i, t, d, f in rows], SCHEMA)
    out = lifecycle.identities(df)
    assert out.columns == [*df.columns, "session_id"]
    assert sorted((r.athlete, r.sport or "", r.id, r.session_id) for r in out.collect()) == [
        (1, "", "u", "u"), (1, "", "v", "u"), (1, "a", "p", "p"), (1, "a", "q", "p"), (1, "a", "q", "q"), (1, "a", "r", "r"), (1, "a", "s", "p"), (1, "a", "t", "t"), (1, "b", "p", "p"), (2, "a", "w", "w"), (2, "a", "x", "x"),
    ]
