"""Records of how fields were resolved: ties, absences, failures, substitution and fields that are never in dispute."""

from strideframe.operators import contribute

SCHEMA = "key long, candidate_id string, source long, tier string, confidence double, observed timestamp, has_streams boolean, power double, start_time double, sport string"
ROWS = [
    (1, "a", 7, "device_computed", None, None, False, 200.0, 10.0, "cycling"),
    (1, "b", 5, "device_computed", 1.0, None, True, 230.0, 99.0, None),
    (1, "c", 2, "summary_only", 1.0, None, True, 200.0, 99.0, "running"),
    (2, "d", 1, "raw_stream", 0.5, None, None, None, None, None),
    (3, "e", 1, "raw_stream", 0.5, None, False, 5.0, 1.0, ""),
]


def records(spark, rows, failures=None):
    fails = spark.createDataFrame(failures, "key long, field string") if failures is not None else None
    out = contribute.field_records(spark.createDataFrame(rows, SCHEMA), ["key"], ["power", "start_time"], ["sport"], {"power": "raw_stream"}, fails)
    return {(r.key, r.field): r for r in out.collect()}


def test_winner_rule_and_dispute(spark):
    got = records(spark, ROWS)
    assert len(got) == 9
    power = got[1, "power"]
    # A lacking confidence is 1, so streams decide between a and b.
    assert (power.number, power.candidate_id, power.rule, power.n_considered, power.disputed) == (230.0, "b", "completeness", 3, True)
    assert (power.fidelity, power.from_fidelity) == ("substituted", "raw_stream")
    assert (got[1, "start_time"].number, got[1, "start_time"].disputed, got[1, "start_time"].fidelity) == (99.0, False, "device_computed")
    assert (got[1, "sport"].word, got[1, "sport"].rule, got[1, "sport"].disputed) == ("cycling", "trust_tier", False)
    assert (got[3, "power"].rule, got[3, "power"].fidelity, got[3, "sport"].word) == ("sole_contributor", "raw_stream", "")


def test_absences(spark):
    got = records(spark, ROWS, [(2, "power"), (2, "power"), (3, "power")])
    assert [(got[2, f].present, got[2, f].fidelity, got[2, f].n_considered, got[2, f].rule) for f in ("power", "sport")] == [(False, "absent_failed", 0, None), (False, "absent_true", 0, None)]
    assert got[3, "power"].fidelity == "raw_stream"  # a failure beside a value is no absence
    assert records(spark, []) == {}


def test_considered_has_a_row_for_each_candidate_with_a_value(spark):
    out = contribute.considered(spark.createDataFrame(ROWS, SCHEMA), ["key"], ["power"], ["sport"])
    assert sorted(map(tuple, out.collect())) == [(1, "power", "a"), (1, "power", "b"), (1, "power", "c"), (1, "sport", "a"), (1, "sport", "c"), (3, "power", "e"), (3, "sport", "e")]
