"""Keyed fitness state over restarts: late, repeated, changed and bad records, seeds, quiet keys."""

import math
import tempfile

import pytest

from strideframe.streaming import fitness

C42, C7 = math.exp(-1 / 42), math.exp(-1 / 7)
SCHEMA = "id long, key long, day int, load string"


def run(spark, at, rows, **options):
    if rows:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{at}/in")
    stream = spark.readStream.schema(SCHEMA).parquet(f"{at}/in")
    fitness.land_states(fitness.fitness_states(stream, **options), f"{at}/out", f"{at}/ck").awaitTermination()
    return {r.key: (r.day, r.ctl, r.atl) for r in fitness.current_fitness(spark, f"{at}/out").collect()}


def by_days(loads, last, seed=None):
    """Fitness and fatigue day by day from the first day, or from a seed (day, ctl, atl)."""
    day, ctl, atl = seed or (min(loads) - 1, 0.0, 0.0)
    while day < last:
        day += 1
        x = loads.get(day, 0.0)
        ctl, atl = ctl * C42 + (1 - C42) * x, atl * C7 + (1 - C7) * x
    return pytest.approx((last, ctl, atl))


def test_state_lives_on_between_runs(spark):
    at = tempfile.mkdtemp(prefix="spark-")
    before = {k: spark.conf.get(k, None) for k in fitness.NEEDS}
    seeds = spark.createDataFrame([(2, 0, 50.0, 40.0), (9, 0, 1.0, 1.0)], "key long, day int, ctl double, atl double")
    first = run(spark, at, [(1, 1, 3, "100"), (2, 1, 5, "50.5"), (3, 2, 4, "80"), (4, 1, 6, "bad"), (5, 1, None, "7"), (6, 1, 6, None), (None, 1, 6, "5"), (7, 3, 1, "inf")], seeds=seeds)
    assert first == {1: by_days({3: 100, 5: 50.5}, 5), 2: by_days({4: 80}, 4, (0, 50.0, 40.0))}
    # Late, again, changed in load and day, and bad beside good.
    second = run(spark, at, [(8, 1, 1, "60"), (1, 1, 3, "100"), (2, 1, 4, "20"), (10, 2, 9, "10"), (11, 2, 9, "NaN")], seeds=seeds)
    assert second == {1: by_days({1: 60, 3: 100, 4: 20}, 5), 2: by_days({4: 80, 9: 10}, 9, (0, 50.0, 40.0))}
    assert run(spark, at, [], seeds=seeds) == second
    lost = sorted((r.batch, r.key, r.id or 0, r.reason) for r in fitness.landed(spark, f"{at}/out", "rejected").collect())
    assert lost == [(0, 1, 0, "missing_required_input"), (0, 1, 4, "out_of_domain"), (0, 1, 5, "missing_required_input"), (0, 1, 6, "missing_required_input"), (0, 3, 7, "out_of_domain"), (1, 2, 11, "out_of_domain")]
    assert {k: spark.conf.get(k, None) for k in fitness.NEEDS} == before


def test_quiet_keys_are_told_and_old_records_forgotten(spark):
    at = tempfile.mkdtemp(prefix="spark-")
    run(spark, at, [(1, 1, 3, "100"), (3, 3, 3, "5")], quiet_ms=1, known_ms=1)
    again = run(spark, at, [(1, 1, 3, "100"), (2, 2, 3, "10")], quiet_ms=1, known_ms=1)
    assert again[1] == by_days({3: 200}, 3)  # it was known for a millisecond only
    assert {r.key for r in fitness.landed(spark, f"{at}/out", "quiet").collect()} == {3}
