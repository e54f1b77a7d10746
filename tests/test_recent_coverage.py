"""Coverage of the last weeks: edges of the window, cold starts, values that aren't finite, versions in force."""

from pyspark.sql import functions as F

from strideframe.operators import serve


def test_each_probe_at_its_edges(spark):
    t = lambda rows, schema: spark.createDataFrame(rows, schema).withColumns({c: F.to_date(c) for c in ("day", "effective_date") if c in schema})
    nan, inf = float("nan"), float("inf")
    out = serve.recent_coverage(
        spark.createDataFrame([(k,) for k in (1, 2, 3, 3)], "key long"), F.to_date(F.lit("2024-03-31")),
        t([(1, "2024-02-18", 1.0), (2, "2024-02-17", 50.0), (2, "2024-03-30", 0.99), (2, "2024-03-31", nan), (2, "2024-03-29", inf)], "key long, day string, ctl double"),
        t([(1, "2024-03-31", 300.0), (2, "2024-04-01", 300.0), (3, "2024-03-30", None)], "key long, day string, best_w double"),
        spark.createDataFrame([(1, 250.0), (2, None), (9, 1.0)], "key long, cp_w double"),
        t([(1, "2024-03-30", 50.0), (2, "2024-03-31", 50.0)], "key long, day string, value double"),
        t([(1, "2023-01-01", 240.0, None), (1, "2024-03-31", None, None), (2, "2020-01-01", None, 230.0), (2, "2024-04-01", None, None)], "key long, effective_date string, ftp_w double, cp_w double"),
    )
    got = {r.key: (r.present, r.missing, r.status) for r in out.collect()}
    assert got == {
        1: (["critical_power", "power_curve", "training_load"], ["hrv", "signature"], "completed"),
        2: (["hrv", "signature"], ["critical_power", "power_curve", "training_load"], "completed"),
        3: ([], ["critical_power", "hrv", "power_curve", "signature", "training_load"], "degraded"),
    }
