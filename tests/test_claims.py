"""Claims in texts against direct reading of the same rules."""

import pytest
from pyspark.sql import functions as F

from strideframe.operators import claims


def test_binding(spark):
    labels = {"fitness": "ctl", "form": "tsb", "fatigue": "atl"}
    rows = [
        ("Your fitness is 90.", "ctl", "2024-06-01", None), ("Your fitness is 90.", "tsb", "2024-06-01", "metric_mismatch"), ("It is 90 today.", "tsb", "2024-05-01", "stale_as_of"), ("It is 90 today.", "tsb", "2024-06-09", None), ("It is 90 today.", "tsb", "2024-06-08", "stale_as_of"),
        ("On 2024-05-01 it is 90 today.", "tsb", "2024-05-01", None), ("It was 90.", "tsb", "2024-05-01", None), ("misfitness 90", "tsb", None, None), (None, "tsb", "2024-05-01", None),
    ]
    df = spark.createDataFrame(rows, "s string, m string, d string, want string")
    got = df.select("want", claims.binding_violation(F.col("s"), F.col("m"), F.col("d"), labels, F.to_date(F.lit("2024-06-10")), ("today", "now")).alias("got")).collect()
    assert [r.got for r in got] == [r.want for r in got]


@pytest.mark.parametrize(("text", "want"), [("Please no hard running, I enjoy cycling a lot these days and weeks", ["run"]), ("nie mehr Berge, keine Sprints oder Lauf am Tag", ["hill", "sprint"]), ("I enjoy running", []), ("", [])])
def test_forbidden(spark, text, want):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(claims.forbidden_activities(F.col("t"), ("no", "not", "avoid", "nie")).alias("x")).first().x == want


def test_displayed_values_are_those_of_the_exact_double(spark):
    import random
    import struct

    from strideframe.functions.scalars import display

    rng = random.Random(8)
    xs = [0.15, 2.45, 0.25, 0.35, 0.75, -0.04, -0.05, 0.05, 1e15 + 0.125, 1e15 + 0.625, 2.0**53 + 2, 1e17, -3e18, 4503599627370497.5, 899999999999999.95, 0.0, -0.25, 84.0]
    xs += [rng.randrange(10**7) / 100 for _ in range(20_000)] + [rng.randrange(10**8) / 1000 for _ in range(20_000)] + [rng.uniform(-1e4, 1e4) for _ in range(10_000)] + [rng.randrange(4 * 10**6) / 8 * 2.0 ** rng.randrange(-3, 12) for _ in range(20_000)]
    xs += [x for x in (struct.unpack("<d", rng.randbytes(8))[0] for _ in range(40_000)) if abs(x) < 2**62]

    def said(x):
        r = round(x, 1)
        return str(int(r)) if r == int(r) else f"{r:.1f}"

    out = spark.createDataFrame([(x,) for x in xs], "x double").select("x", display(F.col("x")).alias("s")).collect()
    assert [r.s for r in out] == [said(x) for x in xs]


@pytest.mark.parametrize(
    ("url", "normal", "allowed"),
    [
        (" HTTPS://Run.Example.org/A/b// ", "https://run.example.org/A/b", True), ("https://run.example.org:443/x#frag", "https://run.example.org:443/x#frag", True), ("https://run.example.org?Q=1", "https://run.example.org?q=1", True),
        ("http://run.example.org/", "http://run.example.org", False), ("https://run.example.org.evil.net/x", "https://run.example.org.evil.net/x", False), ("https://run.example.org@evil.net/", "https://run.example.org@evil.net", False), ("Run.Example.org/A", "run.example.org/a", False), ("a/b://C/D", "a/b://c/D", False), (None, None, False),
    ],
)
def test_links(spark, url, normal, allowed):
    from strideframe.operators import text

    row = spark.createDataFrame([(url,)], "u string").select(text.normal_link(F.col("u")).alias("n"), text.allowed_link(F.col("u"), ["run.example.org"]).alias("a")).first()
    assert (row.n, row.a) == (normal, allowed)
