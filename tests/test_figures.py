"""Numbers of texts with their places, against plain scans of the same texts."""

import random
import re

import pytest

from strideframe.functions import constants as C
from strideframe.operators import figures

UNITS = "|".join(C.PLAIN_UNITS)


def is_open(text, chain, covers):
    """Whether a chain of numbers at a place of a text is open, by the rule's words."""
    spots = [m.span() for m in re.finditer(figures.PLAIN, text, re.I)]
    if any(a <= chain.start() < b for a, b in spots) or re.match(rf"(?:{UNITS})(?![A-Za-z])|%", text[chain.end() :], re.I):
        return False
    words = re.findall(r"[A-Za-z]+(?=\W*$)", text[: chain.start()])
    if words and words[-1].lower() in C.STRUCTURE_WORDS:
        return False
    numbers = [(chain.start() + m.start(), chain.start() + m.end()) for m in re.finditer(figures.NUMBER, chain[0])]
    return not all(any(a <= s and e <= b for a, b in covers) for s, e in numbers)


def scanned(text, covers):
    return [(m.start(), m.end(), m[0]) for m in re.finditer(figures.PHRASE, text) if is_open(text, m, covers)]


TEXTS = [
    "Day 3: 4x8 at 250, then 45m easy, 20% more on 2024-05-01, 3.5 and -4 of 60kg", "lap 7 took 90min; https://a.b/12 gives 12", "weekday 5 isn't Week  6", "", None, "5km 5 km 7h30", "4x8-10 and 3-4x8", "a - 5-7 h b", "- 5", "1.2.3 v1",
    "é 7 ٣ Set é 4", "zone – 4 of 9", "12", "load 311.", "x 5 , y", "reps: 8, Round (2)", "8\n\n9\t10",
]


def random_texts(n, seed):
    rng = random.Random(seed)
    bits = ["load", "Day", "set ", " ", " ", ", ", ". ", "-", " – ", "x", "5", "17", "3.25", "2024-05-01", "4 x 8", "https://h.io/9-8", "km", " min", "%", "é", "(", ")", "\n"]
    return ["".join(rng.choice(bits) for _ in range(rng.randint(0, 14))) for _ in range(n)]


def test_open_chains_and_their_places(spark):
    rng = random.Random(1)
    texts = dict(enumerate(TEXTS + random_texts(400, 2)))
    covers = {i: [m.span() for m in re.finditer(figures.NUMBER, t or "") if rng.random() < 0.4] for i, t in texts.items()}
    covers[1].append((0, 3))
    got = figures.judged(spark.createDataFrame(list(texts.items()), "id long, text string"), spark.createDataFrame([(i, a, b) for i, c in covers.items() for a, b in c], "id long, start int, end int"))
    found = {i: [] for i in texts}
    for r in got.where("open").orderBy("id", "start").collect():
        found[r.id].append((r.start, r.end, r.match))
    assert found == {i: scanned(t or "", covers[i]) for i, t in texts.items()}


@pytest.mark.parametrize(
    ("text", "covered", "want", "n"),
    [
        ("Fitness is 61 and form is 4711.", [(11, 13)], "Fitness is 61 and form is.", 1), ("Ride 5-7 h , then rest", [], "Ride, then rest", 1), ("Ride - 9 now", [], "Ride now", 1), ("Ride 45m on 2024-05-01 in zone 2", [], "Ride 45m on 2024-05-01 in zone 2", 0),
        ("Hold 200-210", [(5, 8)], "Hold", 1), ("Hold 200-210", [(5, 8), (9, 12)], "Hold 200-210", 0), ("  spaced   out  ", [], "  spaced   out  ", 0), ("8 km", [], "", 1), ("now 61 is not 61", [(4, 6)], "now 61 is not", 1),
    ],
)
def test_sweeping(spark, text, covered, want, n):
    out = figures.swept_texts(spark.createDataFrame([(1, text)], "id long, text string"), spark.createDataFrame([(1, a, b) for a, b in covered], "id long, start int, end int")).first()
    assert (out.text, out.n_removed) == (want, n)


CASES = [
    ("Your fitness is 77 and load 770.", [("fitness is 77", "74.5")], "Your fitness is 74.5 and load 770.", [(16, 20)]),
    ("Form -5 now, -5 then", [("Form -5", "-4.8"), ("-5 then", "-6")], "Form -4.8 now, -6 then", [(5, 9), (15, 17)]),
    ("5 and 5", [("5", "7")], "5 and 5", []),
    ("5 and 6", [("5", "7"), ("6", "9")], "7 and 9", [(0, 1), (6, 7)]),
    ("hold 5-7 for long", [("7 for", "-3")], "hold 5--3 for long", [(7, 9)]),
    ("around 1,200 steps", [("1,200 steps", "1,350")], "around 1,350 steps", [(7, 12)]),
    ("load was 40 h , then rest", [("was 40", None)], "load was, then rest", []),
    ("40 then rest", [("40", None)], "then rest", []),
    ("rest then 40", [("then 40", "")], "rest then", []),
    ("a 3 b 3 c", [("a 3", "1"), ("b 3", "2")], "a 1 b 2 c", [(2, 3), (6, 7)]),
    ("a 3 b 3 c", [("not there 3", "1"), ("b 3", "2")], "a 1 b 2 c", [(2, 3), (6, 7)]),
    ("3.25 isn't 3", [("3", "4")], "3.25 isn't 4", [(11, 12)]),
    ("at 10.20.30.40 or 20.30", [("20.30", "4")], "at 10.20.30.40 or 4", [(18, 19)]),
    ("none here", [("12", "3")], "none here", []),
    ("dots \\E. 3", [("\\E. 3", "4")], "dots \\E. 4", [(9, 10)]),
]


def test_restating(spark):
    texts = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)] + [(98, "no claims 3"), (99, None)], "id long, text string")
    claims = spark.createDataFrame([(i, k, said, value) for i, c in enumerate(CASES) for k, (said, value) in enumerate(c[1])] + [(99, 0, "3", "4")], "id long, claim long, said string, value string")
    out = {r.id: (r.text, [tuple(x) for x in r.covered]) for r in figures.restated_texts(texts, claims).collect()}
    assert out == {i: (c[2], c[3]) for i, c in enumerate(CASES)} | {98: ("no claims 3", []), 99: ("", [])}
