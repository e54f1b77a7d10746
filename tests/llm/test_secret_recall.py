"""Recall and false alarms of the novelty scan on planted strings, with the dictionary learnt from the same corpus."""

import random
import string

from strideframe.llm import secrets_scan

WORDS = "load user config request handler session client buffer index parser value stream cache render update fetch commit worker queue signal".split()


def name(rng, n):
    parts = [rng.choice(WORDS) for _ in range(n)]
    return parts[0] + "".join(p.capitalize() for p in parts[1:])


def line(rng):
    return f"    {name(rng, 2)} = {name(rng, 3)}({name(rng, 2)}, {rng.randint(0, 9)})  # {' '.join(rng.choice(WORDS) for _ in range(5))}"


def test_planted_keys_are_found_and_names_left_alone(spark):
    rng = random.Random(12)
    alphabets = {"base62": string.ascii_letters + string.digits, "base64": string.ascii_letters + string.digits + "+/", "upper": string.ascii_uppercase + string.digits, "url": string.ascii_letters + string.digits + "-_"}
    openings = ["Authorization Bearer ", "client credential is ", "the api key -> ", "private salt ", "auth header "]
    rows, planted, harmless = [], {}, {}
    for i in range(600):
        lines = [line(rng) for _ in range(rng.randint(4, 12))]
        if i % 3 == 0:
            kind = list(alphabets)[i // 3 % 4]
            key = "".join(rng.choice(alphabets[kind]) for _ in range(rng.choice([24, 32, 40, 64])))
            lines.insert(rng.randrange(len(lines)), "  " + rng.choice(openings) + key)
            planted[i] = key
        elif i % 3 == 1:
            word = [name(rng, 6), "/".join(rng.choice(WORDS) for _ in range(6)), "_".join(rng.choice(WORDS) for _ in range(5)) + "_v2", name(rng, 4) + "KeyToken2"][i // 3 % 4]
            lines.insert(rng.randrange(len(lines)), "  " + rng.choice(openings) + word)
            harmless[i] = word
        rows.append((i, "\n".join(lines)))
    out = {r.doc_id: r for r in secrets_scan.secret_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    texts = dict(rows)

    def found(i):
        cut = [s.split(":") for s in out[i].spans.split(",") if s]
        return [texts[i][int(a) : int(b)] for _, a, b in cut]

    caught = sum(key in "".join(found(i)) or any(key in x for x in found(i)) for i, key in planted.items())
    alarms = sum(bool(found(i)) for i in harmless)
    plain = sum(bool(found(i)) for i in range(600) if i % 3 == 2)
    assert caught >= 0.97 * len(planted), (caught, len(planted))
    assert alarms <= 0.05 * len(harmless) and plain == 0, (alarms, plain, len(harmless))
