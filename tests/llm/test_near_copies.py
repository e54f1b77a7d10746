"""Near copies of the pipeline against all pairs."""

import numpy as np

from strideframe.llm import simhash


def five_words(text):
    w = text.encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_one_of_each_finds_all_near_copies(spark):
    import random

    rng, texts = random.Random(4), []
    for _ in range(25):
        base = [rng.choice("abcdefghij") + str(rng.randint(0, 999)) for _ in range(rng.randint(40, 300))]
        texts.append(base)
        for changes in (1, 2, 4, 8):
            copy = list(base)
            for _ in range(changes):
                copy[rng.randrange(len(copy))] = "changed%d" % rng.randint(0, 99)
            texts.append(copy)
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    sets, label = [five_words(t) for _, t in rows], list(range(len(rows)))
    fp = np.array([simhash.fingerprint(t.encode()) for _, t in rows], np.uint64)
    links = [(i, j) for i in label for j in range(i) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) or np.bitwise_count(fp[i] ^ fp[j]) <= 3]
    assert sum(np.bitwise_count(fp[i] ^ fp[j]) > 3 for i, j in links) > 10
    for _ in rows:
        for i, j in links:
            label[i] = label[j] = min(label[i], label[j])
    kept = simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(label))
