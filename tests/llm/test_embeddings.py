"""Embedding classes against brute force: planted near pairs at several spreads, repeated ids, several widths."""

from collections import Counter

import numpy as np
import pytest

from strideframe.llm import pq_dedup


def brute(rows):
    """{(vec_id, n_links, component_id)} of rows (vec_id, vector), all vectors sound."""
    n = len(rows)
    near = np.zeros((n, n), bool)
    for width in {len(v) for _, v in rows}:
        at = [i for i, (_, v) in enumerate(rows) if len(v) == width]
        u = np.array([rows[i][1] for i in at], float)
        u /= np.linalg.norm(u, axis=1)[:, None]
        near[np.ix_(at, at)] = u @ u.T >= 0.9
    label = np.array([i for i, _ in rows])
    while True:
        new = np.array([label[row].min() for row in near])
        if (new == label).all():
            return Counter(zip((i for i, _ in rows), (near.sum(1) - 1).tolist(), label.tolist()))
        label = new


def classes(spark, rows, **how):
    table = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in rows], "vec_id long, embedding array<double>")
    return Counter((r.vec_id, r.n_links, r.component_id) for r in pq_dedup.embedding_classes(table, **how).collect())


def test_repeated_ids_and_widths(spark):
    v, w = [1.0, 0.0, 0.1], [1.0, 0.1, 0.0]
    rows = [(7, v), (7, w), (8, v), (1, [0.0, 1.0, 0.0]), (2, [1.0, 0.0]), (3, [1.0, 0.01]), (9, [0.0, 0.0, 2.0]), (9, [0.0, 0.0, 3.0])]
    assert classes(spark, rows) == brute(rows)


@pytest.mark.parametrize("spread", [0.02, 0.05, 0.08])
def test_recall_on_planted_near_vectors(spark, spread):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(300, 16))
    x = np.concatenate([centres + spread * 4 * rng.normal(size=centres.shape) / 2 for _ in range(4)] + [rng.normal(size=(1500, 16))])
    rows = [(int(i), v) for i, v in enumerate(x)]
    want, got = brute(rows), classes(spark, rows)
    links = sum(n * k for (_, n, _), k in want.items())
    assert links > 300
    found = sum(n * k for (_, n, _), k in got.items())
    assert 0.995 * links <= found <= links
    assert sum((want & got).values()) >= 0.99 * len(rows)


def test_links_of_very_small_and_very_large_vectors(spark):
    rows = [(1, [1e-200, 0.0]), (3, [2e-200, 0.0]), (4, [1e200, 1e190]), (5, [2e200, 0.0]), (6, [5e-324, 0.0]), (7, [1.7e308, 1e307]), (8, [0.0, 1e-310]), (9, [0.0, 1e300]), (10, [1e-200, 1e-200])]
    out = {r.vec_id: (r.n_links, r.component_id) for r in pq_dedup.embedding_classes(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert out == {**{i: (5, 1) for i in (1, 3, 4, 5, 6, 7)}, 8: (1, 8), 9: (1, 8), 10: (0, 10)}
