"""Whitening, manifest and line dedup against plain readings, on odd rows and on empty tables."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from strideframe.llm import line_runs, merkle, tsqr

# --- whitening


def by_hand(rows):
    """x vectors, their distinct fit list, eigenvalues and vectors by covariance."""
    x = {i: np.floor(256 * np.asarray(v, float)).astype(int) for i, v in rows}
    fit = np.array(sorted({tuple(v) for v in x.values()}))
    centred = fit - fit.sum(axis=0) / len(fit)
    e, q = np.linalg.eigh(centred.T @ centred / len(fit))
    return x, fit, e[::-1], q[:, ::-1]


def check_whitening(rows, out, width):
    x, fit, e, q = by_hand(rows)
    n, s = len(fit), fit.sum(axis=0)
    assert len(out) == len(rows) * min(4, width)
    for r in out:
        d = n * x[r.vec_id] - s
        k = r.component - 1
        assert r.n == n and r.deviation == int((d * d).sum())
        assert abs(r.whitened) == pytest.approx(abs(d / n @ q[:, k]) / np.sqrt(e[k]), abs=1e-8)
        assert r.explained == pytest.approx(e[k] / e.sum(), rel=1e-9) and r.identity_error < 1e-9
    signs = {(r.component, np.sign(r.whitened * (x[r.vec_id] - s / n) @ q[:, r.component - 1])) for r in out if abs(r.whitened) > 1e-6}
    assert len(signs) == min(4, width)  # one sign a component for all rows


def test_whitening_of_the_table(spark, same):
    from support import DATA

    table = spark.read.parquet(f"{DATA}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in table.collect()]
    check_whitening(rows, tsqr.whitened(table).collect(), 64)


def test_whitening_over_many_partitions_and_repeats(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(200, 6)) @ np.diag([5, 4, 3, 2, 1, 0.5]) + 7
    rows = [(i, base[i % 200].tolist()) for i in range(600)] + [(1000 + i, base[0].tolist()) for i in range(300)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(37)
    check_whitening(rows, tsqr.whitened(table).collect(), 6)


def test_whitening_of_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [0.5, -1.0]), (3, None), (4, []), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (None, [3.0, 3.0]), (8, [1.0, 2.0, 3.0]), (9, [2.0, 2.0, 2.0]), (10, [9.0])]
    out = tsqr.whitened(spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "'x' AS width", "1 AS x", "2 AS n")).collect()
    found = defaultdict(int)
    for r in out:
        found[r.vec_id] += 1
    assert found == {1: 4, 2: 2, None: 2, 8: 1, 9: 1}  # two vectors in three dimensions vary in one; one vector in none
    assert {r.n for r in out if r.vec_id in (1, 2, None)} == {3} and {r.n for r in out if r.vec_id in (8, 9)} == {2}
    assert tsqr.whitened(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_whitening_of_huge_entries(spark):
    rows = [(1, [1e300, 1.0]), (2, [-1e300, 2.0]), (3, [1e12, 3.0])]
    out = tsqr.whitened(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert {r.deviation for r in out} == {None} and all(r.identity_error < 1e-4 for r in out)


def test_exact_differences_beyond_64_bits():
    centre = tsqr.Centre(3, [2**62, 5])
    x = np.array([[2**61, 1], [-(2**61), 2]])
    assert centre.differences(x).tolist() == [[3 * 2**61 - 2**62, -2], [-3 * 2**61 - 2**62, 1]]
    assert centre.deviations(x) == [None, None]
    assert tsqr.Centre(3, [6, 6]).deviations(np.array([[2, 2], [3, 1]])) == [0, 18]


# --- manifest


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(values):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def up(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i : i + 8]) for i in range(0, len(levels[-1]), 8)])
    return levels


def siblings(levels, i):
    path = []
    for level in levels[:-1]:
        a = i // 8 * 8
        path.append(("".join(level[a:i]), "".join(level[i + 1 : a + 8])))
        i //= 8
    return path


def lowered(s):
    return None if s is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in s)


def manifest_by_hand(rows):
    trees = defaultdict(list)
    for r in rows:  # doc_id, source, lang, n_chars, text
        trees["" if r[2] is None else "+" + r[2]].append((r[0] is not None, r[0] or 0, leaf_of(r), r))
    names = sorted(trees, key=str.encode)
    levels = {}
    for t in names:
        trees[t].sort(key=lambda x: x[:3])
        levels[t] = up([x[2] for x in trees[t]])
    top = up([levels[t][-1][0] for t in names])
    out = []
    for k, t in enumerate(names):
        for i, (_, _, leaf, r) in enumerate(trees[t]):
            path = siblings(levels[t], i) + siblings(top, k)
            tampered = zlib.crc32(b"" if r[0] is None else str(r[0]).encode()) % 3 == 0
            node = leaf_of([*r[:4], lowered(r[4])]) if tampered else leaf
            for before, after in path:
                node = h(before, node, after)
            out.append((r[0], leaf, levels[t][-1][0], top[-1][0], h(*(b + a for b, a in path)), node, node == top[-1][0]))
    return out


ORDER = lambda r: (r[0] is not None, r[0] or 0, *map(str, r[1:]))


def found(docs):
    return sorted((tuple(r) for r in merkle.manifest(docs).drop("path").collect()), key=ORDER)


def test_manifest_of_odd_rows(odd):
    rows = [(r.doc_id, r.source, r.lang, r.n_chars, r.text) for r in odd.select("doc_id", "source", "lang", "n_chars", "text").collect()]
    assert found(odd) == sorted(manifest_by_hand(rows), key=ORDER)
    assert merkle.manifest(odd.limit(0)).count() == 0


@pytest.mark.parametrize("n", [1, 2, 8, 9, 65])
def test_manifest_of_few(spark, n):
    rows = [(i, "s", "en", i, f"Text {i}") for i in range(n)]
    assert found(spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")) == sorted(manifest_by_hand(rows), key=ORDER)


def test_manifest_over_several_superblocks_and_many_languages(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice("ab"), "hot" if i % 3 else f"l{i % 97}", i, "Some TEXT " * (i % 3)) for i in range(14_000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(5)
    assert found(docs) == sorted(manifest_by_hand(rows), key=ORDER)


def test_manifest_of_many_languages_with_few_documents(spark):
    rows = [(i, None, f"é{i % 700}", None, None) for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    assert found(docs) == sorted(manifest_by_hand(rows), key=ORDER)


def test_paths_lead_from_the_leaf_to_the_root(documents):
    rows = merkle.manifest(documents).collect()
    for r in rows[:50]:
        assert merkle.folded(r.leaf, [(p.before, p.after) for p in r.path]) == r.root
    assert 0 < sum(not r.verified for r in rows) < len(rows)


# --- line dedup


def lines_by_hand(rows):
    blank = " \t\n\x0b\x0c\r"
    holders = defaultdict(list)
    keys = []
    for doc_id, text in rows:
        keys.append([lowered(x.strip(blank)) for x in (text or "").split("\n")])
        for k in {k for k in keys[-1] if len(k) >= 20}:
            holders[k].append(-1 if doc_id is None else doc_id)
    out = []
    for (doc_id, text), ks in zip(rows, keys):
        stay = [x for x, k in zip((text or "").split("\n"), ks) if len(holders[k]) < 3 or max(holders[k]) == (-1 if doc_id is None else doc_id)]
        out.append((doc_id, len(ks), len(ks) - len(stay), h("\n".join(stay)), "\n".join(stay)))
    return out


def check_lines(spark, rows, **options):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = lines_by_hand(rows)
    got = [tuple(r) for r in line_runs.line_report(docs, **options).collect()]
    assert sorted(got, key=ORDER) == sorted((r[:4] for r in want), key=ORDER)
    texts = [(r.doc_id, r.text or "") for r in line_runs.without_shared_lines(docs, **options).collect()]
    assert sorted(texts, key=ORDER) == sorted(((r[0], r[4]) for r in want), key=ORDER)


def line_rows(n, seed):
    rng = random.Random(seed)
    pool = [f"shared line number {i} of the Pool" for i in range(40)] + ["short", "", "ä" * 19, "ä" * 20, "  PADDED line that is long enough\t", "padded LINE that is long enough"]
    rows = []
    for i in range(n):
        lines = [rng.choice(pool) if rng.random() < 0.5 else f"line {i} {rng.random()} by itself" for _ in range(rng.randint(0, 12))]
        if i % 3 == 0:
            lines.insert(0, "a line that a third of all documents hold")
        rows.append((i, "\n".join(lines)))
    return rows


@pytest.mark.parametrize("batches", [1, 2, 4, 7])
def test_lines_in_batches(spark, batches):
    check_lines(spark, line_rows(300, batches), batches=batches)


def test_lines_of_odd_rows(spark, odd):
    odd_rows = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    check_lines(spark, odd_rows)
    again = line_rows(30, 9)
    check_lines(spark, again + again[:10] + [(None, again[0][1]), (None, again[3][1]), (None, None), (7, "\r\n\n")])
    out = line_runs.without_shared_lines(odd)
    assert out.columns == odd.columns and out.count() == odd.count()
    assert line_runs.line_report(odd.limit(0)).count() == 0


def test_keys_beyond_the_broadcast(spark, monkeypatch):
    monkeypatch.setattr(line_runs, "HOT_KEYS", 5)
    check_lines(spark, line_rows(200, 4))


def test_merges_move_no_entry(spark):
    from pyspark.sql import functions as F

    store = line_runs.LineRuns(spark)
    lines = line_runs.hashed_lines(spark.createDataFrame(line_rows(100, 2), "doc_id long, text string"))
    for i in range(3):
        store.add(lines.where(F.col("doc_id") % 3 == 2 - i))
    assert [len(level) for level in store.levels] == [1, 1]
    a, b = store.runs()
    plan = a.join(b.hint("merge"), line_runs.KEY, "full")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Bucketed: true" in plan
