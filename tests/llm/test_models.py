"""Trained operators and the mixture against plain readings of the same rules."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from support import DATA

from strideframe.llm import hmm, mixing, quality_net


def test_hmm_scores_end_to_end(documents, rows):
    """Every text by itself: counts, classes, forward and backward token by token."""
    texts = {d: hmm.tokens(t.encode()) for d, t in rows}
    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d in texts}
    c = Counter(w for d, ws in texts.items() if not held[d] for w in ws)
    common = [w for w, _ in sorted(c.items(), key=lambda x: (-x[1], x[0])) if len(w) <= hmm.LONGEST][: hmm.FREQUENT]
    place = {w: i for i, w in enumerate(common)}
    classes = {d: [place[w] if w in place else hmm.ending_class(w) for w in ws] + [hmm.END] for d, ws in texts.items()}
    n, v = np.zeros(hmm.CLASSES), np.zeros(hmm.CLASSES)
    for w, m in c.items():
        k = place[w] if w in place else hmm.ending_class(w)
        n[k] += m
        v[k] += 1
    learnt = sum(not h for h in held.values())
    n[hmm.END], v[hmm.END] = learnt, 1

    def forward(model, seq):
        a, out, total = None, [], 0.0
        for t, o in enumerate(seq):
            a = (model.first if t == 0 else a @ model.step) * model.emit[:, o]
            total += math.log10(a.sum())
            a = a / a.sum()
            out.append(a)
        return out, total

    model, before = hmm.Model.start(), -math.inf
    for _ in range(hmm.ROUNDS):
        first, step, emit, likely, size = np.zeros(hmm.STATES), np.zeros((hmm.STATES,) * 2), np.zeros((hmm.STATES, hmm.CLASSES)), 0.0, 0
        for d, seq in classes.items():
            if held[d]:
                continue
            alpha, total = forward(model, seq)
            likely, size, beta = likely + total, size + len(seq), np.ones(hmm.STATES)
            for t in range(len(seq) - 1, -1, -1):
                gamma = alpha[t] * beta / (alpha[t] @ beta)
                emit[:, seq[t]] += gamma
                if t == 0:
                    first += gamma
                    break
                ahead = model.emit[:, seq[t]] * beta
                joint = alpha[t - 1][:, None] * model.step * ahead[None]
                step += joint / joint.sum()
                beta = model.step @ ahead
                beta = beta / beta.sum()
        model = hmm.Model.from_counts(first, step, emit)
        if likely / size - before < hmm.LEAST_GAIN:
            break
        before = likely / size
    out = {r.doc_id: r.score for r in hmm.hmm_scores(documents).collect()}
    for d, ws in texts.items():
        within = sum(math.log10((m + 1) / (n[k] + v[k] + 1)) for k, m in zip(classes[d], [*(c[w] for w in ws), learnt]))
        assert out[d] == pytest.approx(forward(model, classes[d])[1] + within, rel=1e-5)


def test_cut_sequences_count_as_whole_ones(monkeypatch):
    rng = np.random.default_rng(6)
    model = hmm.Model.start(4)
    sequences = [rng.integers(0, hmm.CLASSES, n).astype("<u2") for n in (1, 7, 8, 9, 40, 3, 64, 23)]
    whole = hmm.expected_counts(model, sequences)
    assert whole[0].sum() == pytest.approx(len(sequences)) and whole[2].sum() == pytest.approx(sum(map(len, sequences))) and whole[1].sum() == pytest.approx(sum(len(s) - 1 for s in sequences))
    assert whole[3] == pytest.approx(hmm.log10_likelihoods(model, sequences).sum())
    alone = hmm.log10_likelihoods(model, sequences)
    monkeypatch.setattr(hmm, "PIECE", 8)
    assert all(np.allclose(a, b) for a, b in zip(hmm.expected_counts(model, sequences), whole))
    assert np.allclose(hmm.log10_likelihoods(model, sequences), alone, rtol=1e-12)


def test_quality_scores_by_hand(spark, documents, rows):
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    words = [t.encode().split() for _, t in rows]
    streams = [[[w.lower() for w in ws] for ws in words], [[quality_net.shape(w) for w in ws] for ws in words]]
    tables = []
    for texts in streams:
        n = Counter(t for ws in texts for t in ws)
        vocabulary = {t for t, _ in sorted(((t, m) for t, m in n.items() if m > 1 and len(t) <= quality_net.LONGEST), key=lambda x: (-x[1], x[0]))[: quality_net.VOCABULARY]}
        name = lambda t: t if t in vocabulary else b"\n%d" % (zlib.crc32(t) % quality_net.BUCKETS)  # noqa: B023, E731
        index = {}
        for t in {name(t) for t in n}:
            index[t] = quality_net.dense([t])[0]
        context = defaultdict(lambda: np.zeros(quality_net.DIMENSIONS))
        for ws in texts:
            for i, t in enumerate(ws):
                if t in vocabulary:
                    for j in range(max(0, i - quality_net.WINDOW), min(len(ws), i + quality_net.WINDOW + 1)):
                        if j != i:
                            context[t] += index[name(ws[j])]
        vector = lambda t: index[name(t)] / quality_net.NONZERO**0.5 + (context[t] / max(np.linalg.norm(context[t]), 1e-9) if t in vocabulary else 0)  # noqa: B023, E731
        tables.append({t: vector(t) for t in n})
    x = []
    for ws, shapes in zip(*streams):
        if not ws:
            x.append(np.zeros(3 * quality_net.DIMENSIONS + 3))
            continue
        # Rare words that share an index vector are one word.
        distinct = {tuple(tables[0][w]): tables[0][w] for w in ws}
        pairs = {(tuple(tables[0][a]), tuple(tables[0][b])) for a, b in zip(ws, ws[1:])}
        size = [math.log(len(ws)), len(distinct) / len(ws), (len(pairs) + 1) / len(ws)]
        x.append(np.concatenate([np.mean([tables[0][w] for w in ws], axis=0), np.mean(list(distinct.values()), axis=0), np.mean([tables[1][s] for s in shapes], axis=0), size]))
    x = np.array(x)
    at = {d: i for i, (d, _) in enumerate(rows)}
    learn = sorted((r.doc_id, r.quality) for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 4 != 2)
    aside = np.array([zlib.crc32(b"aside%d" % d) % 5 == 0 for d, _ in learn])
    fx, fy = x[[at[d] for d, _ in learn]], np.array([q for _, q in learn], float)
    network = quality_net.Network.fit(fx[~aside], fy[~aside]).calibrated(fx[aside], fy[aside])
    want = network.probability(x)
    got = {r.doc_id: r.score for r in quality_net.quality_scores(documents, labels).collect()}
    assert np.allclose([got[d] for d, _ in rows], want, atol=5e-3)


def test_mixture_by_hand(documents):
    """Blocks, passes and the edge of each source, from the documents' draws."""
    draws = documents.select("doc_id", "source", "text", F.xxhash64(F.lit(mixing.SEED), "doc_id").alias("a"), F.xxhash64(F.lit(mixing.SEED + 1), "doc_id").alias("b")).collect()
    tokens = {r.doc_id: len((r.text or "").encode().split()) for r in draws}
    by = defaultdict(list)
    for r in draws:
        by[r.source].append(r)
    shares = [mixing.Share(s, sum(tokens[r.doc_id] for r in rs), len(rs)) for s, rs in sorted(by.items())]
    budget = sum(tokens.values())
    a = mixing.solve_exponent(shares, budget, 0.97, 4.0)
    want = Counter()
    for share, passes in zip(shares, mixing.repetitions(shares, mixing.weights_at(shares, a), budget)):
        whole = math.floor(passes + 1e-9)
        rest = max(0, math.floor((passes - whole) * share.tokens + 1e-6))
        for r in by[share.source]:
            want[r.doc_id] += whole
        n_blocks = mixing.n_blocks(share.docs)
        blocks = defaultdict(list)
        for r in by[share.source]:
            blocks[r.a % n_blocks].append(r)
        order = {r.block: r.o for r in documents.sparkSession.createDataFrame([(share.source, b, whole) for b in blocks], "src string, block long, whole long").select("block", F.xxhash64(F.lit(mixing.SEED), "src", "block", "whole").alias("o")).collect()}
        for b in sorted(blocks, key=lambda b: (order[b], b)):
            size = sum(tokens[r.doc_id] for r in blocks[b])
            if size <= rest:
                rest -= size
                want.update(r.doc_id for r in blocks[b])
                continue
            filled = 0
            for r in sorted(blocks[b], key=lambda r: r.b):
                filled += tokens[r.doc_id]
                if filled <= rest:
                    want[r.doc_id] += 1
            break
    got = Counter(r.doc_id for r in mixing.mixture(documents).collect())
    assert got == Counter({d: n for d, n in want.items() if n})
