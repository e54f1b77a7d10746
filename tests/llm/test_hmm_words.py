"""Words of many texts at once against words of each text, and passes through pieces against products of matrices."""

from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from strideframe.llm import hmm

TEXTS = [None, "", " \n", "A\tb\x0bÉ\x1cx\x85 " + "w" * 70, "a a a b\r\n", "Zz" + " q" * 40, "\x0c", "é É 日本 x", "last"]


def test_words_of_many_texts_are_those_of_each():
    words, owner = hmm.text_words(pa.array(TEXTS))
    expected = [(w, i) for i, t in enumerate(TEXTS) for w in hmm.tokens((t or "").encode())]
    assert list(zip(words.cast(pa.binary()).to_pylist(), owner.tolist())) == expected
    distinct = words.dictionary_encode().dictionary.cast(pa.binary())
    for some in (distinct, distinct.slice(3), distinct.slice(0, 0)):
        assert hmm.ending_classes(some).tolist() == [hmm.ending_class(w) for w in some.to_pylist()]


@pytest.mark.parametrize("known", [0, 2, 1000])
def test_counts_and_classes_by_portions(spark, monkeypatch, known):
    monkeypatch.setattr(hmm, "TEXT_AT_ONCE", 16)
    batch = pa.record_batch({"doc_id": pa.array(range(len(TEXTS)), pa.int64()), "text": TEXTS, "held_out": [False] * len(TEXTS)})
    assert [r for part in hmm._portions(iter([batch])) for r in part.column("doc_id").to_pylist()] == list(range(len(TEXTS)))
    docs = spark.createDataFrame([(i, t, False) for i, t in enumerate(TEXTS)], "doc_id long, text string, held_out boolean")
    counts = hmm.word_counts(docs)
    every = Counter(w for t in TEXTS for w in hmm.tokens((t or "").encode()))
    assert {bytes(r.word): r.c for r in counts.collect()} == every
    lex, _ = hmm.lexicon(counts, len(TEXTS), known)
    words = lex.words.to_pylist()
    assert len(words) <= known and lex.total == sum(every.values()) + len(TEXTS)
    rows = {r.doc_id: r for r in hmm.encoded(docs, spark.sparkContext.broadcast(lex)).collect()}
    for i, t in enumerate(TEXTS):
        own, r = hmm.tokens((t or "").encode()), rows[i]
        classes = [words.index(w) if w in words else hmm.ending_class(w) for w in own]
        assert np.frombuffer(r.classes, "<u2").tolist() == [*classes, hmm.END]
        assert {bytes(x.word): x.tf for x in r.rest} == Counter(w for w in own if w not in words)
        assert (r.n_tokens, r.n_known) == (len(own) + 1, sum(w in words for w in own) + 1)
        assert r.log_counts == pytest.approx(sum(np.log10(every[w] + 1) for w in own if w in words) + np.log10(len(TEXTS) + 1))


def test_states_pass_through_pieces():
    rng = np.random.default_rng(4)
    model = hmm.Model.start(3)
    pieces = [rng.integers(0, hmm.CLASSES, n) for n in (11, 1, 30, 8)]
    turn = model.step.T
    wholes = []
    for p in pieces:
        act = np.diag(model.emit[:, p[0]])
        for x in p[1:]:
            act = np.diag(model.emit[:, x]) @ turn @ act
        wholes.append(act / act.sum())
    acts = hmm._passed(turn, model.emit, np.repeat(np.eye(3)[:, :, None], 4, 2), pieces)
    ends = hmm._passed(turn, model.emit, np.tile(model.first[:, None], (1, 4)), pieces)
    for i, act in enumerate(wholes):
        assert np.allclose(acts[:, :, i] / acts[:, :, i].sum(), act, rtol=1e-10)
        assert np.allclose(ends[:, i] / ends[:, i].sum(), act @ model.first / (act @ model.first).sum(), rtol=1e-10)
