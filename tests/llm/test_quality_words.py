"""Words of many texts at once, each different one looked up once, against the words of each text."""

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from strideframe.llm import quality_net

TEXTS = [None, "", " \n", "a A b\t\x0bÉ\x1cx\x85 " + "w" * 70, "Abc-12.34!! xX99", "a a a b\r\n", "é É 日本 \x00", "rare", "the end the End"]


def shape(word: bytes) -> bytes:
    kinds = re.sub(rb"[0-9]+", b"9", re.sub(rb"[A-Z]+", b"X", re.sub(rb"[a-z\x80-\xff]", b"\x00", word)))
    return re.sub(b"x+", b"x", kinds.replace(b"\0", b"x")) if b"\0" not in word else quality_net.shape(word)


def test_a_different_word_is_looked_up_once(monkeypatch):
    looked = []
    ids = quality_net.Stream.ids
    monkeypatch.setattr(quality_net.Stream, "ids", lambda self, tokens: looked.append(len(tokens)) or ids(self, tokens))
    owner, words, _ = quality_net.read(quality_net.Stream([b"day"]), quality_net.Stream([b"x"]), pa.array(["the day and the night"] * 500))
    assert looked == [4, 4] and len(words) == len(owner) == 2500 and (words == 0).sum() == 500


def test_ids_and_means_of_many_texts_are_those_of_each():
    streams = quality_net.Stream([b"a", b"b", b"the"]), quality_net.Stream([b"X", b"x"])
    own = [(t or "").encode().split() for t in TEXTS]
    # Of a slice too, whose buffers start further on.
    for start in (0, 3):
        owner, *ids = quality_net.read(*streams, pa.array(TEXTS).slice(start))
        assert owner.tolist() == [i for i, ws in enumerate(own[start:]) for _ in ws]
        for stream, got, name in zip(streams, ids, (bytes.lower, shape)):
            places = {w: i for i, w in enumerate(stream.names())}
            want = [name(w) for ws in own[start:] for w in ws]
            assert [places.get(w, -1) for w in want if w in stream.vocabulary.to_pylist()] == [i for i, w in zip(got.tolist(), want) if w in stream.vocabulary.to_pylist()]
            assert (got < len(places)).all() and len({(w, i) for w, i in zip(want, got.tolist())}) == len(set(want))
    vectors = [np.random.default_rng(1).normal(size=(len(s.names()), quality_net.DIMENSIONS)).astype(np.float32) for s in streams]
    pooled = quality_net.Pooler(*streams, *vectors).pool(pa.array(TEXTS))
    for row, text in zip(pooled, TEXTS):
        _, words, shapes = quality_net.read(*streams, pa.array([text], pa.string()))
        n = len(words)
        if not n:
            assert not row.any()
            continue
        different = np.unique(words)
        size = [math.log(n), len(different) / n, (len(set(zip(words, words[1:]))) + 1) / n]
        assert row == pytest.approx(np.concatenate([vectors[0][words].mean(0), vectors[0][different].mean(0), vectors[1][shapes].mean(0), size]), abs=1e-6)
    assert quality_net.Pooler(*streams, *vectors).pool(pa.array([], pa.string())).shape == (0, 3 * quality_net.DIMENSIONS + 3)


def test_shapes():
    words = [w for t in TEXTS for w in (t or "").encode().split() if b"\0" not in w]
    assert quality_net.shaped(pa.array(words, pa.binary())).to_pylist() == [shape(w) for w in words]
    assert quality_net.shaped(pa.array([], pa.binary())).to_pylist() == [] and quality_net.shape(b"") == b""


@pytest.mark.parametrize("held", [0, 1 << 25])
def test_counts_and_contexts_by_portions(spark, monkeypatch, held):
    monkeypatch.setattr(quality_net, "TEXT_AT_ONCE", 16)
    monkeypatch.setattr(quality_net, "COUNTS_AT_ONCE", held)
    docs = spark.createDataFrame([(t,) for t in TEXTS], "text string").coalesce(1)
    words, shapes = quality_net._vocabularies(docs)
    own = [(t or "").encode().split() for t in TEXTS]
    for stream, name, context in zip((words, shapes), (bytes.lower, quality_net.shape), quality_net.context_vectors(docs, words, shapes)):
        texts = [[name(w) for w in ws] for ws in own]
        n = Counter(w for ws in texts for w in ws)
        known = stream.vocabulary.to_pylist()
        assert known == sorted(w for w, k in n.items() if k > 1 and len(w) <= quality_net.LONGEST)
        want = np.zeros((len(known), quality_net.DIMENSIONS))
        names, ids = stream.names(), [stream.ids(pa.array(ws, pa.binary())).tolist() for ws in texts]
        for row in ids:
            for i, a in enumerate(row):
                for b in row[max(0, i - 2) : i] + row[i + 1 : i + 3]:
                    if a < len(known):
                        want[a] += quality_net.dense([names[b]])[0]
        assert (context == want).all()
