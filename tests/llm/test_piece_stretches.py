"""Stretches of many texts side by side against one by one, and against the library on whole texts."""

import random
import zlib

import numpy as np
import pytest
import sentencepiece

from strideframe.llm import piece_fst

ALPHABET = "aeinrst hth  THE'.,\n0123éß▁{}()=ing日本語안😀\x00\x01�"
ODD = ["", " ", "   ", "a▁b ▁▁", "\x01 \x01\x02", "x" * 5000, "ab " * 40, "<s> </s> <0x41>", "\U0010ffff", "the\n日😀 end "]


@pytest.fixture(scope="module")
def machine():
    return piece_fst.PieceMachine(piece_fst.default_model())


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(2)
    return ODD + ["".join(rng.choice(ALPHABET) for _ in range(rng.randrange(90))) for _ in range(800)]


def test_side_by_side_equals_one_by_one(machine, texts, monkeypatch):
    stretches = [s for t in texts for s in piece_fst._STRETCH.findall(machine.normalise(t))] + ["", "\ud800a"]
    want = [np.array(machine.shortest_path(s), "<i4").tobytes() for s in stretches]
    for at_once in (5, 16_384):
        monkeypatch.setattr(piece_fst, "STRETCHES_AT_ONCE", at_once)
        some = slice(None, 200 if at_once == 5 else None)
        assert machine.shortest_paths(stretches[some]) == want[some]
    assert machine.shortest_paths([]) == []


def test_borders_of_many_pairs(machine):
    rng = np.random.default_rng(3)
    pieces = np.array(sorted(machine.halves) + [machine.ids[c] for c in "aeinrst"])
    left, right = rng.choice(pieces, (2, 20_000))
    want = [machine.border(a, b) == 0 for a, b in zip(left.tolist(), right.tolist())]
    assert 0 < sum(want) < len(want)
    # With a cold and a warm table.
    assert machine.open_borders(left, right).tolist() == want and all(machine.fits(left, right).tolist() == want for _ in range(2))


def test_a_different_stretch_is_worked_once_and_not_alone(machine, monkeypatch):
    worked = []
    side_by_side = machine._side_by_side
    monkeypatch.setattr(machine, "_side_by_side", lambda stretches: worked.extend(stretches) or side_by_side(stretches))
    monkeypatch.setattr(machine, "shortest_path", None)
    monkeypatch.setattr(machine, "young", {})
    monkeypatch.setattr(machine, "old", {})
    ids, borders = machine.encode_all(["the day and\nthe night " * 50] * 20)
    assert len(borders) == 21 and len(worked) == len(set(worked)) < 8
    library = sentencepiece.SentencePieceProcessor(model_file=piece_fst.default_model())
    assert ids[: borders[1]].tolist() == library.encode("the day and\nthe night " * 50)


def test_report_of_odd_texts(spark, machine, texts, monkeypatch):
    monkeypatch.setattr(piece_fst, "TEXT_AT_ONCE", 300)
    library = sentencepiece.SentencePieceProcessor(model_file=piece_fst.default_model())
    rows = spark.createDataFrame([(i, t) for i, t in enumerate([None, *texts])], "doc_id long, text string")
    for r in piece_fst.piece_report(rows, with_pieces=True).collect():
        text = texts[r.doc_id - 1] if r.doc_id else ""
        ids = library.encode(text)
        decoded = library.decode(ids)
        assert r.pieces == ids and r.n_pieces == len(ids) and r.pieces_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        assert r.decoded_chars == len(decoded) and r.round_trip == (decoded == text) and machine.decode(ids) == decoded


def test_a_full_cache_keeps_common_stretches(machine, monkeypatch):
    monkeypatch.setattr(piece_fst, "CACHE", 10)
    monkeypatch.setattr(machine, "young", {})
    monkeypatch.setattr(machine, "old", {})
    for i in range(30):
        text = " ".join(["common", *(f"w{i}x{j}" for j in range(i))])
        ids, borders = machine.encode_all([text, ""])
        assert ids.tolist() == machine.encode(text) and borders.tolist() == [0, len(ids), len(ids)]
        assert len(machine.young) <= 10 and len(machine.old) <= 10
