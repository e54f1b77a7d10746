"""Texts encoded by their different pieces against the library on whole texts."""

import random

import numpy as np
import pyarrow as pa

from strideframe.llm import token_orc

PARTS = ["a", "B", "the", "don't", "'s", " ", "  ", "\n", "\t", " ", " ", "\x1c", "\x85", ",", ".", "!?", "12", "é", "日本", "　", "\r\n", "_", "(", ")", "<|endoftext|>", "😀", "ß", "\x00", "w" * 80]


def test_pieces_give_the_ids_of_whole_texts(monkeypatch):
    rnd = random.Random(3)
    texts = ["", " ", "a", " a", "a ", "a  b", "a\n b", "a \nb c", *("".join(rnd.choice(PARTS) for _ in range(rnd.randrange(14))) for _ in range(3000))]
    encoder = token_orc.Encoder(token_orc.default_tokenizer())
    whole = [ids + bytes(4) for ids in encoder.whole(texts)]
    for _ in range(2):  # a cold and a warm cache
        assert [np.array(ids, "<i4").tobytes() for ids in encoder.ended(pa.array(texts)).to_pylist()] == whole
    monkeypatch.setattr(encoder, "in_units", False)
    assert [np.array(ids, "<i4").tobytes() for ids in encoder.ended(pa.array(texts[:99])).to_pylist()] == whole[:99]
    assert encoder.ended(pa.array([], pa.string())).to_pylist() == []


def test_a_different_piece_is_looked_up_once(monkeypatch):
    encoder = token_orc.Encoder(token_orc.default_tokenizer())
    met = []
    ids_of = encoder.ids_of
    monkeypatch.setattr(encoder, "ids_of", lambda units: ids_of(met.extend(x := list(units)) or x))
    ids = encoder.ended(pa.array(["so the day and the night " + "and the day " * 500 + "ends"] * 20))
    assert len(ids) == 20 and len(met) < 100


def test_invalid_bytes_and_nulls_are_read_as_text():
    column = pa.array([b"a\xff b", None, b"c"]).view(pa.string())
    assert token_orc.whole_text(column).to_pylist() == ["a� b", "", "c"]
