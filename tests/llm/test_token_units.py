"""Texts cut into units by their bytes, and the bounded table of units."""

import random

import numpy as np
import pyarrow as pa

from strideframe.llm import token_orc

PARTS = ["a", "don't", "'s", "'", "-", "12", " ", " ", "  ", "\n", "\r\n", "\xa0", "\x85", " ", "　", "\x1c", "᠎", "é", "×", "½", "é", "日本", "😀", "!?", "(", "w" * 80, "<|endoftext|>", "<|"]


def test_a_unit_is_looked_up_once_among_any_white_space(monkeypatch):
    """Line ends, indents, brackets and double spaces neither make new units of the words beside them nor set a text apart."""
    encoder = token_orc.Encoder(token_orc.default_tokenizer())
    met = []
    ids_of = encoder.ids_of
    monkeypatch.setattr(encoder, "ids_of", lambda units: ids_of(met.extend(x := list(units)) or x))
    words = ["day", "night", "and", "then"]
    rnd = random.Random(1)
    texts = ["".join(rnd.choice(words) + rnd.choice([" ", ", ", "  ", ".\n", "\n  ", " (", ") "]) for _ in range(2000)) for _ in range(20)]
    ids = encoder.ended(pa.array(texts))
    assert [np.array(x[:-1], "<i4").tobytes() for x in ids.to_pylist()] == encoder.whole(texts)
    assert len(met) < 100


def test_a_small_table_of_units_keeps_common_ones_and_gives_the_same_ids(monkeypatch):
    monkeypatch.setattr(token_orc, "CACHE", 50)
    encoder = token_orc.Encoder(token_orc.default_tokenizer())
    rnd = random.Random(5)
    texts = ["the end", *("".join(rnd.choice(PARTS) for _ in range(rnd.randrange(20))) for _ in range(3000))]
    got = []
    for i in range(0, len(texts), 100):
        part = encoder.ended(pa.array(texts).slice(i, 100))
        part.validate(full=True)
        got += [np.array(x, "<i4").tobytes() for x in part.to_pylist()]
        assert len(encoder.known) == len(encoder.ids) == len(encoder.weight) <= 50
    assert got == [x + bytes(4) for x in encoder.whole(texts)]
    assert "a" in encoder.known.to_pylist() and "w" * 80 not in encoder.known.to_pylist()
