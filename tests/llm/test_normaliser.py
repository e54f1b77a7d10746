"""Charsmaps compiled from a model against the library's own normaliser."""

import random

import sentencepiece

from strideframe.llm import piece_fst


def test_charsmap_equals_the_library():
    library = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc")
    mine, rng = piece_fst.Normaliser(piece_fst.normaliser_of(library.serialized_model_proto())), random.Random(5)
    for _ in range(1500):
        t = "".join(rng.choice("ﬁ①Ａｂ　é é​\t\n x  yＺ½℃㍿かが゛ｶﾞ한") for _ in range(rng.randint(0, 12)))
        assert mine(t) == library.normalize(t).replace(" ", piece_fst.SPACE)
