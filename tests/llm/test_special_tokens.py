"""Token ids of texts that hold an added token's string, against the library as it is loaded."""

import random
import zlib

import numpy as np
from tokenizers import Tokenizer

from strideframe.llm import token_orc


def test_added_tokens_as_in_the_library(spark):
    tk, rng = Tokenizer.from_file(token_orc.default_tokenizer()), random.Random(8)
    added = [t.content for t in tk.get_added_tokens_decoder().values()]
    parts = [*added, *(a[:-1] for a in added), "abc", " ", "  ", "\n", "def", "!", "é", "<|", "|>", "'s"]
    texts = [f"abc {added[0]} def", *added, *("".join(rng.choice(parts) for _ in range(rng.randint(1, 30))) for _ in range(300)), "no such string"]
    want = [tk.encode(t, add_special_tokens=False).ids for t in texts]
    assert want[0] == [39305, 220, 50256, 825]
    assert [np.frombuffer(x, "<i4").tolist() for x in token_orc.Encoder(token_orc.default_tokenizer())(texts)] == want
    out = token_orc.token_report(spark.createDataFrame(list(enumerate(texts[:40])), "doc_id long, text string")).collect()
    start = np.r_[0, np.cumsum([len(w) + 1 for w in want])]
    assert sorted(map(tuple, out)) == [(i, int(start[i]), len(w) + 1, zlib.crc32(np.array([*w, 0], "<u4").tobytes())) for i, w in enumerate(want[:40])]
