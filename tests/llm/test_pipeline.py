"""The pipeline's stages on odd rows, on empty tables, and as a whole."""

from collections import Counter

import corpus_pipeline
import numpy as np
import pytest
from support import DATA
from test_near_copies import five_words

from strideframe.llm import quality_rules, simhash


@pytest.mark.parametrize("at", range(5))
def test_stage_takes_odd_rows_and_none(spark, odd, at):
    name, stage = corpus_pipeline.STAGES[at]
    out = stage(spark, odd, DATA)
    assert out.count() > 0 and stage(spark, odd.where("false"), DATA).count() == 0
    if at < 4:
        assert out.columns == odd.columns


def test_whole_run(spark, rows):
    """Documents that stay, by all pairs: good ones, one of each class by fingerprint or by five words."""
    out = Counter(r.doc_id for r in corpus_pipeline.run(spark, DATA).select("doc_id").collect())
    order = list(quality_rules.RULES)
    good = [(d, t) for d, t in rows if quality_rules._run(order, quality_rules.RULES, quality_rules.Measures(t.encode())) is None]
    sets = [five_words(t) for _, t in good]
    fp = np.array([simhash.fingerprint(t.encode()) for _, t in good], np.uint64)
    near = np.bitwise_count(fp[:, None] ^ fp[None]) <= simhash.RADIUS
    for i, a in enumerate(sets):
        for j in range(i):
            near[i, j] |= 5 * len(a & sets[j]) >= 4 * len(a | sets[j])
    near |= near.T
    label = np.array([d for d, _ in good])
    for _ in good:
        label = np.array([label[row].min() for row in near])
    assert set(out) == set(label.tolist()) and max(out.values()) <= 2
