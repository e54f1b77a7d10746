"""The records that a key's fitness knows of are one value of its state, whatever their number."""

import math

import pandas as pd
import pytest

from strideframe.streaming import fitness


class Value:
    def __init__(self):
        self.held, self.calls = None, 0

    def get(self):
        self.calls += 1
        return self.held

    def update(self, value):
        self.calls += 1
        self.held = value

    def exists(self):
        self.calls += 1
        return self.held is not None


class Handle:
    def __init__(self):
        self.values = {}

    def getValueState(self, name, schema, ttlDurationMs=None):
        return self.values.setdefault(name, Value())


def test_a_batch_reads_and_writes_each_state_once():
    handle, processor = Handle(), fitness.FitnessProcessor()
    processor.init(handle)
    loads = {}
    for batch in range(3):
        ids = range(batch * 500, batch * 500 + 1000)  # half of them come again, changed
        rows = pd.DataFrame({"id": ids, "key": 7, "day": [i % 40 for i in ids], "load": [str(i % 90 + batch) for i in ids]})
        loads |= {i: (i % 40, i % 90 + batch) for i in ids}
        before = sum(v.calls for v in handle.values.values())
        (out,) = processor.handleInputRows((7,), iter([rows[:300], rows[300:]]), None)
        assert sum(v.calls for v in handle.values.values()) - before <= 4
    want = [sum((1 - math.exp(-1 / n)) * x * math.exp(-(39 - d) / n) for d, x in loads.values()) for n in (42, 7)]
    assert out[["kind", "day", "ctl", "atl"]].values.tolist() == [["fitness", 39, pytest.approx(want[0]), pytest.approx(want[1])]]
    (bad,) = processor.handleInputRows((7,), iter([pd.DataFrame({"id": [1, None], "key": 7, "day": [3, 3], "load": ["NaN", "5"]})]), None)
    assert bad["reason"].tolist() == ["out_of_domain", "missing_required_input"]
