"""The best window by slopes against all windows."""

import time

import numpy as np
import pytest

from strideframe.functions import constants as C
from strideframe.operators import power


def by_all_windows(v, d, starts):
    best = None
    for n in range(d, 2 * d):
        for i in range(min(starts, len(v) - n + 1)):
            part = v[i : i + n]
            if not np.isnan(part).any():
                best = power._shorter(best, (float(part.sum()) / n, n, i))
    return best


@pytest.mark.parametrize("kind", ["integers", "flat", "gaps", "reals", "few levels", "falling"])
def test_equal_to_all_windows(kind):
    rng = np.random.default_rng(sum(map(ord, kind)))
    for trial in range(25):
        n = int(rng.integers(1, 90))
        v = {"integers": rng.integers(0, 400, n), "flat": np.full(n, 200), "gaps": rng.integers(100, 300, n), "reals": rng.normal(200, 60, n), "few levels": rng.integers(0, 2, n) * 100, "falling": np.arange(n)[::-1]}[kind].astype(float)
        if kind == "gaps":
            v[rng.random(n) < 0.08] = np.nan
        starts = int(rng.integers(1, n + 1)) if trial % 2 else n
        got = power.best_windows(v, (1, 2, 9, 12, 20, 40), starts)
        for d in (1, 2, 9, 12, 20, 40):
            want = by_all_windows(v, d, starts)
            assert (want is None) == (d not in got)
            if want is None:
                continue
            if starts < n:  # a longer window may be better than all short ones that start here, but than none further on
                whole = by_all_windows(v, d, n)
                assert want[0] - 1e-9 <= got[d][0] <= whole[0] + 1e-9
            elif kind == "reals":
                assert got[d][0] == pytest.approx(want[0], rel=1e-12) and got[d][1:] == want[1:]
            else:
                assert got[d] == want


def test_a_long_grid_costs_little():
    v = np.random.default_rng(1).integers(0, 500, 32_768).astype(float)
    began = time.process_time()
    power.best_windows(v, C.MMP_GRID_S, len(v))
    assert time.process_time() - began < 2
