"""Links and groups of two ways to cut the same bytes, against looking at every pair."""

import numpy as np
import pytest

from meetflow.llm.align import ID_BITS, aligned_ends


@pytest.mark.parametrize("seed", range(6))
def test_aligned_ends(seed):
    rng = np.random.default_rng(seed)
    size = int(rng.integers(1, 60))
    ends = [np.unique(np.append(rng.integers(1, size + 1, rng.integers(1, 30)), size)) for _ in "ab"]
    ids = [rng.integers(0, 9, len(e)) for e in ends]
    link, pairs, group, order = aligned_ends(ids[0], ends[0], ids[1], ends[1])
    spans = [list(zip([0, *e[:-1]], e, x)) for e, x in zip(ends, ids)]
    assert sorted(pairs.tolist()) == sorted(int(x) << ID_BITS | int(y) for lo, hi, x in spans[0] for l, h, y in spans[1] if max(lo, l) < min(hi, h))
    assert link.tolist() == sorted({*ends[0].tolist(), *ends[1].tolist()}) and group.tolist() == sorted({*ends[0].tolist()} & {*ends[1].tolist()})
    want = []
    for lo, hi in zip([0, *group], group):
        for side, of in enumerate(spans):
            inside = [(int(x), int(h == hi)) for _, h, x in of if lo < h <= hi]
            want += [-1 - (2 * x + last) if side else 2 * x + last for x, last in inside]
    assert order.tolist() == want


def test_no_texts():
    none = np.zeros(0, np.int64)
    assert [len(x) for x in aligned_ends(none, none, none, none)] == [0] * 4
