"""Segments cut down before the transform against the transform of whole segments."""

import numpy as np
import pytest

from cardlake.llm import repeats


def hits(rows, length):
    found = repeats.shared_starts([x[5] for x in rows], np.array([x[3] for x in rows]), length)
    return {(x[1], x[2] + i) for x, hit in zip(rows, found, strict=True) for i in np.flatnonzero(hit).tolist()}


@pytest.mark.parametrize("length, window", [(400, 192), (60, 40), (12, 9)])
def test_trimmed_segments_repeat_where_whole_ones_do(length, window):
    """Segments around one anchor that agree with others for some bytes on either side of it, often fewer than a string has."""
    r = np.random.default_rng(9)
    anchor = bytes(r.integers(97, 123, length - window + 1, np.uint8))
    sides = [(bytes(r.integers(97, 123, window, np.uint8)), bytes(r.integers(97, 123, window, np.uint8))) for _ in range(4)]
    group = {}
    for _ in range(60):
        (before, _), (_, after) = sides[r.integers(4)], sides[r.integers(4)]
        left, right = int(r.integers(0, window)), int(r.integers(0, window))
        own = bytes(r.integers(65, 91, window, np.uint8))
        lead = int(r.integers(0, window))
        starts = int(r.integers(1, lead + 2))
        whole = (own + before[window - left :])[-lead:] * bool(lead) + anchor + (after[:right] + own)[:window]
        group[whole[: starts - 1 + length], lead] = starts
    rows = [(7, bytes([n]), 0, starts, 7, lead, content) for n, ((content, lead), starts) in enumerate(group.items())]
    cut = repeats.trimmed(rows, length)
    want = hits([(*x[:5], x[6]) for x in rows], length)
    assert want and hits(cut, length) == want
    assert all(len(x[5]) == x[3] - 1 + length for x in cut)
    if length == 400:
        assert sum(len(x[5]) for x in cut) < 0.95 * sum(len(x[6]) for x in rows)
    assert repeats.trimmed(rows[:1], length) == []
