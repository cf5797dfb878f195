"""Long lists of lines that share a word."""

import numpy as np

from folioscope.llm import line_dedup


def _list(n: int, near: int) -> np.ndarray:
    """A word's list of ``n`` lines of ten words, whose sketches differ, save for one in ``near``, which repeats that of the line 70 before."""
    rng = np.random.default_rng(5)
    e = np.zeros(n, line_dedup._ENTRY)
    e["w"], e["doc"], e["n"] = np.uint64(3), np.arange(n), 10
    e["s"], e["t"] = rng.integers(0, 1 << 63, n, dtype=np.uint64), rng.integers(0, 1 << 63, n, dtype=np.uint64)
    for j in range(near, n, near):
        if j >= 70:
            e["s"][j], e["t"][j] = e["s"][j - 70], e["t"][j - 70]
    return e


def test_long_lists_are_searched_whole_in_few_steps(monkeypatch):
    e = _list(4000, 7)
    early, late, apart = line_dedup.met_by(e, np.ones(len(e), bool))
    want = set(zip(early.tolist(), late.tolist(), apart.tolist(), strict=True))
    steps = []
    near = line_dedup._near
    monkeypatch.setattr(line_dedup, "_near", lambda *a: steps.append(1) or near(*a))
    early, late, apart, stopped = line_dedup.met(e, line_dedup.FULL)
    assert set(zip(early.tolist(), late.tolist(), apart.tolist(), strict=True)) == want and len(early) == len(want) > 500
    assert not len(stopped) and len(steps) < 400


def test_a_line_that_stops_in_a_tile_keeps_no_more_than_enough():
    e = _list(1000, 1)
    e["s"] ^= np.uint64(1) * (np.arange(1000, dtype=np.uint64) % np.uint64(2))
    _, late, _, stopped = line_dedup.met(e, 3)
    assert np.bincount(late).max() <= 3 + 4 and len(np.unique(stopped)) > 100
