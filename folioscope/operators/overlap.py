"""Which texts of two groups share enough of their words, without looking at every pair."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np

from ..functions.sequences import ratio

#: Shared words of a prefix that make a candidate, and how many hits are counted at once.
SHARED, HITS = 3, 1 << 21


def _tokens(texts: list[str], known: dict[tuple[str, int], int], grow: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sizes, starts, ids): a text's words as distinct tokens, a word's copies apart; ids of -1 aren't known."""
    ids: list[int] = []
    starts = [0]
    for text in texts:
        copies: dict[str, int] = {}
        for w in text.split():
            c = copies[w] = copies.get(w, 0) + 1
            ids.append(known.setdefault((w, c), len(known)) if grow else known.get((w, c), -1))
        starts.append(len(ids))
    at = np.array(starts, np.int64)
    return np.diff(at), at, np.array(ids, np.int64)


def _spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The whole numbers of runs that begin at ``starts``, one after another."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + lengths, lengths)


def _bands(sizes: np.ndarray) -> Iterator[np.ndarray]:
    """Texts with words, of nearly equal size: exactly so up to 32 words, within a tenth above."""
    order = np.argsort(sizes, kind="stable")
    ordered = sizes[order]
    at = int(np.searchsorted(ordered, 1))
    while at < len(order):
        low = ordered[at]
        upto = int(np.searchsorted(ordered, low if low <= 32 else low * 11 // 10, side="right"))
        yield order[at:upto]
        at = upto


def alike(olds: list[str], news: list[str], least: float) -> Iterator[tuple[int, int, float]]:
    """All (i, j, similarity) of texts with words that are ``least`` alike or more.

    Two texts of n and m words that are so alike share ``least`` * (n + m) / 2 words or more.  Whichever n - need + 3 of an old text's
    words are looked up, three of them at least are shared; so its rarest ones are, and what shares three is compared in full.
    """
    known: dict[tuple[str, int], int] = {}
    new_n, new_at, new_ids = _tokens(news, known, True)
    old_n, old_at, old_ids = _tokens(olds, known, False)
    sets: dict[int, frozenset[int]] = {}

    def bag(j: int) -> frozenset[int]:
        if j not in sets:
            sets[j] = frozenset(new_ids[new_at[j] : new_at[j + 1]].tolist())
        return sets[j]

    for band in _bands(new_n):
        low, high = int(new_n[band].min()), int(new_n[band].max())
        tokens = new_ids[_spread(new_at[band], new_n[band])]
        df = np.bincount(tokens, minlength=len(known))
        posts = np.repeat(np.arange(len(band)), new_n[band])[np.argsort(tokens, kind="stable")]
        begin = np.cumsum(df) - df
        need = np.maximum(np.ceil(least * (old_n + low) / 2 - 1e-9).astype(np.int64), 1)
        some = np.flatnonzero((old_n > 0) & (need <= np.minimum(old_n, high)))
        row, tok = np.repeat(np.arange(len(some)), old_n[some]), old_ids[_spread(old_at[some], old_n[some])]
        held = tok >= 0
        held[held] = df[tok[held]] > 0
        row, tok = row[held], tok[held]
        there = np.bincount(row, minlength=len(some))
        shared = np.minimum(need[some], SHARED)
        # Words that no new text has come first, and need no look.
        looks = np.where(there >= need[some], there - need[some] + shared, 0)
        order = np.lexsort((df[tok], row))
        row, tok = row[order], tok[order]
        first = (np.cumsum(there) - there)[row]
        keep = np.arange(len(row)) - first < looks[row]
        row, tok = row[keep], tok[keep]
        total = np.cumsum(df[tok])
        at = 0
        while at < len(row):
            upto = int(np.searchsorted(total, (total[at - 1] if at else 0) + HITS, side="right"))
            # Whole rows; one alone has no more hits than the band has words.
            upto = len(row) if upto >= len(row) else max(int(np.searchsorted(row, row[upto])), int(np.searchsorted(row, row[at], side="right")))
            r, t = row[at:upto], tok[at:upto]
            at = upto
            keys = np.repeat(r, df[t]) * len(band) + posts[_spread(begin[t], df[t])]
            keys, hits = np.unique(keys, return_counts=True)
            keys = keys[hits >= shared[keys // len(band)]]
            now, mine = -1, frozenset()
            for x, j in zip((keys // len(band)).tolist(), band[keys % len(band)].tolist(), strict=True):
                i = int(some[x])
                if x != now:
                    now, mine = x, frozenset(old_ids[old_at[i] : old_at[i + 1]].tolist())
                if len(mine & bag(j)) >= math.ceil(least * (old_n[i] + new_n[j]) / 2 - 1e-9):
                    sim = ratio(olds[i], news[j])
                    if sim >= least:
                        yield i, j, sim
