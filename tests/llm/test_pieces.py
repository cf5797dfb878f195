"""Vectorised pieces of the corpus operators against plain Python."""

import numpy as np

from folioscope.llm import bytehash as B
from folioscope.llm import line_dedup as L
from folioscope.llm import setjoin as J


def test_equal_words_alone_have_equal_hashes():
    words = [b"a" * n for n in (1, 7, 8, 9, 15, 16, 17, B.LONG_WORD - 1, B.LONG_WORD, B.LONG_WORD + 1)]
    words += [b"a\0", b"a\0\0", b"\0", b"abcdefgh\0", b"abcdefgh", b"abcdefghi", b"ihgfedcba", "größe".encode(), b"x" * 4000 + b"y", b"x" * 4001]
    text = b" ".join(words + words[::-1])
    buf = np.frombuffer(text, np.uint8)
    s, e = B.spans(buf)
    found = [text[a:b] for a, b in zip(s, e, strict=True)]
    assert found == text.split(b" ")
    h = B.hashes(buf, s, e)
    by_word = {}
    for w, x in zip(found, h.tolist(), strict=True):
        by_word.setdefault(w, set()).add(x)
    assert all(len(v) == 1 for v in by_word.values())
    assert len({x for v in by_word.values() for x in v}) == len(by_word) == len(words)


def test_spans_of_texts_without_words():
    for text in (b"", b" ", b"\n\t "):
        buf = np.frombuffer(text, np.uint8)
        s, e = B.spans(buf)
        assert not len(s) and not len(e) and not len(B.hashes(buf, s, e))


def _entries(seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    e = np.zeros(300, L._ENTRY)
    e["w"] = np.sort(rng.integers(0, 6, len(e)))
    e["doc"] = rng.integers(0, 40, len(e))
    e["line"] = rng.integers(0, 3, len(e))
    e["n"] = rng.integers(5, 60, len(e))
    e["pos"] = rng.integers(0, 4, len(e))
    base = rng.integers(0, 2**63, 3, dtype=np.uint64)
    e["s"] = base[rng.integers(0, 3, len(e))] ^ (np.uint64(1) << rng.integers(0, 63, len(e)).astype(np.uint64))
    e["t"] = base[0]
    return e[np.lexsort((e["line"], e["doc"], e["w"]))]


def test_second_look_finds_all_pairs_of_the_wanted_lines():
    for seed in range(5):
        e = _entries(seed)
        want = np.random.default_rng(seed).random(len(e)) < 0.2
        early, late, apart, stopped = L.met(e, L.FULL)
        expected = {(i, j, d) for i, j, d in zip(early.tolist(), late.tolist(), apart.tolist(), strict=True) if want[j]}
        got = list(zip(*(x.tolist() for x in L.met_by(e, want)), strict=True))
        assert len(got) == len(set(got)) and set(got) == expected and expected and not len(stopped)
    none = L.met_by(e, np.zeros(len(e), bool))
    assert all(not len(x) for x in none) and all(not len(x) for x in L.met_by(e[:0], want[:0]))


def test_entries_moved_as_bytes():
    e = _entries(1)
    at = np.random.default_rng(2).permutation(len(e))[:50]
    assert (J.taken(e, at) == e[at]).all() and len(J.taken(e, at[:0])) == 0 and len(J.taken(e[:0], at[:0])) == 0
