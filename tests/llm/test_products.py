"""The shingle join's product, its tiles and its counts of links."""

import random

import numpy as np
import pytest

from folioscope.llm import shingle_join as S


def sets_of(rng, n, size=60):
    base = [rng.sample(range(10**6), size) for _ in range(4)]
    out = []
    for i in range(n):
        v = set(rng.choice(base))
        for _ in range(rng.randrange(0, 14)):
            v.discard(rng.choice(sorted(v)))
            v.add(rng.randrange(10**6))
        out.append(np.array(sorted(v), np.uint64))
    return out


@pytest.mark.parametrize("columns", [7, 2048])
def test_overlaps_are_intersections(monkeypatch, columns):
    monkeypatch.setattr(S, "COLUMNS", columns)
    sets = sets_of(random.Random(1), 150)
    want = np.array([[len(np.intersect1d(a, b)) for b in sets] for a in sets])
    got = S.overlaps(sets)
    off = ~np.eye(len(sets), dtype=bool)
    assert (got[off] == want[off]).all()
    assert (S.overlaps(sets, 40) == want[:40, 40:]).all()


@pytest.mark.parametrize("tile", [1 << 19, 1500])
def test_links_are_counted_whole_or_in_tiles(spark, monkeypatch, tile):
    monkeypatch.setattr(S, "TILE", tile)
    monkeypatch.setattr(S, "ROW", 8)
    rng = random.Random(2)
    base = [[f"u{rng.randrange(10**6)}" for _ in range(120)] for _ in range(2)]
    texts = ["", None, "one word"]
    for i in range(90):
        w = list(base[i % 2])
        for _ in range(rng.randrange(0, 6)):
            w[rng.randrange(len(w))] = f"z{rng.randrange(10**6)}"
        texts.append(" ".join(w[: rng.randrange(90, 121)] if i % 3 else w))
    texts += [texts[5], texts[5], "one word", ""]
    words = [(t or "").split() for t in texts]
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set() for w in words]
    want = {}
    link = [[bool(a) and bool(b) and i != j and 100 * len(a & b) >= 75 * len(a | b) for j, b in enumerate(sets)] for i, a in enumerate(sets)]
    for i in range(len(sets)):
        seen, now = {i}, [i]
        while now:
            now = [j for x in now for j in range(len(sets)) if link[x][j] and j not in seen and not seen.add(j)]
        want[i] = (len(sets[i]), min(seen), sum(link[i]))
    got = {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in S.link_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)).collect()}
    assert got == want and max(n for _, _, n in want.values()) > 10


def test_hot_keys_are_joined_apart(spark, monkeypatch):
    from folioscope.llm import setjoin as J

    monkeypatch.setattr(J, "HOT", 3)
    left = spark.createDataFrame([(k, i) for i, k in enumerate([1] * 50 + [2, 2, 3, None, None])], "k long, i int")
    right = spark.createDataFrame([(1, "a", 50), (2, "b", 2), (4, "d", 0)], "k long, x string, times long")
    got = {(r.i, r.x) for r in J.beside(left, right, "k", "times", "left").collect()}
    assert got == {(i, "a") for i in range(50)} | {(50, "b"), (51, "b"), (52, None), (53, None), (54, None)}
    assert J.beside(left, right, "k", "times").count() == 52


def test_components_of_a_hub_and_a_chain(spark, monkeypatch):
    from folioscope.llm import setjoin as J

    monkeypatch.setattr(J, "HOT", 5)
    links = [(0, i) for i in range(1, 60)] + [(100 + i, 101 + i) for i in range(40)]
    got = {r.k: r.g for r in J.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(60)} | {i: 100 for i in range(100, 141)}
