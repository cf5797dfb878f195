"""The operators' rules in plain Python, for small tables."""

import re
from collections import Counter, defaultdict

import numpy as np

from folioscope.llm import bytehash as B
from folioscope.llm import repeats

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def low(t):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def later_lines(rows):
    """Of (id, text): Counter of (id, line, start, end, reason); rows of one id must share their text."""
    lines = []
    for i, (d, t) in enumerate(rows):
        at = 0
        for j, line in enumerate((t or "").split("\n")):
            if low(line):
                lines.append(((d is None, d or 0, i, j), frozenset(low(line)), (d, j, at, at + len(line))))
            at += len(line) + 1
    lines.sort(key=lambda x: x[0])
    out, kinds, by_word = Counter(), set(), defaultdict(set)
    for _, words, place in lines:
        near = {k for w in words for k in by_word[w]}
        if words in kinds:
            out[(*place, "same")] += 1
        elif any(4 * len(k & words) >= 3 * len(k | words) for k in near):
            out[(*place, "similar")] += 1
        kinds.add(words)
        for w in words:
            by_word[w].add(words)
    return out


def without_lines(rows):
    """Texts after line dedup, None for those that it empties."""
    gone = defaultdict(set)
    for d, j, *_ in later_lines(rows):
        gone[d].add(j)
    out = []
    for d, t in rows:
        kept = [x for j, x in enumerate((t or "").split("\n")) if j not in gone[d]]
        new = t if not gone[d] else "\n".join(kept)
        out.append(None if gone[d] and not low(new) else new)
    return out


def shingles(t):
    w = low(t)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def links(rows):
    """Of (id, text): Counter of (id, shingles, component, links)."""
    sets = [shingles(t) for _, t in rows]
    parent, n = list(range(len(rows))), [0] * len(rows)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 75 * len(a | sets[j]):
                parent[find(i)] = find(j)
                n[i], n[j] = n[i] + 1, n[j] + 1
    least = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)].append(d)
    return Counter((d, len(sets[i]), min(least[find(i)], default=None) if sets[i] else d, n[i]) for i, (d, _) in enumerate(rows))


def units(text):
    """(start, end, words) of the units of a text that substring dedup hashes."""
    out, at = [], 0
    for line in (text or "").split("\n"):
        found = [(m.start(), m.end(), re.sub("[A-Z]", lambda c: c[0].lower(), m[0])) for m in WORD.finditer(line)]
        h = [int(B.hashes(np.frombuffer(w.encode(), np.uint8), np.array([0]), np.array([len(w.encode())]))[0]) for _, _, w in found]
        first = 0
        for i in range(len(found)):
            near = [h[j] for j in range(i - repeats.REACH, i + repeats.REACH + 1) if j != i and 0 <= j < len(h)]
            if i == len(found) - 1 or (len(near) == 2 * repeats.REACH and h[i] < min(near)):
                if i - first + 1 >= repeats.LEAST_WORDS:
                    out.append((at + found[first][0], at + found[i][1], tuple(w for _, _, w in found[first : i + 1])))
                first = i + 1
        at += len(line) + 1
    return out


def repeated(rows):
    """Of (id, text): Counter of (id, start, end, words, kept id, kept start)."""
    first, out = {}, Counter()
    for d, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        for a, b, words in units(t):
            if words in first:
                out[(d, a, b, len(words), *first[words])] += 1
            else:
                first[words] = (d, a)
    return out


def counts(t):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of a text."""
    t = t or ""
    w = WORD.findall(t)
    windows = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    again = {k for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for k in range(i, i + 5)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(again)
