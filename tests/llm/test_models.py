"""The learned models against their formulas in plain Python."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

from folioscope.llm import bytehash as B
from folioscope.llm import language, quality, toxicity


def kneser_ney(grams):
    """p(c | a, b) as a function, from counts of (a, b, c)."""
    def discount(n):
        one, two = sum(v == 1 for v in n), sum(v == 2 for v in n)
        return one / (one + 2 * two) if one and two else 0.5

    n2 = Counter((b, c) for _, b, c in grams)
    n1 = Counter(c for _, c in n2)
    d3, d2, d1 = (discount(n.values()) for n in (grams, n2, n1))
    t3, t2 = defaultdict(list), defaultdict(list)
    for (a, b, _), n in grams.items():
        t3[a, b].append(n)
    for (b, _), n in n2.items():
        t2[b].append(n)
    total = sum(n1.values())

    def one(c):
        return max(n1[c] - d1, 0) / total + d1 * len(n1) / total / (len(n1) + 1)

    def two(b, c):
        return one(c) if b not in t2 else max(n2[b, c] - d2, 0) / sum(t2[b]) + d2 * len(t2[b]) / sum(t2[b]) * one(c)

    return lambda a, b, c: two(b, c) if (a, b) not in t3 else max(grams[a, b, c] - d3, 0) / sum(t3[a, b]) + d3 * len(t3[a, b]) / sum(t3[a, b]) * two(b, c)


def test_kneser_ney_is_its_formula():
    rng = random.Random(1)
    text = " ".join("".join(rng.choices("abcdeé", weights=[9, 6, 4, 2, 1, 1], k=rng.randint(1, 6))) for _ in range(400))
    packed = language.trigrams([text])[0]
    grams = Counter((int(g) >> 42, int(g) >> 21 & 0x1FFFFF, int(g) & 0x1FFFFF) for g in packed)
    model, p = language.Model(*np.unique(packed, return_counts=True)), kneser_ney(grams)
    letters = [ord(c) for c in "abcdeéxz 日"]
    asked = [(a, b, c) for a in letters for b in letters for c in letters]
    got = model.log_p(np.array([a << 42 | b << 21 | c for a, b, c in asked]))
    assert np.allclose(got, [math.log(p(*x)) for x in asked])


def test_cross_entropy_is_the_mean_over_a_whole_text():
    texts = {"aa": "lo mi ra que mira", "bb": "schung ei tz"}
    models = {k: language.Model(*np.unique(language.trigrams([t])[0], return_counts=True)) for k, t in texts.items()}
    n, h = language.Identifier(models).cross_entropies(["lo ei", "", "x" * 9000])
    for i, t in enumerate(["lo ei", "", "x" * 9000]):
        g = language.trigrams([t])[0]
        assert n[i] == len(g)
        for j, k in enumerate(sorted(models)):
            assert abs(h[i, j] - (-models[k].log_p(g).sum() / len(g) if len(g) else 0)) < 1e-4


def word_hash(w):
    raw = np.frombuffer(w.encode(), np.uint8)
    return int(B.hashes(raw, np.array([0]), np.array([len(raw)]))[0])


def test_noisy_or_is_its_formula():
    weights = {"bad": 3.0, "vile": 2.5, "odd": 0.4}
    model = toxicity.Model(np.array([word_hash(w) for w in weights], np.uint64), np.array(list(weights.values())), -2.0, 0.05, (1.3, 0.7))
    texts = ["A bad day. All is fine! odd odd\nvile", "clean words only. And more", "", None, "!!! ...", "BAD", "bad. " * 3000]
    got = model.score(pa.array(texts, pa.string()))
    for i, t in enumerate(texts):
        sentences, now = [], ""
        for c in t or "":
            if c in ".!?\n":
                sentences.append(now)
                now = ""
            else:
                now += c
        sentences = [s.lower().split() for s in [*sentences, now]]
        clean, z = 1.0, []
        log_clean = 0.0
        for s in sentences:
            known = [weights[w] for w in s if w in weights]
            z.append(1 / (1 + math.exp(-(sum(known) - 2.0))) if known else 0.0)
            log_clean += math.log1p(-z[-1])
        some = any(sentences)
        log_clean += math.log1p(-0.05) if some else 0.0
        odds = math.log(max(math.expm1(min(-log_clean, 30)), 1e-12))
        want = 1 / (1 + math.exp(-max(-30, min(30, 1.3 * odds + 0.7)))) if some else 0.0
        assert abs(got["score"][i] - want) < 1e-9, t
        assert got["n_sentences"][i] == sum(map(bool, sentences)) and clean == 1.0
        assert abs(got["worst_score"][i] - max(z, default=0)) < 1e-9
    assert texts[0][got["worst_start"][0] : got["worst_end"][0]] == "A bad day"


def test_the_expression_is_the_list(spark):
    rng = random.Random(5)
    rows = [tuple(rng.randrange(0, 60) for _ in quality.COUNTS) for _ in range(400)]
    rules = [[("symbols_a_word", ">", 1.1), ("words", "<=", 40.0)], [("dup_lines", ">", 0.8)], [("chars_a_word", "<=", 0.5), ("upper_a_char", ">", 0.2), ("marks_a_word", ">", 0.1)]]
    got = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], ["i", *quality.COUNTS]).select("i", quality.verdict(rules).alias("kept")).collect()

    def value(name, row):
        c = dict(zip(quality.COUNTS, row, strict=True))
        a, b = quality.RATIOS[name]
        return c[a] / max(c[b], 1) if b else float(c[a])

    def kept(row):
        for rule in rules:
            if all(value(n, row) > t if op == ">" else value(n, row) <= t for n, op, t in rule):
                return False
        return True

    want = {i: kept(r) for i, r in enumerate(rows)}
    assert {r.i: r.kept for r in got} == want and 0 < sum(want.values()) < len(want)


def test_rules_cover_bad_rows_and_spare_good_ones():
    rng = np.random.default_rng(2)
    n = 900
    counts = {c: rng.integers(1, 200, n) for c in quality.COUNTS}
    bad = (counts["n_symbols"] / counts["n_words"] > 2) | ((counts["n_digits"] / counts["word_chars"] > 1.5) & (counts["n_words"] > 50))
    rules = quality.learn_rules(counts, bad)
    x = quality._matrix(counts)
    out = np.zeros(n, bool)
    for r in rules:
        out |= quality._covers(x, r)
    assert (out & bad).sum() >= 0.9 * bad.sum() and (out & ~bad).sum() <= 0.05 * out.sum()
    assert quality.learn_rules(counts, np.zeros(n, bool)) == [] and quality.learn_rules({c: v[:0] for c, v in counts.items()}, np.zeros(0, bool)) == []
