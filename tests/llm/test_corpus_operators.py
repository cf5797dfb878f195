"""Each operator against a brute-force version over a small corpus with nulls, odd texts, ties and repeated rows."""

import hashlib
import math
import re
from collections import Counter

import brute
import duckdb
import numpy as np
import pytest
from brute import low
from pyspark.sql import functions as F

from folioscope.llm import bpe, language, line_dedup, mixing, quality, repeats, shingle_join, topk, toxicity
from folioscope.llm import bytehash as B


def vocabulary():
    return pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")


def test_bpe_is_the_library(docs, none, rows):
    from tokenizers import Tokenizer

    path = vocabulary()
    t = Tokenizer.from_file(path)
    got = bpe.decode_documents(bpe.encode_documents(docs, path), path).collect()
    assert len(got) == len(rows)
    for r in got:
        ids = t.encode(r.text or "", add_special_tokens=False).ids
        assert np.frombuffer(r.token_ids, "<u4").tolist() == ids and r.n_tokens == len(ids)
        assert r.decoded == t.decode(ids, skip_special_tokens=False)
    assert {(r.text, r.n_tokens) for r in bpe.count_tokens(docs, path).collect()} == {(r.text, r.n_tokens) for r in got}
    assert bpe.encode_documents(none, path).count() == 0


def test_bpe_random_strings():
    from tokenizers import Tokenizer
    import random

    path, rng = vocabulary(), random.Random(2)
    t, v = Tokenizer.from_file(path), bpe.Vocabulary(path)
    for _ in range(1500):
        x = "".join(rng.choice(["the", " ", "  ", "\n", "a", "ing", "12", "é", "中", "😀", "'s", "..", "\x00", "zq"]) for _ in range(rng.randint(0, 12)))
        assert np.frombuffer(v.encode(x), "<u4").tolist() == t.encode(x, add_special_tokens=False).ids


def test_mix_matches_sql(docs, none, rows):
    got = mixing.mix(docs)
    c = duckdb.connect()
    c.execute("create table documents (doc_id bigint, text varchar, lang varchar, source varchar, n_tokens bigint, size bigint)")
    c.executemany("insert into documents values (?, ?, ?, ?, ?, ?)", rows)
    want = c.sql(mixing.ORACLE_ROWS.replace("{docs}", "documents"))
    key = lambda r: tuple(-1 if x is None else x for x in r)
    cols = ["doc_id", "size", "source_size", "target", "taken", "passes"]
    assert sorted(map(key, want.select(*[duckdb.ColumnExpression(x) for x in cols]).fetchall())) == sorted(key(tuple(r)) for r in got.select(*cols).collect())
    assert mixing.mix(none).count() == 0
    assert all(r.passes <= 3 for r in got.collect())
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    assert mixed.count() == got.agg(F.sum("passes")).first()[0]


def test_components_match_brute_force(docs, none, rows):
    want = brute.links([r[:2] for r in rows])
    assert Counter(tuple(r) for r in shingle_join.link_documents(docs).collect()) == want
    assert shingle_join.link_documents(none).count() == 0
    kept = shingle_join.one_of_each(docs)
    assert kept.columns == docs.columns and kept.count() == len({(k[2] if k[1] else k[0]) for k in want})


@pytest.mark.parametrize("enough,split", [(256, 1 << 20), (1, 40)])
def test_later_lines_match_brute_force(docs, none, rows, enough, split):
    lines = []
    for i, r in enumerate(rows):  # the row that repeats an id repeats its text too
        for j, line in enumerate((r[1] or "").split("\n")):
            if low(line):
                lines.append(((r[0] is None, r[0] or 0, i, j), set(low(line)), (r[0], j)))
    before = lambda x: [o[1] for o in lines if o[0] < x[0] and 4 * len(o[1] & x[1]) >= 3 * len(o[1] | x[1])]
    want = Counter((*x[2], "same" if x[1] in b else "similar") for x in lines if (b := before(x)))
    got = line_dedup.later_lines(docs, enough=enough, split=split)
    assert Counter((r.doc_id, r.line_no, r.reason) for r in got.collect()) == want
    assert line_dedup.later_lines(none).count() == 0
    out = line_dedup.without_later_lines(docs)
    assert out.columns == docs.columns and out.count() == len(rows)


def test_repeats_are_all_but_the_earliest(docs, none, rows):
    want = brute.repeated([r[:2] for r in rows])
    got = repeats.repeats(docs).collect()
    assert want and Counter(tuple(r) for r in got) == want
    assert repeats.repeats(none).count() == 0 and repeats.without_repeats(none).count() == 0
    out = repeats.without_repeats(docs)
    assert out.count() == len(rows) and out.columns == [*docs.columns, "removed"]
    with pytest.raises(ValueError, match="another name"):
        repeats.without_repeats(out)


def test_repeats_of_rows_that_share_an_id(spark):
    some = lambda k: " ".join(f"{k}{i}" for i in range(8))
    data = [("x", some("a"), 0), ("y", f"{some('b')}\n{some('a')}", 1), ("y", some("c"), 2), (None, f"{some('d')}\n{some('c')}", 3)]
    out = {r.n: r.text for r in repeats.without_repeats(spark.createDataFrame(data, "doc_id string, text string, n int").repartition(2)).collect()}
    assert out[0] == some("a") and out[1].strip() == some("b") and out[2] == some("c") and out[3].strip() == some("d")


def test_a_passage_inside_other_lines_is_found(spark):
    import random

    rng = random.Random(4)
    some = lambda n: " ".join(f"v{rng.randrange(10**6)}" for _ in range(n))
    passage = some(60)
    data = [(i, f"{some(30)} {passage} {some(25)}" if i % 2 else some(90)) for i in range(20)]
    got = {r.doc_id for r in repeats.repeats(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert got == set(range(3, 20, 2))


def test_counts_match_brute_force(docs, rows):
    for r in quality.text_statistics(docs).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute.counts(r.text)


def test_rules_are_learned(spark, docs, none):
    data = [(i, " ".join([f"w{i + k}#" if i % 3 == 0 else f"w{i + k}" for k in range(20)])) for i in range(300)]
    d = spark.createDataFrame(data, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 != 0)) for i in range(200)] + [(None, 0), (3, None)], "doc_id long, quality int")
    got = {r.doc_id: r.kept for r in quality.judge(d, labels).collect()}
    assert got == {i: i % 3 != 0 for i in range(300)}
    assert quality.judge(docs, labels.where("false")).where("kept = base_failed").count() == 0
    assert quality.judge(none, labels).count() == 0


def test_toxic_sentences_are_found(spark, docs, none):
    import random

    rng = random.Random(1)
    data = []
    for i in range(400):
        s = [" ".join(f"w{rng.randrange(500)}" for _ in range(8)) for _ in range(5)]
        if i % 4 == 0:
            s[rng.randrange(5)] += f" {rng.choice(['idiot', 'scum'])} w1"
        data.append((i, ". ".join(s)))
    d = spark.createDataFrame(data, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)], "doc_id long, toxic int")
    got = toxicity.toxicity(d, labels).collect()
    held = [r for r in got if r.held_out]
    assert held and sum(r.predicted == (r.doc_id % 4 == 0) for r in held) >= 0.98 * len(held)
    worst = next(r for r in got if r.predicted)
    assert re.search("idiot|scum", worst.text[worst.worst_start : worst.worst_end])
    assert all(0 <= r.score <= 1 for r in toxicity.toxicity(docs, labels).collect())
    assert toxicity.toxicity(none, labels.where("false")).count() == 0


def test_languages_are_told_apart(spark, docs, none):
    import random

    rng = random.Random(1)
    parts = {"aa": ["lo", "mi", "ra", "que"], "bb": ["sch", "ung", "ei", "tz"], "cc": ["ñá", "éö", "ou", "ie"]}
    data = [(i, " ".join("".join(rng.choices(parts[k], k=3)) for _ in range(15)), k if i % 7 else None) for i in range(300) for k in [list(parts)[i % 3]]]
    d = spark.createDataFrame([*data, (900, None, "aa"), (901, "123 !!", "bb")], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in language.language(d).collect()}
    assert all(got[i].lang_pred == list(parts)[i % 3] for i in range(300))
    assert got[900].lang_pred == got[901].lang_pred == "und" and got[900].score == 0
    assert {r.lang_pred for r in language.language(docs).collect()} <= {"aa", "bb", "und"}
    assert language.language(none).count() == 0


def test_kneser_ney_sums_to_one():
    m = language.Model(*np.unique(language.trigrams(["the cat sat on the mat and then the hat"])[0], return_counts=True))
    context = m.g3[0] >> 21
    p = np.exp(m.log_p((context << 21) | m.g1)).sum() + np.exp(m.l3[0] + m.l2[np.searchsorted(m.c1, context & (1 << 21) - 1)] + m.unseen)
    assert abs(p - 1) < 1e-9


def nearest(data, k=5):
    """Brute force over rows (id, vector): sorted (query id, rank, id, score)."""
    v = [(i, [math.floor(256 * c) for c in x]) for i, x in data if i is not None and x is not None and all(c is not None and math.isfinite(c) for c in x)]
    out = []
    for r, (i, q) in enumerate(v):
        if i % 50 == 0:
            all_ = sorted((-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(q, x)))), j) for s, (j, x) in enumerate(v) if s != r)  # noqa: B905
            out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(all_[:k])]
    return sorted(out)


@pytest.mark.parametrize("group", [None, 64])
def test_top_k_matches_brute_force(spark, group):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 8)).astype(np.float32)
    x[10] = x[60] = x[7]
    data = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    data += [(400, None), (401, [float("nan")] * 8), (450, [None] * 8), (None, [1.0] * 8), (50, data[3][1]), (1, data[1][1]), (1, [9.0] * 8), (1, [9.0] * 8), (550, [1.5]), (600, [])]
    got = topk.top_k(spark.createDataFrame([(*r, 0) for r in data], "vec_id long, embedding array<float>, rank int").repartition(3), group=group).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == nearest(data)
    assert topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_top_k_of_large_components(spark):
    rng = np.random.default_rng(2)
    data = [(i, [float(c) for c in rng.normal(size=6) * 10.0 ** (i % 9)]) for i in range(120)] + [(150, [1e8, -3e7, 2.0, 1.0, 0.0, 5e6]), (151, [1e8, -3e7, 2.0, 1.0, 0.0, 5e6])]
    got = topk.top_k(spark.createDataFrame(data, "vec_id long, embedding array<double>"), group=40).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == nearest(data)


def test_the_index_stops_on_proof():
    rng = np.random.default_rng(3)
    v = (rng.normal(size=(3000, 32)) * rng.exponential(size=(3000, 1)) * 60).astype(np.int64)
    index = topk.ImpactIndex(np.arange(3000), np.arange(3000), v)
    taken = []
    for r in range(0, 3000, 300):
        ids, score, n = index.search(v[r], r, 5)
        want = sorted((-int(v[r] @ v[j]), j) for j in range(3000) if j != r)[:5]
        assert [(-s, i) for s, i in zip(score, ids, strict=True)] == want
        taken.append(n)
    assert min(taken) < len(index.postings)


def test_word_hashes_and_blocks():
    import pyarrow as pa

    a = [f for _, buf, s, e in B.blocks(pa.array(["ab cd", None, "cd  ab"])) for f in [B.hashes(buf, *B.spans(buf))]][0]
    assert a[0] == a[3] and a[1] == a[2] and a[0] != a[1]
    long = "y" * 5000
    h = [B.hashes(buf, *B.spans(buf)) for _, buf, _, _ in B.blocks(pa.array([f"{long} z", f"z {long}"]))][0]
    assert h[0] == h[3] and hashlib.blake2b(long.encode(), digest_size=8).digest() == h[0].tobytes()
