"""Cases that an operator once left out."""

import random

import numpy as np

from folioscope.llm import language, line_dedup, shingle_join
from folioscope.llm import setjoin as J


def test_first_test_keeps_every_size_of_a_link():
    for n in range(1, 120):
        for m in range(n, 4 * n // 3 + 1):
            for overlap in range(-(-3 * (n + m) // 7), n + 1):
                size = [int(shingle_join._part(np.array([x]), shingle_join.PART)[0][0]) for x in (n, m)]
                # the shingles of either side alone come first by hash
                both = min(size[0] - (n - overlap), size[1] - (m - overlap), overlap)
                for x in (n, m):
                    assert both >= shingle_join.least_shared(np.array([x]), shingle_join.PART)[0], (n, m, overlap)
    assert J.least_overlap(4) == 3


def test_short_documents_link_in_any_hash_order(spark):
    rng, data = random.Random(3), []
    for i in range(120):
        words = [f"q{rng.randrange(10**9)}" for _ in range(8 + i % 3)]
        data += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(words[:-1] if i % 2 else words[1:]))]
    got = {r.doc_id: r.component_id for r in shingle_join.link_documents(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert got == {i: i // 2 * 2 for i in range(240)}


def test_rare_trigrams_stay_beside_a_large_script(spark):
    rng = np.random.default_rng(1)
    large = [(i, "".join(map(chr, rng.integers(0x4E00, 0x9FA5, 50_000))), "zz") for i in range(24)]
    small = [(100, "tiny vessels of quartz", "aa"), (101, "jumbled foxes who think", "aa")]
    models = language.fit(spark.createDataFrame([*large, *small], "doc_id long, text string, lang string").repartition(4))
    want, n = np.unique(language.trigrams([t for _, t, _ in small])[0], return_counts=True)
    assert len(models["zz"].g3) > 1 << 20 and models["aa"].g3.tolist() == want.tolist()
    assert np.allclose(models["aa"].p3, language.Model(want, n).p3)
    whole = language.Identifier(models)
    assert whole.names[whole.cross_entropies(["tiny foxes"])[1][0].argmin()] == "aa"


def test_the_common_table_changes_nothing(monkeypatch):
    texts = {"aa": ["lo mi ra que", "mira lo"], "bb": ["schung ei tz"], "cc": ["ñá éö ou"]}
    models = {k: language.Model(*np.unique(language.trigrams(t)[0], return_counts=True)) for k, t in texts.items()}
    held = ["lo mi", "ei ou xyz", ""]
    with_table = language.Identifier(models).cross_entropies(held)[1]
    monkeypatch.setattr(language, "TABLE", 0)
    assert (language.Identifier(models).cross_entropies(held)[1] == with_table).all()


def test_short_lines_go_too(spark):
    texts = ["Terms\na b c\nred fox", "terms\na b c d\nFox red red\n\nfox", "x\n\nc b a\nfox blue\nb c d e", "Fox\nx"]
    got = line_dedup.later_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    same = {(1, 0), (1, 2), (2, 2), (3, 0), (3, 1)}
    assert {(r.doc_id, r.line_no): r.reason for r in got} == dict.fromkeys(same, "same") | {(1, 1): "similar"}


def test_rows_without_their_own_id_are_documents(spark):
    some = lambda k: " ".join(f"{k}{i}" for i in range(12))
    texts = [(None, f"{some('a')}\n{some('b')}"), (None, f"{some('c')}\n{some('a')}"), (7, some("d")), (7, f"{some('e')}\n{some('f')}"), (3, some("f")), (None, some("g"))]
    data = [(*r, i) for i, r in enumerate(texts)]
    docs = spark.createDataFrame(data, "doc_id long, text string, row int").repartition(3)
    out = {r.row: r.text for r in line_dedup.without_later_lines(docs).collect()}
    assert len(out) == 6 and [out[i] for i in (2, 3, 4, 5)] == [some("d"), some("e"), some("f"), some("g")]
    # the two rows that hold a's line both have no id, so either is the later one
    assert (out[0], out[1]) in {(some("b"), f"{some('c')}\n{some('a')}"), (f"{some('a')}\n{some('b')}", some("c"))}
    copies = spark.createDataFrame([*data, (9, some("g"), 6), (9, some("h"), 7), (9, some("h"), 8)], docs.schema)
    kept = shingle_join.one_of_each(copies)
    rows = {r.row for r in kept.collect()}
    assert kept.columns == docs.columns and rows - {7, 8} == {0, 1, 2, 3, 4, 6} and len(rows) == 7
