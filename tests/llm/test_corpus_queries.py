"""The registered queries and the pipeline's stages over the smallest tables, against plain Python, the library and SQL."""

import hashlib
import os
import sys
from collections import Counter

import duckdb
import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(__file__))
import brute

from folioscope.llm import mixing, quality
from folioscope.llm.queries import QUERIES, SQL, vocabulary_path

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.fixture(scope="module")
def texts():
    return duckdb.sql(f"SELECT doc_id, text FROM '{DATA}/documents.parquet' ORDER BY doc_id").fetchall()


def rows(df):
    return Counter(tuple(r) for r in df.collect())


def test_repeats(spark, texts):
    assert rows(QUERIES["op1_repeats"](spark, DATA)) == brute.repeated(texts)


def test_links(spark, texts):
    assert rows(QUERIES["op4_shingle_join"](spark, DATA)) == brute.links(texts)


def test_later_lines(spark, texts):
    assert rows(QUERIES["op9_line_dedup"](spark, DATA)) == brute.later_lines(texts)


def test_coding_and_counts(spark, texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary_path())
    ids = {d: t.encode(x or "", add_special_tokens=False).ids for d, x in texts}
    coded = {r.doc_id: r for r in QUERIES["op2_bpe"](spark, DATA).collect()}
    counted = {r.doc_id: r for r in QUERIES["op6_token_counts"](spark, DATA).collect()}
    assert set(coded) == set(counted) == set(ids)
    for d, x in texts:
        r, c = coded[d], counted[d]
        assert r.n_tokens == c.n_tokens == len(ids[d]) and r.ids_sha256 == hashlib.sha256(np.array(ids[d], "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(t.decode(ids[d], skip_special_tokens=False).encode()).hexdigest()
        assert c.n_bytes == len((x or "").encode()) and c.over_limit == (len(ids[d]) > 1024)


def test_quality(spark, texts):
    got = {r.doc_id: r for r in QUERIES["op5_quality"](spark, DATA).collect()}
    for d, x in texts:
        r, want = got[d], brute.counts(x)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0]) and not (r.base_failed and r.kept)
    labels = duckdb.sql(f"SELECT doc_id, quality FROM '{DATA}/labels.parquet' WHERE quality IS NOT NULL").fetchall()
    judged = [(got[d].kept, q) for d, q in labels if d in got and not got[d].base_failed]
    assert sum(k == bool(q) for k, q in judged) >= 0.9 * len(judged)


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, name):
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.sql(f"create view {f.split('.')[0]} as select * from '{DATA}/{f}'")
    got = QUERIES[name](spark, DATA)
    want = c.sql(SQL[name])
    cols = [d[0] for d in want.description]
    assert sorted(cols) == sorted(got.columns)
    assert Counter(want.fetchall()) == rows(got.select(*cols))


def test_held_out_labels(spark, texts):
    toxic = dict(duckdb.sql(f"SELECT doc_id, toxic FROM '{DATA}/labels.parquet' WHERE toxic IS NOT NULL").fetchall())
    scored = QUERIES["op7_toxicity"](spark, DATA).collect()
    assert len(scored) == len(texts) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in scored)
    held = [r for r in scored if r.held_out and r.doc_id in toxic]
    assert sum(r.predicted == toxic[r.doc_id] for r in held) >= 0.85 * len(held)
    lang = dict(duckdb.sql(f"SELECT doc_id, lang FROM '{DATA}/documents.parquet' WHERE lang IS NOT NULL").fetchall())
    named = QUERIES["op8_language"](spark, DATA).collect()
    held = [r for r in named if r.held_out and r.doc_id in lang and r.lang_pred != "und"]
    assert len(named) == len(texts) and sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.95 * len(held)


def test_pipeline_stages(spark):
    """Each stage's rows from what the one before it kept, by plain rules, SQL and the library."""
    from tokenizers import Tokenizer

    import corpus_pipeline as C

    table = lambda df: df.select(*df.columns).collect()
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    before = table(docs)
    out = [C.stored(C.STAGES[0][1](spark, docs, DATA))]
    for _, stage in C.STAGES[1:]:
        out.append(C.stored(stage(spark, out[-1], DATA)))
    after = [table(d) for d in out]
    judged = {r.doc_id: r.kept for r in quality.judge(docs, spark.read.parquet(f"{DATA}/labels.parquet")).collect()}
    assert Counter(after[0]) == Counter(r for r in before if judged[r.doc_id])
    cut = brute.without_lines([(r.doc_id, r.text) for r in after[0]])
    assert Counter((r.doc_id, r.text, r.n_chars) for r in after[1]) == Counter((r.doc_id, t, len(t or "")) for r, t in zip(after[0], cut, strict=True) if t is not None or r.text is None)
    first = {d for d, _, c, _ in brute.links([(r.doc_id, r.text) for r in after[1]]) if d == c}
    assert Counter(after[2]) == Counter(r for r in after[1] if r.doc_id in first)
    c = duckdb.connect()
    c.execute("create table documents (doc_id bigint, text varchar, source varchar)")
    c.executemany("insert into documents values (?, ?, ?)", [(r.doc_id, r.text, r.source) for r in after[2]])
    passes = Counter({r[0]: r[1] for r in c.sql(f"SELECT doc_id, passes FROM ({mixing.ORACLE_ROWS.replace('{docs}', 'documents')})").fetchall()})
    assert Counter(r.doc_id for r in after[3]) == +passes
    t = Tokenizer.from_file(vocabulary_path())
    assert len(after[4]) == len(after[3])
    for r in after[4]:
        assert np.frombuffer(r.token_ids, "<u4").tolist() == t.encode(r.text or "", add_special_tokens=False).ids and r.round_trip
