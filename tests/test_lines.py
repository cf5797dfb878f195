import json
import random
import time

import pytest
from pyspark.sql import functions as F

from folioscope.functions import places
from folioscope.functions import sequences as S
from folioscope.operators import classify
from folioscope.plans import canonical as C
from folioscope.plans import contract

NODE = "pair_id string, ord int, match_path array<string>, display_path array<string>, element_id string, header_text string, body_text string, section_number string, division_label string"


def plain(texts, full):
    hint, out = 0, []
    for t in texts:
        at = full.find(t, hint)
        at = full.find(t) if at < 0 else at
        out.append(at)
        hint = at + len(t) if at >= 0 else hint
    return out


def test_indexed_search_finds_the_same(monkeypatch):
    rng = random.Random(3)
    for block in (7, 1 << 20):
        monkeypatch.setattr(places, "INDEXED", 0)
        monkeypatch.setattr(places, "BLOCK", block)
        monkeypatch.setattr(places, "CHUNK", 5)
        for _ in range(300):
            full = "".join(rng.choice(["a", "b", "ä", " ", " ", "\n", "ab "]) for _ in range(rng.randint(0, 150)))
            texts = [full[i : i + rng.randint(1, 30)] if rng.random() < 0.8 else "a b ab zz" for i in (rng.randint(0, len(full)) for _ in range(30))]
            texts = [t for t in texts if t]
            assert places.found(texts, full) == plain(texts, full)


def test_texts_out_of_order_are_sought_by_their_words():
    texts = [f"key{k} grants ${k} to account{k % 900} and expenses" for k in range(60_000)]
    full = "\n\n".join(texts)
    random.Random(4).shuffle(texts)
    began = time.process_time()
    got = places.found(texts, full)
    # Sought from end to end, this takes minutes.
    assert time.process_time() - began < 20 and all(full.startswith(t, p) for t, p in zip(texts, got, strict=True))


def test_alignment_of_distinct_words_is_the_library_s(monkeypatch):
    rng = random.Random(5)
    for _ in range(3000):
        a, b = ([rng.choice("$w") + str(rng.randint(0, rng.choice([4, 40]))) for _ in range(rng.randint(0, 10))] for _ in range(2))
        b = [w for w in a if rng.random() < 0.7] + b if rng.random() < 0.5 else b
        a, b = " ".join(a), " ".join(b)
        got = S.ratio(a, b), S._paired(a, b)
        with monkeypatch.context() as m:
            m.setattr(S, "_places", lambda a, b: None)
            assert got == (S.ratio(a, b), S._paired(a, b))


def versions(spark):
    rows = {"o": [("p", ["T", "a"], "Pays $5 for \"boats\".", "Sec. 1"), ("p", ["T", "b"], "entirely gone words", ""), ("p", ["U", "s"], "the same ü", ""), ("q", ["x"], "only\nhere", "")],
            "n": [("p", ["T", "a"], "Pays $9 for \"boats\".", "Sec. 1"), ("p", ["T", "c"], "brand new text", ""), ("p", ["V", "s2"], "the same ü", ""), ("p", [], "boats", "")]}
    return [spark.createDataFrame([(pair, i, path, path, f"{s}{i}", "Head" if not path else "", text, number, "") for i, (pair, path, text, number) in enumerate(rows[s])], NODE) for s in "on"]


@pytest.fixture(scope="module")
def made(spark):
    old, new = versions(spark)
    d = classify.diff_versions(old, new).cache()
    names = spark.createDataFrame([(p, "hr", 118, 5, "a", "b", 1, None) for p in "pq"], "pair_id string, bill_type string, congress int, bill_number int, label_old string, label_new string, number_old int, number_new int")
    full = [C.serialized(x, ["pair_id"]).withColumnRenamed("text", v) for x, v in ((old, "v1"), (new, "v2"))]
    return d, names, full[0].join(full[1], "pair_id", "full_outer"), C.placed(d, old, new).cache()


def test_lines_are_the_document(made):
    d, names, full, rows = made
    want = {r.pair_id: r.json for r in C.canonical(d, names, full).collect()}
    lines = C.lines(rows, names)
    assert {r.pair_id: r.json for r in C.joined(lines).collect()} == want
    assert sorted(map(str, C.view_of_lines(lines).collect())) == sorted(map(str, C.view_of(C.canonical(d, names, full)).select("pair_id", "source", "place", *[c for c in C.view_of_lines(lines).columns[3:]]).collect()))
    one = {c["id"]: c for c in json.loads(want["p"])["changes"]}
    assert one["c-0001"]["full_text_span"]["v1"]["start"] == len("T\n\nSEC. 1.  ")
    marks = lambda c: sorted(map(tuple, c.collect()))
    assert marks(contract.marked(C.view_of_lines(lines))) == marks(contract.marked_spans(C.canonical(d, names, full))) != []


def test_lines_are_checked(made):
    lines = C.lines(made[3], made[1])
    assert contract.line_errors(lines).count() == 0
    p = F.col("pair_id") == "p"
    first = p & (F.col("part") == C.ONE) & (F.col("place") == 0)
    errors = lambda x: [r.error for r in contract.line_errors(x).collect()]
    assert errors(lines.withColumn("text", F.when(first, F.replace("text", F.lit('"modified"'), F.lit('"odd"'))).otherwise(F.col("text")))) == ["$.changes[0].change_type: 'odd'"]
    assert errors(lines.where(~(p & (F.col("part") == C.LIST)))) == [f"part {C.LIST} isn't there once"]
    assert errors(lines.where(~first)) == [f"part {C.ONE} has gaps"]
    assert errors(lines.withColumn("text", F.when(p & (F.col("part") == C.HEAD), F.lit("{")).otherwise(F.col("text"))))[0].startswith("$.schema_version: missing")
    piece = p & (F.col("part") == C.OLD) & (F.col("place") == 0)
    assert errors(lines.withColumn("text", F.when(piece, F.lit('a"b')).otherwise(F.col("text"))))[0].startswith("not JSON")


def test_lines_of_the_json_diff_are_the_document(made):
    d, names = made[0], made[1]
    want = {r.pair_id: json.loads(r.json) for r in C.json_diff(d, names, financial=True).collect()}
    parts = {}
    for r in C.json_diff_lines(d, names, financial=True).orderBy("part", "place").collect():
        parts.setdefault(r.pair_id, {}).setdefault(r.part, []).append(r.text)
    assert {k: json.loads(x[C.HEAD][0] + ",".join(x[C.ONE]) + x[C.END][0]) for k, x in parts.items()} == want
