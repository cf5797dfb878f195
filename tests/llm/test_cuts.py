"""Long texts cut for the library, and vocabularies that the encoder must refuse."""

import json
import random

import pytest

from folioscope.llm import bpe


@pytest.fixture(scope="module")
def path():
    return pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")


def test_cuts_change_no_token(path):
    t, special = bpe._library(path)
    rng = random.Random(3)
    parts = ["a", "the", " ", "  ", "\n", "\t", "1", "23", "é", "中", "。", "'", "s", "n't", "..", "-", "😀", "<|endoftext|>", "<|end", "|>", "\xa0", "́", "²", "_"]
    for _ in range(1500):
        x = "".join(rng.choice(parts) for _ in range(rng.randint(1, 60)))
        cut = bpe.pieces(x, rng.choice([4, 8, 16, 32]), special)
        assert "".join(cut) == x
        assert sum(len(t.encode(p, add_special_tokens=False).ids) for p in cut if p) == len(t.encode(x, add_special_tokens=False).ids)


def test_texts_without_spaces_are_cut(path):
    _, special = bpe._library(path)
    for unit in ("abc,", "12ab", "中文。", "a" * 50 + "<|endoftext|>"):
        text = unit * (400_000 // len(unit.encode()))
        cut = bpe.pieces(text, bpe.PIECE, special)
        assert "".join(cut) == text and max(len(p.encode()) for p in cut) <= bpe.PIECE + 200 and len(cut) > 4


def test_long_texts_are_counted_as_the_library_does(spark, path):
    t, _ = bpe._library(path)
    texts = ["word, and 12 more. " * 12_000, "中文，很长。" * 20_000, "x1" * 90_000, "a" * 70_000, "", None, "\n" * 70_000, "<|endoftext|>" * 9_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = {i: len(t.encode(x or "", add_special_tokens=False).ids) for i, x in enumerate(texts)}
    assert {r.doc_id: r.n_tokens for r in bpe.count_tokens(docs, path).collect()} == want
    assert {r.doc_id: r.n_tokens for r in bpe.encode_documents(docs.where("doc_id <> 3"), path).collect()} == {i: n for i, n in want.items() if i != 3}


@pytest.mark.parametrize("change", [{"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"added_tokens": [{"id": 1, "content": "x", "lstrip": True}]}])
def test_other_vocabularies_are_refused(path, tmp_path, change):
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    spec["model"] |= {"vocab": {"a": 0}, "merges": []}
    (tmp_path / "v.json").write_text(json.dumps(spec | change))
    with pytest.raises(ValueError, match="not plain"):
        bpe.checked(str(tmp_path / "v.json"))
