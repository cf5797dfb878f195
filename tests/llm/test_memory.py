"""The encoder's memory of pre-tokens."""

import numpy as np

from folioscope.llm import bpe


def test_a_full_memory_keeps_frequent_pre_tokens(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 4)
    asked = []
    memory = bpe._Memory(lambda raw: asked.append(raw) or [len(raw), 7])
    for i in range(40):
        assert memory[" the"] == np.array([4, 7], "<u4").tobytes()
        assert memory[f" w{i}"] == np.array([len(f" w{i}"), 7], "<u4").tobytes()
    assert asked.count(b" the") == 1 and len(memory) + len(memory.older) <= 8
