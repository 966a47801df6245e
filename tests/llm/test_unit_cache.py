"""Packing's units: the vectorised split against the tokenizer, and frequent units through a full cache."""

from __future__ import annotations

import random

import numpy as np

from recallium.llm import packing as P


def test_units_equal_the_tokenizer():
    rng = random.Random(3)
    marks = "'''stmdrevlaAÉßñ  \n\t0129.,!-–—“”‘’…¿¡«»<|xÿÖ"
    texts = ["".join(rng.choice(marks) for _ in range(rng.randrange(60))) for _ in range(3000)]
    texts += ["", "'", "''s", "'S'T", " 'll'llx", "'re've'r", "'e", "x'v", "x'l", "\n", "<|endoftext|>", "a\rb", "İx", "word" * 3000]
    path = P.default_tokenizer()
    tok, _ = P._encoder(path)
    want = [np.array(tok.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert P.encode_texts(texts, path) == want
    assert P.encode_texts([], path) == [] and P.encode_texts(["a\rb"], path) == [want[-3]]


def test_frequent_units_are_learned_once(monkeypatch):
    letters = "abcdefghij"

    def rare(k):
        return "q" + "".join(letters[int(d)] for d in str(k))

    learned = []
    learn = P._learn
    monkeypatch.setattr(P, "CACHE_UNITS", 400)
    monkeypatch.setattr(P, "_learn", lambda units: (learned.extend(units), learn(units)))
    P._clear()
    try:
        for lot in range(30):
            P.encode_texts(["the same words " + " ".join(rare(100 * lot + k) for k in range(100))], P.default_tokenizer())
            assert len(P._STATE["cache"]) + len(P._STATE.get("old", ())) <= 400
        assert len(learned) == 3 + 3000
    finally:
        P._clear()


def test_lots_of_texts_are_bounded():
    texts = ["x" * 10] * 3000 + ["y" * P.LOT_CHARS, "z" * P.LOT_CHARS, ""]
    lots = list(P._lots(texts))
    assert [lo for lo, _ in lots[1:]] == [hi for _, hi in lots[:-1]] and lots[0][0] == 0 and lots[-1][1] == len(texts)
    assert all(hi - lo == 1 or (hi - lo <= 1024 and sum(map(len, texts[lo:hi])) <= P.LOT_CHARS) for lo, hi in lots)
    assert list(P._lots([])) == []
