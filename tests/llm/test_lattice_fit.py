"""Weights fitted on the lattice: expected counts against all segmentations, and what they are worth on held-out texts."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from recallium.llm import lm_scoring as L

TOY = {k: math.log(v) for k, v in {"▁": 0.1, "▁a": 0.2, "a": 0.05, "b": 0.15, "ab": 0.1, "▁ab": 0.3, "aa": 0.02}.items()}
BYTES = [math.log(0.001 + k / 1e6) for k in range(256)]


def segmentations(s, pieces):
    """(pieces, weight) of each; a character outside the vocabulary is spelled by its bytes."""
    if not s:
        yield [], 1.0
        return
    for k in range(1, len(s) + 1):
        if s[:k] in pieces:
            w = math.exp(pieces[s[:k]])
        elif k == 1:
            w = math.exp(sum(BYTES[x] for x in s[0].encode()))
        else:
            continue
        for rest, v in segmentations(s[k:], pieces):
            yield [s[:k], *rest], w * v


def brute(word):
    every = list(segmentations("▁" + word, TOY))
    total = sum(w for _, w in every)
    out = {}
    for parts, w in every:
        for p in parts:
            out[p] = out.get(p, 0) + w / total
    return total, out


@pytest.mark.parametrize("letters", [0, 100])
def test_expected_counts_are_those_of_all_segmentations(monkeypatch, letters):
    monkeypatch.setattr(L, "PLAIN_LETTERS", letters)  # sums in log space, and plain ones
    lattice = L.Lattice(TOY, BYTES, 3)
    r = random.Random(1)
    for word in ["", "a", "ab", "aab", "bé世b", "aabaabaab", *("".join(r.choice("abx") for _ in range(r.randint(1, 9))) for _ in range(60))]:
        total, want = brute(word)
        got = {}
        for p, e in lattice.expected(word):
            got[p] = got.get(p, 0) + e
        assert lattice.log_probability(word) == pytest.approx(math.log(total))
        assert {k: v for k, v in got.items() if v > 1e-12} == pytest.approx(want)
        assert sum(len(p) * e for p, e in got.items()) == pytest.approx(len(word) + 1)


def test_many_words_together_equal_each_alone():
    """Sums over words of one length at a time, against the plain recursion, with the real vocabulary and odd letters."""
    import numpy as np

    lattice = L.Lattice(*L.piece_weights(L.default_vocabulary(), {}, 5))
    r = random.Random(6)
    words = ["", "the", "▁▁", "é" * 30, "世界", "\x00", "a" * 5000, *("".join(r.choice("etaoin shrdlué世-#0▁") for _ in range(r.randint(1, 40))) for _ in range(500))]
    times = np.array([r.randint(1, 9) for _ in words])
    assert lattice.log_probabilities(words) == pytest.approx([lattice.log_probability(w) for w in words])
    got, odd = lattice.expected_counts(words, times)
    want = {}
    for w, c in zip(words, times.tolist(), strict=True):
        for p, e in lattice.expected(w):
            want[p] = want.get(p, 0) + round(e * c * L.GRAIN)
    mine = {lattice.names[k]: int(n) for k, n in enumerate(got) if n} | {k: n for k, n in odd.items() if n}
    assert mine == pytest.approx({k: n for k, n in want.items() if n}, abs=2 * len(words))
    assert lattice.log_probabilities([]).shape == (0,) and not lattice.expected_counts([], times[:0])[0].any()


def test_long_words_do_not_underflow():
    lattice = L.Lattice(TOY, BYTES, 3)
    word = "xy" * 5000
    assert lattice.log_probability(word) == pytest.approx(TOY["▁"] + 5000 * (BYTES[ord("x")] + BYTES[ord("y")]))
    assert sum(len(p) * e for p, e in lattice.expected(word)) == pytest.approx(10_001)


def words_frame(spark, rows):
    return spark.createDataFrame([(w.encode(), c) for w, c in rows], "word binary, c long")


def test_a_round_of_fitting(spark):
    """From the tokenizer's counts, one round equals expected counts under those weights, whatever the partitions."""
    path = L.default_vocabulary()
    rows = [("the", 40), ("there", 7), ("then", 3), ("other", 5), ("世界", 2), ("zq", 1)]
    start = L.fit_pieces(words_frame(spark, rows), path, 10, rounds=0)
    lattice = L.Lattice(*L.piece_weights(path, start, 10))
    sp = L._processor(path)
    want = {}
    for w, c in rows:
        for p, e in lattice.expected(w):
            k = sp.piece_to_id(p)
            for q in [k] if p in lattice.log else [sp.piece_to_id(f"<0x{x:02X}>") for x in p.encode()]:
                want[q] = want.get(q, 0) + c * e
    one = L.fit_pieces(words_frame(spark, rows), path, 10, rounds=1)
    assert {k: v for k, v in one.items() if v > 1e-4} == pytest.approx({k: v for k, v in want.items() if v > 1e-4}, abs=1e-3)
    assert one == L.fit_pieces(words_frame(spark, rows).repartition(5), path, 10, rounds=1)
    assert L.fit_pieces(words_frame(spark, []), path, 0, rounds=2) == {}


def test_fitted_weights_are_better_on_held_out_texts(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = [L.score_documents(docs, rounds=r).filter("held_out").agg(F.sum("score")).first()[0] for r in (0, 1, 3)]
    assert held[0] < held[1] < held[2]
