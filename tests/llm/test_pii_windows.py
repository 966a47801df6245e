"""Decoding of windows: the fast emissions, the bound that settles quiet windows, repeated texts."""

from __future__ import annotations

import numpy as np

from recallium.llm import pii as P


def walk(e, trans):
    """Whether no kind beats "outside" at any place of one window, by the plain recursion."""
    v = e[0].copy()
    for x in e[1:]:
        out, back = v[0] + trans[0, 0], (v[1:] + trans[1:, 0]).max()
        if back > out:
            return False
        v = np.concatenate([[max(out, back)], np.maximum(v[0] + trans[0, 1:], v[1:] + trans.diagonal()[1:])]) + x
    return bool(v.argmax() == 0)


def test_quiet_windows():
    rng = np.random.default_rng(4)
    for trans in (np.full((5, 5), -2.0, np.float32) + 3.8 * np.eye(5, dtype=np.float32), rng.normal(0, 1, (5, 5)).astype(np.float32)):
        for shift in (0, 3, 6, 12):
            e = rng.normal(0, 2, (24, 5, 200)).astype(np.float32)
            e[:, 0] += shift
            calm = P.quiet(e, trans)
            assert calm.tolist() == [walk(e[:, :, n], trans) for n in range(200)]
            assert not P.viterbi(e[:, :, calm], trans).any()


def test_fast_emissions_and_far_gates():
    p = P.start_parameters(np.random.default_rng(1))
    c = np.random.default_rng(2).integers(0, P.CLASSES, (40, 7)).astype(np.uint8)
    want = P.emissions(p, P.run_lstm(p, c)[0]).transpose(0, 2, 1)
    assert np.abs(P.fast_emissions(p, c) - want).max() < 1e-4
    far = {**p, "c": p["c"] - 400}  # every gate shut: exp overflows, nothing else does
    assert np.isfinite(P.fast_emissions(far, c)).all()


def test_repeated_texts_have_equal_spans():
    p = P.start_parameters(np.random.default_rng(1))
    texts = ["mail a.b@c.example.org", "", "mail a.b@c.example.org", "x" * 700, ""]
    got = P.find_spans(p, texts)
    assert len(got) == 5 and got[0] == got[2] and got[1] == got[4] == ([], []) and got[0][0] == [(5, 0, 22)]
