"""The JPEG codec's tables, layouts and refinement against plain versions."""

from __future__ import annotations

import numpy as np

from recallium.llm import media as M

SETS = [[128] * 20 + [127, 129], [0, 255, 127, 128, 129, 130], list(range(256)), [128], [128] * 60 + [129], [127, 128], [130] * 30 + [129, 128]]


def payloads(seed, each):
    rng = np.random.default_rng(seed)
    return [rng.choice(v, 64 * int(n)).astype(np.uint8).tobytes() for v in SETS for n in rng.integers(1, 30, each)]


def test_layouts_are_made_once_for_images_of_one_size(monkeypatch):
    pay = [bytes([65 + k]) * (64 * n) for n in (7, 20) for k in range(8)]
    files = M.encode_payloads(pay)
    calls = []
    order = M._Image.order
    monkeypatch.setattr(M._Image, "order", lambda im, comps: (calls.append((im.width, im.height, comps)), order(im, comps))[1])
    assert M.read_back(*M.decode_coefficients(files)) == pay
    assert len(calls) == len(set(calls)) == 2 * 3


def refined(size, band):
    """Bits of a refinement scan's block, coefficient by coefficient."""
    code, bits = M._codes(M.AC_LENGTHS)
    out, run, held = "", 0, ""
    end = max((k for k, v in enumerate(size) if v == 1), default=-1)
    for k, v in enumerate(size):
        if v > 1:
            held += str(v & 1)
        elif v == 1:
            out += f"{code[run << 4 | 1]:0{bits[run << 4 | 1]}b}{int(band[k] > 0)}" + held
            run, held = 0, ""
        else:
            run += 1
            if run == 16 and k < end:
                out += f"{code[0xF0]:0{bits[0xF0]}b}" + held
                run, held = 0, ""
    return out + (f"{code[0]:0{bits[0]}b}" + held if end < len(size) - 1 else "")


def test_refinement_scans():
    rng = np.random.default_rng(8)
    blocks = np.concatenate([rng.choice(v, (40, 64)) for v in ([0] * 30 + [1, -1], [0] * 9 + [1, -1, 2, 3, -7], [2, -3, 90, -128, 127], [0, 0, 0, 5, -6], [0], [1])]).astype(np.int32)
    for ss, se in ((1, 31), (32, 63), (1, 63)):
        lane, code, bits = M._code_scan(blocks, np.arange(len(blocks)), ss, se, 1, 0)
        assert (np.diff(lane) >= 0).all() and bits.max() <= 32
        got = [""] * len(blocks)
        for n, c, b in zip(lane.tolist(), code.tolist(), bits.tolist(), strict=True):
            got[n] += f"{c:0{b}b}" if b else ""
        assert got == [refined(np.abs(x[ss : se + 1]), x[ss : se + 1]) for x in blocks]


def test_packed_codes():
    rng = np.random.default_rng(9)
    lane = np.sort(rng.integers(0, 300, 4000))
    bits = rng.integers(0, 33, 4000)
    code = np.array([int(rng.integers(0, 1 << b)) for b in bits.tolist()])
    raw, first = M._pack(lane, code, bits, 320)
    for n in range(320):
        want = "".join(f"{c:0{b}b}" for c, b in zip(code[lane == n].tolist(), bits[lane == n].tolist(), strict=True) if b)
        want += "1" * (-len(want) % 8)
        assert "".join(f"{x:08b}" for x in raw[first[n] : first[n + 1]].tolist()) == want


def test_codes_longer_than_sixteen_bits_with_their_values(monkeypatch):
    """Other files' tables: a code and its value's bits may not fit into the 16 bits that are looked up at once."""
    symbols = [r << 4 | s for r in range(16) for s in range(9)]
    rng = np.random.default_rng(10)
    rng.shuffle(symbols)
    lengths = {4: symbols[:6], 9: symbols[6:40], 14: symbols[40:]}
    monkeypatch.setattr(M, "AC_LENGTHS", lengths)
    monkeypatch.setattr(M, "_VALUE_CODES", M._value_codes())
    (eob, zrl) = (tuple(int(t[sym]) for t in M._codes(lengths)) for sym in (0x00, 0xF0))
    monkeypatch.setattr(M, "_EOB", eob)
    monkeypatch.setattr(M, "_ZRL", zrl)
    tables = M._segment(0xC4, M._table(0x00, M.DC_LENGTHS) + M._table(0x10, lengths))
    monkeypatch.setattr(M, "_HEAD", b"\xff\xd8" + M._segment(0xDB, bytes([0] + [1] * 64)) + tables + M._segment(0xDD, M.RESTART.to_bytes(2, "big")))
    pay = payloads(11, 6)
    assert M.read_back(*M.decode_coefficients(M.encode_payloads(pay))) == pay
    assert (M._cached_values(M._table(0x10, lengths)[1:]) == 0).any()


def test_runs_of_ended_blocks():
    """One symbol may end its block and more behind it, within a restart interval."""
    lengths = {2: [0x01, 0x10, 0x20], 4: [0x00, 0x11]}
    code, bits = M._codes(lengths)

    def put(sym, extra=""):
        return f"{code[sym]:0{bits[sym]}b}" + extra

    # block 0: 1 at coefficient 1, then itself and two more blocks end (0x10 with bit 1: 2 + 1); block 3: -1 at 2, end
    text = put(0x01, "1") + put(0x10, "1") + put(0x11, "0") + put(0x00)
    text += "1" * (-len(text) % 8)
    data = int(text, 2).to_bytes(len(text) // 8, "big")
    coef = np.zeros((4, 64), np.int32)
    body = M._table(0x10, lengths)[1:]
    M._read_ac(M._Bits(data, np.array([0]), np.array([1])), body, np.arange(4), np.array([0]), np.array([4]), coef, 1, 63, 1)
    want = np.zeros((4, 64), np.int32)
    want[0, 1], want[3, 2] = 2, -2
    assert (coef == want).all()
