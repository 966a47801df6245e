"""Media columns: progressive JPEG (op 9).

A payload is stored as the quantised coefficients of a 4:2:0 JPEG, 64 bytes a block, so it is read back without loss
from the coefficient arrays. The file is progressive: bands of coefficients (spectral selection) arrive first without
their lowest bit, which later scans add (successive approximation). Decoding accumulates all scans into coefficient
arrays, inverse-transforms them in numpy, upsamples chroma and gives full-resolution RGB tensors.

Entropy coding is vectorised over restart intervals: a *lane* is one interval, and each step takes one symbol of every
lane of every image of the batch. Arithmetic on samples is in whole numbers, so equal payloads give equal tensors.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from math import isqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RESTART = 4  # blocks of a restart interval
LOT_BYTES = 1 << 20  # of payload that is coded together
#: Fixed by the format: the zigzag order of an 8 x 8 block, from its rule.
ZIGZAG = np.array(sorted(range(64), key=lambda k: (k // 8 + k % 8, k % 8 if (k // 8 + k % 8) % 2 == 0 else k // 8)))
#: Components of a scan, first and last coefficient, high and low bit: the script of the files written here.
SCRIPT = [(c, 0, 0, 0, 1) for c in (0, 1, 2)] + [(0, 1, 31, 0, 1), (0, 32, 63, 0, 1), (1, 1, 63, 0, 1), (2, 1, 63, 0, 1)] + [(c, 0, 0, 1, 0) for c in (0, 1, 2)] + [(0, 1, 31, 1, 0), (0, 32, 63, 1, 0), (1, 1, 63, 1, 0), (2, 1, 63, 1, 0)]
_FREQUENT = [0x04, 0x05, 0x06]
AC_LENGTHS = {2: _FREQUENT, 9: [r << 4 | s for r in range(16) for s in range(8) if r << 4 | s not in _FREQUENT and (s or r in (0, 15))]}
DC_LENGTHS = {4: list(range(12))}


def _codes(lengths: dict[int, list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Canonical codes: per symbol its code and length."""
    code, bits = np.zeros(256, np.int64), np.zeros(256, np.int64)
    at = 0
    for n in range(1, 17):
        for s in lengths.get(n, []):
            code[s], bits[s] = at, n
            at += 1
        at <<= 1
    return code, bits


def _lookup(lengths: dict[int, list[int]]) -> np.ndarray:
    """By the next 16 bits: symbol << 5 | length; 0 where no code fits."""
    out = np.zeros(1 << 16, np.int32)
    code, bits = _codes(lengths)
    for n, symbols in lengths.items():
        for s in symbols:
            out[code[s] << (16 - n) : (code[s] + 1) << (16 - n)] = s << 5 | bits[s]
    return out


def _ragged(n: np.ndarray) -> np.ndarray:
    """0 to n[i] - 1 for each i, one behind the other."""
    return np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)


def _segment(marker: int, body: bytes) -> bytes:
    return bytes([0xFF, marker]) + (len(body) + 2).to_bytes(2, "big") + body


def _table(kind: int, lengths: dict[int, list[int]]) -> bytes:
    return bytes([kind, *(len(lengths.get(n, [])) for n in range(1, 17)), *(s for n in range(1, 17) for s in lengths.get(n, []))])


_HEAD = b"\xff\xd8" + _segment(0xDB, bytes([0] + [1] * 64)) + _segment(0xC4, _table(0x00, DC_LENGTHS) + _table(0x10, AC_LENGTHS)) + _segment(0xDD, RESTART.to_bytes(2, "big"))


def geometry(blocks: int) -> tuple[int, int]:
    """Width and height in units of 16 pixels (six blocks each) that hold so many blocks."""
    units = -(-blocks // 6)
    w = isqrt(max(units - 1, 0)) + 1
    return w, -(-units // w)


# --- writing

def _pack(lane: np.ndarray, code: np.ndarray, bits: np.ndarray, lanes: int) -> tuple[np.ndarray, np.ndarray]:
    """Concatenate codes (sorted by lane, at most 32 bits each) into bytes; each lane is filled up with ones.
    Returns the bytes and each lane's first byte (with the end)."""
    total_bits = np.cumsum(bits)
    stop = np.cumsum(np.bincount(lane, minlength=lanes))
    size = np.diff(np.concatenate([[0], total_bits])[stop], prepend=0)
    first = np.concatenate([[0], np.cumsum(-(-size // 8))])
    at = total_bits - bits + (first[:-1] * 8 - np.cumsum(size) + size)[lane]
    total = int(first[-1])
    # Codes that begin in the same 32 bits are put together in 63 bits, which reach into the next 32.
    word = at >> 5
    begin = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]])) if len(word) else np.empty(0, int)
    both = np.bitwise_or.reduceat(code << (63 - bits - (at & 31)), begin) if len(word) else np.empty(0, int)
    words = np.zeros(total // 4 + 2, np.int64)
    words[word[begin]] = both >> 31
    words[word[begin] + 1] |= (both & (1 << 31) - 1) << 1
    out = words.astype(">u4").view(np.uint8)[:total]
    rest = -size % 8
    last = first[1:] - 1
    fill = size > 0
    out[last[fill]] |= ((1 << rest[fill]) - 1).astype(np.uint8)
    return out, first


def _frame(raw: np.ndarray, first: np.ndarray, number: np.ndarray, final: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stuff zero bytes after 0xFF and put a restart marker after each lane that does not end its scan. ``number`` is
    the lane's place in its scan. Returns the bytes and each lane's end."""
    stuff = raw == 255
    shift = np.concatenate([[0], np.cumsum(stuff)])
    marks = np.concatenate([[0], np.cumsum(np.where(final, 0, 2))])
    lane = np.repeat(np.arange(len(first) - 1), np.diff(first))
    out = np.zeros(len(raw) + int(shift[-1]) + int(marks[-1]), np.uint8)
    out[np.arange(len(raw)) + shift[:-1] + marks[lane]] = raw
    ends = first[1:] + shift[first[1:]] + marks[1:]
    m = np.flatnonzero(~final)
    out[ends[m] - 2] = 255
    out[ends[m] - 1] = 0xD0 + number[m] % 8
    return out, ends


def _size_of(v: np.ndarray) -> np.ndarray:
    return np.frexp(np.abs(v).astype(np.float64))[1].astype(np.int64)


def _value_codes() -> np.ndarray:
    """By run of zeros (0 to 15) and value + 128: code << 5 | bits of an AC symbol with its value's bits."""
    code, bits = _codes(AC_LENGTHS)
    val = np.arange(-128, 129)
    s = _size_of(val)
    sym = np.arange(16)[:, None] << 4 | s
    return (code[sym] << s | np.where(val < 0, val + (1 << s) - 1, val)) << 5 | bits[sym] + s


_VALUE_CODES = _value_codes()
_EOB, _ZRL = (tuple(int(t[sym]) for t in _codes(AC_LENGTHS)) for sym in (0x00, 0xF0))


def _fold(known: np.ndarray, bit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per row the bits of its known columns (at most 32) as one code, and their number."""
    code = np.zeros(len(known), np.int64)
    mask, bit = np.ascontiguousarray(known.T), np.ascontiguousarray(bit.T)
    for m, x in zip(mask, bit, strict=True):
        code <<= m
        code |= x & m
    return code, known.sum(1)


def _code_scan(c: np.ndarray, lane: np.ndarray, ss: int, se: int, ah: int, al: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of one kind of scan over blocks c (n, 64 in zigzag order, values of -128 to 127), as (lane, code, bits) in
    stream order."""
    n = len(c)
    if ss == 0 and ah:
        return lane, (c[:, 0] >> al).astype(np.int64) & 1, np.ones(n, np.int64)
    if ss == 0:
        v = c[:, 0].astype(np.int64) >> al
        diff = v - np.where(np.concatenate([[True], lane[1:] != lane[:-1]]), 0, np.concatenate([[0], v[:-1]]))
        s = _size_of(diff)
        dc_code, dc_bits = _codes(DC_LENGTHS)
        return lane, dc_code[s] << s | np.where(diff < 0, diff + (1 << s) - 1, diff), dc_bits[s] + s
    band = c[:, ss : se + 1]
    width = se - ss + 1
    size = np.abs(band) >> al
    if not ah:
        v = (np.sign(band) * size).ravel()
        where = np.flatnonzero(v)
        row = where // width
        # Zeros before a value: up to the value before it, or to its block's begin.
        before = np.maximum(np.concatenate([[-1], where[:-1]])[: len(where)], row * width - 1)
        run = where - before - 1
        entry = _VALUE_CODES[run & 15, v[where] + 128]
        last = np.full(n, -1)
        last[row] = where - row * width
        eob = np.flatnonzero(last < width - 1)
        if not len(eob) and not run.any():
            return lane[row], entry >> 5, entry & 31
        longs = np.repeat(np.arange(len(row)), run >> 4)
        pos = np.concatenate([where * 4 + 2, where[longs] * 4 + 1, eob * width * 4 + (width * 4 - 1)])
        rows = np.concatenate([row, row[longs], eob])
        code = np.concatenate([entry >> 5, np.full(len(longs), _ZRL[0]), np.full(len(eob), _EOB[0])])
        bits = np.concatenate([entry & 31, np.full(len(longs), _ZRL[1]), np.full(len(eob), _EOB[1])])
        order = np.argsort(pos, kind="stable")
        return lane[rows[order]], code[order], bits[order]
    plain = ~(size == 1).any(1)
    # Blocks without new coefficients: one end-of-band symbol, then a bit of each known coefficient.
    p = np.flatnonzero(plain)
    known, bit = size[p] > 1, size[p] & 1
    parts = [(np.full(len(p), _EOB[0]), np.full(len(p), _EOB[1]))] + [_fold(known[:, k : k + 32], bit[:, k : k + 32]) for k in range(0, width, 32)]
    row = np.repeat(p, len(parts))
    code, bits = (np.stack([x[k] for x in parts], 1).ravel() for k in (0, 1))
    q = np.flatnonzero(~plain)
    if not len(q):
        return lane[row], code, bits
    q_row, q_code, q_bits = _code_new(band[q], size[q])
    row = np.concatenate([row, q[q_row]])
    order = np.argsort(row, kind="stable")
    return lane[row[order]], np.concatenate([code, q_code])[order], np.concatenate([bits, q_bits])[order]


def _code_new(band: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Refinement of blocks with new coefficients, as (row, code, bits) in stream order. A symbol stands at each new
    coefficient, at each sixteenth zero since the one before, and behind the last if the band goes on; bits of known
    coefficients follow the next symbol."""
    n, width = band.shape
    known, new, zero = size > 1, size == 1, size == 0
    end = width - 1 - new[:, ::-1].argmax(1)
    zeros = np.cumsum(zero, 1)
    since = zeros - np.maximum.accumulate(np.where(new, zeros, 0), 1)
    run = np.zeros((n, width), np.int64)
    run[:, 1:] = since[:, :-1]
    zrl = zero & (since % 16 == 0) & (np.arange(width) < end[:, None])
    symbol = np.concatenate([new | zrl, (end < width - 1)[:, None]], 1)
    turn = np.cumsum(symbol, 1) - symbol
    code, bits = _codes(AC_LENGTHS)
    r1, k1 = np.nonzero(new)
    s1 = run[r1, k1] % 16 << 4 | 1
    r2, k2 = np.nonzero(zrl)
    r3 = np.flatnonzero(symbol[:, -1])
    r4, k4 = np.nonzero(known)
    key = np.concatenate([turn[r1, k1] * 128, turn[r2, k2] * 128, turn[r3, -1] * 128, turn[r4, k4] * 128 + 1 + k4])
    row = np.concatenate([r1, r2, r3, r4])
    codes = np.concatenate([code[s1] << 1 | (band[r1, k1] > 0), np.full(len(r2), _ZRL[0]), np.full(len(r3), _EOB[0]), size[r4, k4] & 1])
    lens = np.concatenate([bits[s1] + 1, np.full(len(r2), _ZRL[1]), np.full(len(r3), _EOB[1]), np.ones(len(r4), np.int64)])
    order = np.argsort(row * (1 << 14) + key, kind="stable")
    return row[order], codes[order], lens[order]


def encode_payloads(payloads: list[bytes]) -> list[bytes]:
    """One progressive JPEG per payload (a positive multiple of 64 bytes)."""
    sizes = [len(p) // 64 for p in payloads]
    shapes = [geometry(n) for n in sizes]
    per = np.array([[4 * w * h, w * h, w * h] for w, h in shapes])
    total = np.concatenate([[0], np.cumsum(per.sum(1))])
    coef = np.zeros((int(total[-1]), 64), np.int32)
    n = np.array(sizes)
    coef[np.repeat(total[:-1], n) + _ragged(n)] = np.frombuffer(b"".join(payloads), np.uint8).astype(np.int32).reshape(-1, 64) - 128
    begin = total[:-1, None] + np.concatenate([np.zeros((len(per), 1), np.int64), np.cumsum(per, 1)[:, :2]], 1)
    scans: list[list[bytes]] = [[] for _ in payloads]
    layouts = []
    for comp in range(3):
        lens = per[:, comp]
        place = _ragged(lens)
        lanes = -(-lens // RESTART)
        base = np.concatenate([[0], np.cumsum(lanes)])
        final = np.zeros(base[-1], bool)
        final[base[1:] - 1] = True
        layouts.append((coef[np.repeat(begin[:, comp], lens) + place], np.repeat(base[:-1], lens) + place // RESTART, base, _ragged(lanes), final))
    for comp, *band in SCRIPT:
        part, lane, base, number, final = layouts[comp]
        ln, code, bits = _code_scan(part, lane, *band)
        raw, first = _pack(ln, code, bits, int(base[-1]))
        out, ends = _frame(raw, first, number, final)
        stop = ends[base[1:] - 1]
        head = _segment(0xDA, bytes([1, comp + 1, 0x00, band[0], band[1], band[2] << 4 | band[3]]))
        data = out.tobytes()
        prev = 0
        for k, e in enumerate(stop.tolist()):
            scans[k].append(head + data[prev:e])
            prev = e
    files = []
    for k, (w, h) in enumerate(shapes):
        frame = _segment(0xC2, bytes([8]) + (16 * h).to_bytes(2, "big") + (16 * w).to_bytes(2, "big") + bytes([3, 1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0]))
        files.append(_HEAD + _segment(0xFE, b"blocks=%d" % sizes[k]) + frame + b"".join(scans[k]) + b"\xff\xd9")
    return files


# --- reading

@lru_cache(1024)
def _scan_head(body: bytes, ids: tuple[int, ...]) -> tuple:
    """Of a scan's header: components, first and last coefficient, high and low bit, the components' tables."""
    n = body[0]
    ss, se, a = body[1 + 2 * n : 4 + 2 * n]
    sel = [body[2 + 2 * k] for k in range(n)]
    return tuple(ids.index(body[1 + 2 * k]) for k in range(n)), ss, se, a >> 4, a & 15, tuple(0x10 | s & 15 if ss else s >> 4 for s in sel)


_MARKER = re.compile(rb"\xff[^\x00\xff\xd0-\xd7]")


class _Image:
    """What the headers of a file say, and its scans' bytes."""

    def __init__(self, data: bytes):
        self.scans: list[tuple] = []
        self.comment, self.restart = b"", 0
        self.quant: dict[int, np.ndarray] = {}
        tables: dict[int, bytes] = {}
        at = 2
        while at < len(data) - 1:
            if data[at] != 0xFF:
                raise ValueError("a marker was expected")
            m = data[at + 1]
            if m == 0xD9:
                break
            size = int.from_bytes(data[at + 2 : at + 4], "big")
            body = data[at + 4 : at + 2 + size]
            at += 2 + size
            if m == 0xDB:
                while body:
                    wide = body[0] >> 4
                    n = 128 if wide else 64
                    self.quant[body[0] & 15] = np.frombuffer(body[1 : 1 + n], ">u2" if wide else np.uint8).astype(np.int64)
                    body = body[1 + n :]
            elif m == 0xC4:
                while body:
                    n = 17 + sum(body[1:17])
                    tables[body[0]] = body[1:n]
                    body = body[n:]
            elif m == 0xDD:
                self.restart = int.from_bytes(body, "big")
            elif m == 0xFE:
                self.comment = body
            elif m == 0xC2:
                self.height, self.width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
                self.parts = [(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(body[5])]
            elif m in (0xC0, 0xC1, 0xC3, *range(0xC5, 0xD0)):
                raise ValueError("not a progressive Huffman-coded file")
            elif m == 0xDA:
                comps, ss, se, ah, al, sel = _scan_head(body, tuple([p[0] for p in self.parts]))
                used = tuple([tables.get(s, b"") for s in sel])
                stop = _MARKER.search(data, at)
                if stop is None:
                    raise ValueError("a scan has no end")
                end = stop.start()
                self.scans.append((comps, ss, se, ah, al, used, self.restart, data[at:end]))
                at = end
        hm, vm = max(p[1] for p in self.parts), max(p[2] for p in self.parts)
        self.units = (-(-self.width // (8 * hm)), -(-self.height // (8 * vm)))
        self.most = (hm, vm)
        self.grids = [(self.units[0] * p[1], self.units[1] * p[2]) for p in self.parts]  # blocks across and down, in whole units
        self.starts = np.concatenate([[0], np.cumsum([w * h for w, h in self.grids])])

    def order(self, comps: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
        """Blocks of a scan in stream order (numbers in the image's array), and the component of each."""
        if len(comps) == 1:
            c = comps[0]
            w, _ = self.grids[c]
            hs, vs = self.parts[c][1:3]
            cols = -(-(-(-self.width * hs // self.most[0])) // 8)
            rows = -(-(-(-self.height * vs // self.most[1])) // 8)
            return (self.starts[c] + np.arange(rows)[:, None] * w + np.arange(cols)).ravel(), np.full(rows * cols, c)
        out, which = [], []
        for c in comps:
            hs, vs = self.parts[c][1:3]
            w, _ = self.grids[c]
            y, x = np.arange(self.units[1]), np.arange(self.units[0])
            n = self.starts[c] + (y[:, None, None, None] * vs + np.arange(vs)[:, None]) * w + x[None, :, None, None] * hs + np.arange(hs)
            out.append(n.reshape(self.units[0] * self.units[1], vs * hs))
            which.append(np.full(vs * hs, c))
        return np.concatenate(out, 1).ravel(), np.tile(np.concatenate(which), self.units[0] * self.units[1])


def _dht(body: bytes) -> dict[int, list[int]]:
    at, out = 16, {}
    for n in range(1, 17):
        if body[n - 1]:
            out[n] = list(body[at : at + body[n - 1]])
            at += body[n - 1]
    return out


class _Bits:
    """The scan bytes of many lanes, unstuffed; 24 bits from any byte on."""

    def __init__(self, data: bytes, bounds: np.ndarray, lanes_of: np.ndarray):
        raw = np.frombuffer(data, np.uint8)
        after = np.concatenate([[False], raw[:-1] == 255])
        stuffed = after & (raw == 0)
        mark = after & (raw >= 0xD0) & (raw <= 0xD7)
        drop = stuffed | mark
        drop[:-1] |= mark[1:]
        kept = np.cumsum(~drop)
        starts = np.sort(np.concatenate([bounds, np.flatnonzero(mark) + 1]))
        if len(starts) != lanes_of.sum():
            raise ValueError("restart markers do not match the restart interval")
        self.first = np.where(starts > 0, kept[starts - 1], 0).astype(np.int64) * 8
        b = np.concatenate([raw[~drop], np.full(8, 255, np.uint8)]).astype(np.int32)
        self.word = b[:-2] << 16 | b[1:-1] << 8 | b[2:]

    def peek(self, at: np.ndarray, n) -> np.ndarray:
        """The next n bits (at most 17)."""
        return (self.word[at >> 3] >> (24 - n - (at & 7))) & ((1 << n) - 1)


def _extend(v: np.ndarray, s: np.ndarray) -> np.ndarray:
    return np.where(v < (1 << np.maximum(s - 1, 0)), v - (1 << s) + 1, v)


def _read_dc(bits: _Bits, tables: list[np.ndarray], blocks: np.ndarray, which: np.ndarray, first: np.ndarray, count: np.ndarray, coef: np.ndarray, al: int, per: int) -> None:
    at, lane = bits.first.copy(), np.arange(len(first))
    pred = np.zeros((len(first), 4), np.int64)
    for step in range(int(count.max(initial=0))):
        lane = lane[count[lane] > step]
        b = first[lane] + step
        c = which[b]
        entry = np.stack(tables)[np.minimum(c, len(tables) - 1) if len(tables) > 1 else np.zeros(len(c), int), bits.peek(at[lane], 16)]
        at[lane] += entry & 31
        s = entry >> 5
        pred[lane, c] += _extend(bits.peek(at[lane], s), s)
        at[lane] += s
        coef[blocks[b], 0] = pred[lane, c] << al


def _read_ac(bits: _Bits, body: bytes, blocks: np.ndarray, first: np.ndarray, count: np.ndarray, coef: np.ndarray, ss: int, se: int, al: int) -> None:
    at, b, end = bits.first.copy(), first.copy(), first + count
    k = np.full(len(at), ss)
    out = coef.reshape(-1)
    table, direct = _cached(body), _cached_values(body)
    begin = blocks * 64
    into = begin[b] if len(b) else b
    while len(at):
        ahead = bits.peek(at, 16)
        entry = direct[ahead]
        at += entry & 31
        k += (entry >> 5) & 127
        v = entry >> 12
        skip = None
        if not v.all():
            odd = np.flatnonzero(entry == 0)
            if len(odd):  # values and runs of ended blocks whose bits lie beyond the 16
                entry = table[ahead[odd]]
                a = at[odd] + (entry & 31)
                s, r = (entry >> 5) & 15, entry >> 9
                more = np.where(s > 0, s, np.where(r < 15, r, 0))
                x = bits.peek(a, more)
                at[odd] = a + more
                k[odd] += np.where(s > 0, r + 1, np.where(r == 15, 16, 64))
                v[odd] = np.where(s > 0, _extend(x, s), 0)
                skip = np.zeros(len(at), np.int64)
                skip[odd] = np.where((s == 0) & (r < 15), (1 << r) - 1 + x, 0)
            put = np.flatnonzero(v)
            out[into[put] + k[put] - 1] = v[put] << al
        else:
            out[into + k - 1] = v << al
        over = np.flatnonzero(k > se)
        if len(over):
            b[over] += 1 if skip is None else 1 + skip[over]
            k[over] = ss
            live = b < end
            if not live.all():
                at, b, end, k = at[live], b[live], end[live], k[live]
            into = begin[b]


def _refine_ac(bits: _Bits, table: np.ndarray, blocks: np.ndarray, first: np.ndarray, count: np.ndarray, coef: np.ndarray, ss: int, se: int, al: int) -> None:
    at, b, end = bits.first.copy(), first.copy(), first + count
    k, eob = np.full(len(at), ss), np.zeros(len(at), np.int64)
    cols = np.arange(ss, se + 1)
    while True:
        live = b < end
        if not live.all():
            at, b, end, k, eob = at[live], b[live], end[live], k[live], eob[live]
        if not len(at):
            return
        fresh = eob == 0
        entry = np.where(fresh, table[bits.peek(at, 16)], 0)
        at += entry & 31
        s, r = (entry >> 5) & 15, entry >> 9
        is_eob = fresh & (s == 0) & (r < 15)
        more = np.where(is_eob, r, np.where(s > 0, 1, 0))
        v = bits.peek(at, more)
        at += more
        eob = np.where(is_eob, (1 << r) + v, eob)
        band = coef[blocks[b], ss : se + 1]
        known = band != 0
        ahead = cols >= k[:, None]
        # The symbol's own place: the coefficient after r others that are still zero; past the band if there is none.
        zeros = np.cumsum(~known & ahead, 1, dtype=np.int16)
        need = np.where(eob > 0, 1 << 20, np.where((s == 0) & (r == 15), 16, r + 1))
        target = np.where(zeros[:, -1] >= need, (zeros < need[:, None]).sum(1) + ss, se + 1)
        fix = known & ahead & (cols < target[:, None])
        rank = np.cumsum(fix, 1, dtype=np.int16)
        where = (at[:, None] + rank - 1)[fix]
        got = (bits.word[where >> 3] >> (23 - (where & 7))) & 1
        val = band[fix]
        band[fix] = val + np.where(got == 1, np.sign(val) << al, 0)
        at += rank[:, -1]
        put = np.flatnonzero((s > 0) & (target <= se))
        band[put, target[put] - ss] = np.where(v[put] == 1, 1 << al, -(1 << al))
        coef[blocks[b], ss : se + 1] = band
        k = target + 1
        over = (k > se) | (eob > 0)
        eob = np.maximum(eob - 1, 0)
        b = b + over
        k[over] = ss


def decode_coefficients(files: list[bytes]) -> tuple[list[_Image], np.ndarray, np.ndarray]:
    """Accumulate all scans of all files: headers, coefficients (blocks, 64 in zigzag order), each file's first block."""
    images = [_Image(f) for f in files]
    base = np.concatenate([[0], np.cumsum([im.starts[-1] for im in images])]).astype(np.int64)
    coef = np.zeros((int(base[-1]), 64), np.int32)
    orders: dict[tuple, tuple[np.ndarray, np.ndarray]] = {}
    layouts: dict[tuple, tuple] = {}

    def order(k: int, comps: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
        key = (images[k].width, images[k].height, *images[k].parts, comps)
        if key not in orders:
            orders[key] = images[k].order(comps)
        return orders[key]

    def layout(comps: tuple[int, ...], restart: int, per: int, members: list[int]) -> tuple:
        """Blocks in stream order, the component of each, and the lanes: how many a member has, first block, count."""
        key = (comps, restart, per, *members)
        if key not in layouts:
            found = [order(k, comps) for k in members]
            n = np.array([len(o) for o, _ in found])
            blocks = np.concatenate([o for o, _ in found]) + np.repeat(base[members], n)
            step = np.full(len(n), restart * per) if restart else n
            lanes = -(-n // step)
            begin = np.cumsum(n) - n
            first = np.repeat(begin, lanes) + _ragged(lanes) * np.repeat(step, lanes)
            count = np.minimum(np.repeat(step, lanes), np.repeat(begin + n, lanes) - first)
            layouts[key] = (blocks, np.concatenate([w for _, w in found]), lanes, first, count)
        return layouts[key]

    for turn in range(max((len(im.scans) for im in images), default=0)):
        groups: dict[tuple, list[int]] = {}
        for k, im in enumerate(images):
            if turn < len(im.scans):
                comps, ss, se, ah, al, used, restart, _ = im.scans[turn]
                groups.setdefault((comps, ss, se, ah, al, used, restart), []).append(k)
        for (comps, ss, se, ah, al, used, restart), members in groups.items():
            per = 1 if len(comps) == 1 else sum(images[members[0]].parts[c][1] * images[members[0]].parts[c][2] for c in comps)
            blocks, which, lanes, first, count = layout(comps, restart, per, members)
            data = [images[k].scans[turn][7] for k in members]
            bounds = np.concatenate([[0], np.cumsum([len(d) for d in data])[:-1]]).astype(np.int64)
            bits = _Bits(b"".join(data), bounds, lanes)
            if ss == 0 and ah:
                lane = np.repeat(np.arange(len(first)), count)
                at = bits.first[lane] + _ragged(count)
                rows = blocks[np.repeat(first, count) + (at - bits.first[lane])]
                coef[rows, 0] |= bits.peek(at, 1) << al
            elif ss == 0:
                _read_dc(bits, [_cached(t) for t in used], blocks, which, first, count, coef, al, per)
            elif ah:
                _refine_ac(bits, _cached(used[0]), blocks, first, count, coef, ss, se, al)
            else:
                _read_ac(bits, used[0], blocks, first, count, coef, ss, se, al)
    return images, coef, base


_LOOKUPS: dict[bytes, np.ndarray] = {}
_VALUES: dict[bytes, np.ndarray] = {}


def _cached(body: bytes) -> np.ndarray:
    if body not in _LOOKUPS:
        _LOOKUPS[body] = _lookup(_dht(body))
    return _LOOKUPS[body]


def _cached_values(body: bytes) -> np.ndarray:
    """By the next 16 bits, where they hold a whole AC symbol: value << 12 | advance << 5 | bits (an ended block advances
    by 64); else 0."""
    if body not in _VALUES:
        ahead = np.arange(1 << 16)
        entry = _cached(body).astype(np.int64)
        s, r = (entry >> 5) & 15, entry >> 9
        size = (entry & 31) + s
        left = np.maximum(16 - size, 0)
        value = np.where(s > 0, _extend((ahead >> left) & ((1 << s) - 1), s), 0)
        whole = (entry & 31 > 0) & (size <= 16) & ((s > 0) | (r == 0) | (r == 15))
        _VALUES[body] = np.where(whole, value << 12 | np.where(s > 0, r + 1, np.where(r == 15, 16, 64)) << 5 | size, 0)
    return _VALUES[body]


def _basis() -> np.ndarray:
    """Inverse transform of a zigzag block to 64 samples, times 2**13, rounded to whole numbers."""
    x = np.arange(8)
    one = np.cos((2 * x[None, :] + 1) * x[:, None] * np.pi / 16) * np.where(x[:, None] == 0, 0.5**0.5, 1.0) / 2
    two = np.einsum("vy,ux->vuyx", one, one).reshape(64, 64)
    return np.rint(two[ZIGZAG] * 8192)


_BASIS = _basis()


def rgb_tensors(images: list[_Image], coef: np.ndarray, base: np.ndarray) -> list[np.ndarray]:
    """Full-resolution RGB, (height, width, 3) of bytes: inverse transform, chroma repeated, colours converted."""
    out = []
    scaled = coef.astype(np.float64)
    for k, im in enumerate(images):
        for c, p in enumerate(im.parts):
            q = im.quant[p[3]]
            if (q != 1).any():
                scaled[base[k] + im.starts[c] : base[k] + im.starts[c + 1]] *= q
    # Products and sums are whole numbers below 2**53, so the result does not depend on the order of summation.
    samples = scaled @ _BASIS
    samples += 1 << 12
    samples /= 1 << 13
    np.floor(samples, out=samples)
    samples += 128
    samples = np.clip(samples, 0, 255, out=samples).astype(np.int32)
    for k, im in enumerate(images):
        planes = []
        for c, p in enumerate(im.parts):
            w, h = im.grids[c]
            plane = samples[base[k] + im.starts[c] : base[k] + im.starts[c + 1]].reshape(h, w, 8, 8).swapaxes(1, 2).reshape(h * 8, w * 8)
            fx, fy = im.most[0] // p[1], im.most[1] // p[2]
            if fx > 1 or fy > 1:
                plane = plane.repeat(fy, 0).repeat(fx, 1)
            planes.append(plane[: im.height, : im.width])
        if len(planes) == 1:
            planes *= 3
            out.append(np.stack(planes, 2).astype(np.uint8))
            continue
        y, cb, cr = planes[0], planes[1] - 128, planes[2] - 128
        rgb = np.stack([y + (91881 * cr + 32768 >> 16), y - (22554 * cb + 46802 * cr - 32768 >> 16), y + (116130 * cb + 32768 >> 16)], 2)
        out.append(np.clip(rgb, 0, 255).astype(np.uint8))
    return out


def payload_of(text: str | None) -> tuple[bytes, int]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + b"\0" * (max(64, -(-len(raw) // 64) * 64) - len(raw)), len(raw)


def read_back(images: list[_Image], coef: np.ndarray, base: np.ndarray) -> list[bytes]:
    """Payloads from the coefficient arrays."""
    return [(coef[base[k] : base[k] + int(im.comment.partition(b"=")[2])] + 128).astype(np.uint8).tobytes() for k, im in enumerate(images)]


def feature_of(rgb: np.ndarray) -> str:
    mean = rgb.reshape(-1, 3).sum(0, dtype=np.int64)
    return f"{rgb.shape[1]}x{rgb.shape[0]}:{mean[0]}:{mean[1]}:{mean[2]}:{zlib.crc32(rgb.tobytes()):08x}"


def media_column(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: bool = False) -> DataFrame:
    """Per row: id, ``n_bytes``, ``payload_bytes``, ``payload_sha256``, ``tail_crc32``, ``media_bytes``,
    ``media_sha256``, ``feature`` (size, sums of the channels and checksum of the RGB tensor); with ``keep`` also
    ``media``, ``rgb`` (bytes, row by row), ``width`` and ``height``.

    Null texts count as empty: a payload of 64 zero bytes. Repeated rows give repeated results; an empty table gives
    none; extra columns are ignored.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [payload_of(t) for t in b.column(1).to_pylist()]
            lo = 0
            while lo < len(made):
                hi, size = lo, 0
                while hi < len(made) and (hi == lo or size + len(made[hi][0]) <= LOT_BYTES):
                    size += len(made[hi][0])
                    hi += 1
                files = encode_payloads([p for p, _ in made[lo:hi]])
                decoded = decode_coefficients(files)
                back = read_back(*decoded)
                rgb = rgb_tensors(*decoded)
                cols = [b.column(0).slice(lo, hi - lo), [n for _, n in made[lo:hi]], [len(p) for p in back], [hashlib.sha256(p).hexdigest() for p in back], [zlib.crc32(p[-64:]) for p in back], [len(f) for f in files], [hashlib.sha256(f).hexdigest() for f in files], [feature_of(x) for x in rgb]]
                kinds = [None, pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                names = [id_col, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
                arrays = [c if t is None else pa.array(c, t) for c, t in zip(cols, kinds, strict=True)]
                if keep:
                    arrays += [pa.array(files, pa.binary()), pa.array([x.tobytes() for x in rgb], pa.binary()), pa.array([x.shape[1] for x in rgb], pa.int32()), pa.array([x.shape[0] for x in rgb], pa.int32())]
                    names = [*names, "media", "rgb", "width", "height"]
                yield pa.RecordBatch.from_arrays(arrays, names)
                lo = hi

    extra = ", media binary, rgb binary, width int, height int" if keep else ""
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string{extra}")


def store_media(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write each row's file and full-resolution RGB tensor (three bytes a pixel, row by row, about twice the payload) as a
    table under ``path``; the query's digests need no such table, ``read_media`` computes them from it again."""
    media_column(docs, id_col, text_col, keep=True).select(id_col, "media", "rgb", "width", "height").write.parquet(path)


def read_media(spark: SparkSession, path: str) -> DataFrame:
    """The stored columns, with ``media_bytes``, ``media_sha256`` and ``feature`` of what was read."""
    t = spark.read.parquet(path)

    @F.pandas_udf("string")
    def feature(rgb: pd.Series, width: pd.Series, height: pd.Series) -> pd.Series:
        return pd.Series([feature_of(np.frombuffer(x, np.uint8).reshape(h, w, 3)) for x, w, h in zip(rgb, width, height, strict=True)], dtype=object)

    return t.select("*", F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), feature("rgb", "width", "height").alias("feature"))
