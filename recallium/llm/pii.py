"""Personal data by a character-level bidirectional LSTM with CRF transitions, trained in numpy (op 4).

Labelled spans come from fixed rules (email, ip, card, phone) over a bounded sample of documents, and from data of the
four kinds written in other ways (telephone numbers without "+", cards with dots, addresses with "(at)" or "[.]"),
placed into windows of the same sample; one task trains. Texts are read whole, in overlapping windows: each position
takes its emissions from the window in which it is farthest from an edge. Windows in which nothing beats "outside", however
they are entered and left, are done; the others are decoded together with their neighbours as one chain, so
transitions hold across every seam. The rules' own spans always stay; the model adds spans of each kind in forms
that the rules do not have, if the form of what it found fits the kind.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
HIDDEN, EMBED, LABELS, CLASSES = 8, 8, 5, 132
WINDOW, OVERLAP = 256, 32
SAMPLE_DOCS = 1500  # the documented bound of the training sample: documents least by a hash of their id
TRAIN_WINDOWS, TRAIN_LENGTH, BATCH, STEPS = 5000, 80, 64, 600
LANES = 512  # windows decoded together
LOT_CHARS = 1 << 21  # of texts tagged together
MARGIN = 0.7  # mean log-odds against "outside" that a span of the model's own needs

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGITS, _NUMBER = re.compile(r"[0-9]"), re.compile(r"[0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for k, ch in enumerate(reversed(digits)):
        d = ord(ch) - 48
        total += d if k % 2 == 0 else (d * 2 - 9 if d > 4 else d * 2)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the rules, sorted; per kind leftmost and non-overlapping, in time linear in the text."""
    out = []
    at = text.find("@")
    free = 0
    while at >= 0:
        start = at
        while start > free and _LOCAL.match(text[start - 1]):
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, 0, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    if not _DIGITS.search(text):
        return out
    for m in _IP.finditer(text):
        if all(int(p) <= 255 for p in (q.lstrip("0")[:4] or "0" for q in m[0].split("."))):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def spans_text(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def char_classes(text: str) -> np.ndarray:
    """ASCII characters are classes of their own; others are letters, digits, spaces or the rest."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    out = np.minimum(code, 127).astype(np.uint8)
    for k in np.flatnonzero(code > 126):
        c = chr(code[k])
        out[k] = 128 if c.isalpha() else 129 if c.isdigit() else 130 if c.isspace() else 131
    return out


# --- the network: gates i, f, o, g for both directions at once; parameters are a dictionary of arrays

def start_parameters(rng: np.random.Generator) -> dict[str, np.ndarray]:
    p = {"e": rng.normal(0, 0.5, (CLASSES, EMBED)), "x": rng.normal(0, 0.3, (2, EMBED, 4 * HIDDEN)), "c": np.zeros((2, 4 * HIDDEN)), "u": rng.normal(0, 0.3, (2, HIDDEN, 4 * HIDDEN)), "w": rng.normal(0, 0.3, (2 * HIDDEN, LABELS)), "b": np.zeros(LABELS), "t": np.zeros((LABELS, LABELS))}
    p["c"][:, HIDDEN : 2 * HIDDEN] = 1.0
    p["b"][0] = 2.0
    return {k: v.astype(np.float32) for k, v in p.items()}


def run_lstm(p: dict[str, np.ndarray], c: np.ndarray):
    """For training. c: (T, N) classes, time first. Hidden states (2, T, N, H), the second direction in reversed
    time, and what each step needs for its gradient."""
    T, N = c.shape
    h, cell = np.zeros((2, N, HIDDEN), np.float32), np.zeros((2, N, HIDDEN), np.float32)
    hs = np.empty((2, T, N, HIDDEN), np.float32)
    saved = []
    table = p["e"] @ p["x"] + p["c"][:, None, :]
    for t in range(T):
        g = h @ p["u"]
        g[0] += table[0][c[t]]
        g[1] += table[1][c[T - 1 - t]]
        s = 0.5 + 0.5 * np.tanh(0.5 * g[:, :, : 3 * HIDDEN])
        z = np.tanh(g[:, :, 3 * HIDDEN :])
        i, f, o = s[:, :, :HIDDEN], s[:, :, HIDDEN : 2 * HIDDEN], s[:, :, 2 * HIDDEN :]
        before = cell
        cell = f * cell + i * z
        th = np.tanh(cell)
        h = hs[:, t] = o * th
        saved.append((i, f, o, z, before, th))
    return hs, saved


def fast_emissions(p: dict[str, np.ndarray], c: np.ndarray) -> np.ndarray:
    """For decoding. c: (T, N); emissions (T, LABELS, N). Both directions share each step: one product, one exponential.

    Windows lie along the last axis, so each operation runs over long contiguous rows. A sigmoid is 1 / (1 + exp(-z)) and
    tanh(z) = 2 sigmoid(2 z) - 1, with these factors folded into the weights (exp is half as dear as tanh); the cell is
    kept as -2 times its value. All emissions are one product at the end.
    """
    T, N = c.shape
    H, E = HIDDEN, EMBED
    m = np.zeros((8 * H, 2 * H + 2 * E + 1), np.float32)
    for d in range(2):
        for gate in range(4):
            rows, cols = slice(gate * 2 * H + d * H, gate * 2 * H + d * H + H), slice(gate * H, gate * H + H)
            m[rows, d * H : d * H + H] = p["u"][d][:, cols].T
            m[rows, 2 * H + d * E : 2 * H + d * E + E] = p["x"][d][:, cols].T
            m[rows, -1] = p["c"][d][cols]
    m[: 6 * H] *= -1
    m[6 * H :] *= -2
    state = np.zeros((2 * H + 2 * E + 1, N), np.float32)
    state[-1] = 1
    emb = np.ascontiguousarray(p["e"].T)
    cell, th, g = np.zeros((2 * H, N), np.float32), np.empty((2 * H, N), np.float32), np.empty((8 * H, N), np.float32)
    i, f, o, z = (g[k * 2 * H : (k + 1) * 2 * H] for k in range(4))
    hs = np.empty((2 * H, T, N), np.float32)
    one, two, four = np.float32(1), np.float32(2), np.float32(4)
    with np.errstate(over="ignore"):  # exp of a far negative gate is inf, its sigmoid 0
        for t in range(T):
            state[2 * H : 2 * H + E] = emb.take(c[t], axis=1, mode="clip")
            state[2 * H + E : -1] = emb.take(c[T - 1 - t], axis=1, mode="clip")
            np.matmul(m, state, out=g)
            np.exp(g, out=g)
            g += one
            np.reciprocal(g, out=g)
            z *= -four
            z += two
            z *= i
            cell *= f
            cell += z
            np.exp(cell, out=th)
            th += one
            np.divide(two, th, out=th)
            th -= one
            np.multiply(o, th, out=state[: 2 * H])
            hs[:H, t] = state[:H]
            hs[H:, T - 1 - t] = state[H : 2 * H]
    e = np.ascontiguousarray(p["w"].T) @ hs.reshape(2 * H, T * N)
    e += p["b"][:, None]
    return e.reshape(LABELS, T, N).transpose(1, 0, 2)


def emissions(p: dict[str, np.ndarray], hs: np.ndarray) -> np.ndarray:
    return hs[0] @ p["w"][:HIDDEN] + hs[1][::-1] @ p["w"][HIDDEN:] + p["b"]


def _lse(a: np.ndarray, axis: int) -> np.ndarray:
    m = a.max(axis, keepdims=True)
    return (m + np.log(np.exp(a - m).sum(axis, keepdims=True))).squeeze(axis)


def crf_gradient(e: np.ndarray, trans: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Negative log-likelihood of the labels y (T, N), and its gradients by emissions and transitions."""
    T, N, K = e.shape
    a, b = np.empty_like(e), np.zeros_like(e)
    a[0] = e[0]
    for t in range(1, T):
        a[t] = e[t] + _lse(a[t - 1][:, :, None] + trans, 1)
    for t in range(T - 2, -1, -1):
        b[t] = _lse(trans + (e[t + 1] + b[t + 1])[:, None, :], 2)
    z = _lse(a[-1], 1)
    prob = np.exp(a + b - z[:, None])
    n = np.arange(N)
    gold = np.take_along_axis(e, y[:, :, None], 2).sum() + trans[y[:-1], y[1:]].sum()
    ge = prob.copy()
    np.add.at(ge, (np.arange(T)[:, None], n[None, :], y), -1)
    pair = np.exp(a[:-1, :, :, None] + trans + (e[1:] + b[1:])[:, :, None, :] - z[:, None, None]).sum((0, 1))
    np.add.at(pair, (y[:-1].ravel(), y[1:].ravel()), -1)
    return float(z.sum() - gold) / N, ge / N, pair / N


def gradient(p: dict[str, np.ndarray], c: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    T, N = c.shape
    hs, saved = run_lstm(p, c)
    loss, ge, gt = crf_gradient(emissions(p, hs), p["t"], y)
    both = np.concatenate([hs[0], hs[1][::-1]], 2)
    out = {k: np.zeros_like(v) for k, v in p.items()}
    out["w"] = np.einsum("tnh,tnk->hk", both, ge)
    out["b"], out["t"] = ge.sum((0, 1)), gt
    gh = ge @ p["w"].T
    table = np.zeros((2, CLASSES, 4 * HIDDEN), np.float32)
    dh = np.stack([gh[:, :, :HIDDEN], gh[::-1, :, HIDDEN:]])
    nh, nc = np.zeros((2, N, HIDDEN), np.float32), np.zeros((2, N, HIDDEN), np.float32)
    for t in range(T - 1, -1, -1):
        i, f, o, z, before, th = saved[t]
        h = dh[:, t] + nh
        dc = nc + h * o * (1 - th * th)
        d = np.concatenate([dc * z * i * (1 - i), dc * before * f * (1 - f), h * th * o * (1 - o), dc * i * (1 - z * z)], 2)
        nc = dc * f
        nh = d @ p["u"].transpose(0, 2, 1)
        if t:
            out["u"] += hs[:, t - 1].transpose(0, 2, 1) @ d
        np.add.at(table[0], c[t], d[0])
        np.add.at(table[1], c[T - 1 - t], d[1])
    out["x"] = p["e"].T @ table
    out["c"] = table.sum(1)
    out["e"] = (table @ p["x"].transpose(0, 2, 1)).sum(0)
    return loss, out


def fit(windows: np.ndarray, labels: np.ndarray, seed: int = 5, steps: int = STEPS) -> dict[str, np.ndarray]:
    """Adam over shuffled batches of labelled windows (n, TRAIN_LENGTH)."""
    rng = np.random.default_rng(seed)
    p = start_parameters(rng)
    m, v = ({k: np.zeros_like(a) for k, a in p.items()} for _ in range(2))
    for s in range(1, steps + 1):
        pick = rng.integers(0, len(windows), BATCH)
        _, g = gradient(p, windows[pick].T, labels[pick].T)
        norm = sum(float((a * a).sum()) for a in g.values()) ** 0.5
        rate = 0.03 * min(1.0, 3 * (1 - s / (steps + 1)))
        for k in p:
            d = g[k] * min(1, 5 / (norm + 1e-9))
            m[k] = 0.9 * m[k] + 0.1 * d
            v[k] = 0.99 * v[k] + 0.01 * d * d
            p[k] = (p[k] - rate * (m[k] / (1 - 0.9**s)) / (np.sqrt(v[k] / (1 - 0.99**s)) + 1e-7)).astype(np.float32)
    return p


def _written(rng: np.random.Generator) -> tuple[str, int]:
    """A made-up string and its label: personal data in usual forms, and look-alikes that are none."""
    d = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    a, b, c = str(rng.integers(200, 1000)), str(rng.integers(200, 1000)), d(4)
    kind = rng.integers(0, 28)
    if kind >= 24:
        kind -= 24
    if kind < 4:
        return [f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"00{rng.integers(1, 99)} {a} {b} {c}"][kind], 4
    if kind == 4:
        return f"+{rng.integers(1, 99)} {a} {b} {c}", 4
    if kind == 5:
        return f"+1 ({a}) {b}-{c}", 4
    if kind == 6:
        return ".".join(str(x) for x in rng.integers(0, 256, 4)), 2
    if kind == 7:
        s = "4" + d(14)
        s += next(str(k) for k in range(10) if luhn(s + str(k)))
        return [s, " ".join(s[j : j + 4] for j in range(0, 16, 4)), "-".join(s[j : j + 4] for j in range(0, 16, 4))][rng.integers(0, 3)], 3
    if kind == 8:
        w = "".join(rng.choice(list("abcdefghilmnoprst"), rng.integers(3, 9)))
        return f"{w}.{d(2)}@{w[:4]}{d(1)}.example.{rng.choice(['com', 'org', 'net'])}", 1
    if kind in (9, 10):
        long = rng.random() < 0.75
        s = str(rng.choice(["4", "5", "6011"] if long else ["34", "37"]))
        s += d((15 if long else 14) - len(s))
        s += next(str(k) for k in range(10) if luhn(s + str(k)))
        cuts = [0, 4, 8, 12, 16] if long else [0, 4, 10, 15]
        return [".", "_", "/", "  ", " - "][rng.integers(0, 5)].join(s[i:j] for i, j in zip(cuts[:-1], cuts[1:], strict=True)), 3
    if kind in (11, 12):
        w = lambda: "".join(rng.choice(list("abcdefghijklmnoprstuvwz"), rng.integers(2, 9)))
        at, dot = [(" (at) ", " (dot) "), (" [at] ", " [dot] "), ("(at)", "."), ("[at]", "."), (" AT ", " DOT "), ("(at)", "(dot)"), ("(at)", "."), (" at ", " dot ")][rng.integers(0, 8)]
        local = [f"{w()}.{d(2)}", w(), f"{w()}.{w()}", f"{w()}_{w()}", f"{w()}{d(2)}", f"{w()[0]}.{w()}", f"{w()}-{w()}"][rng.integers(0, 7)]
        return dot.join([f"{local}{at}{[w(), f'{w()}-{w()}', f'{w()}{d(1)}'][rng.integers(0, 3)]}", *[w()] * int(rng.random() < 0.2), str(rng.choice(["com", "org", "net", "de", "fr", "es", "info", "example"]))]), 1
    if kind in (13, 14):
        return ["[.]", "(.)", " . ", "[dot]"][rng.integers(0, 4)].join(str(x) for x in rng.integers(0, 256, 4)), 2
    w = "".join(rng.choice(list("abcdefghilmnoprst"), rng.integers(2, 7)))
    none = [f"{w} at {w[::-1]} in", f"at {w} (at {w[:3]})", f"dot the {w} at the", "(at) noon", "[dot]", f"{d(1)} . {d(1)} . {d(2)}", f"{d(4)}.{d(4)}", f"at {d(2)} dot {d(2)}", d(4), f"{d(2)}.{d(2)}", "".join(rng.choice(list("0123456789abcdef"), 40)), f"{d(4)}-{d(2)}-{d(2)}", f"{d(1)}.{d(1)}.{d(2)}", f"{d(3)},{d(3)},{d(3)}", "sk-" + "".join(rng.choice(list("0123456789abcdefABCDEF"), 24)), f"{d(2)}:{d(2)}:{d(2)}", f"{d(8)}", f"v{d(1)}.{d(2)} ({d(4)})", f"| {d(3)} | {d(4)} | {d(2)} |"]
    return none[rng.integers(0, len(none))], 0


def labelled_windows(texts: list[str], seed: int = 5, n: int = TRAIN_WINDOWS, length: int = TRAIN_LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Windows of the sample: around the rules' spans, around made-up strings put into them, and anywhere."""
    rng = np.random.default_rng(seed)
    X, Y = np.zeros((n, length), np.uint8), np.zeros((n, length), np.int64)
    texts = [t for t in texts if t.strip()] or [" "]
    spans = [(k, s) for k, t in enumerate(texts) for s in base_spans(t)]
    for r in range(n):
        if spans and r % 3 == 0:
            k, (at, _, end) = spans[rng.integers(0, len(spans))]
            t, made = texts[k], []
        else:
            k = rng.integers(0, len(texts))
            t, made, at, end = texts[k], [], 0, 0
            at = end = int(rng.integers(0, len(t)))
            if r % 3 == 1:
                s, y = _written(rng)
                t = f"{t[:at]} {s} {t[at:]}"
                made, at, end = [(at + 1, y, at + 1 + len(s))], at + 1, at + 1 + len(s)
        left = max(0, int(rng.integers(min(end - length, at), max(end - length, at) + 1)))
        part = t[left : left + length]
        X[r, : len(part)] = char_classes(part)
        y = np.zeros(len(t) - left + 1, np.int64)
        for s, kind, e in base_spans(t[max(0, left - 200) : left + length + 200]):
            off = max(0, left - 200) - left
            y[max(0, s + off) : max(0, e + off)] = kind + 1
        for s, kind, e in made:
            if kind:
                y[max(0, s - left) : max(0, e - left)] = kind
        Y[r, : len(part)] = y[: len(part)]
    return X, Y


def quiet(e: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Which windows (last axis of (T, K, N) emissions) have nothing better than "outside" at any place, though each
    may be entered and left inside any kind at no cost."""
    inside, enter, leave = trans.diagonal()[1:, None], trans[0, 1:, None], trans[1:, 0, None]
    # if no place favours a kind by more than its transitions cost, no path does; the others are walked through
    most = (e[:, 1:] - e[:, :1]).max(0)
    limit = np.minimum(0, trans[0, 0] - leave) - 1e-3
    calm = ((most <= limit) & (most + np.maximum(enter, limit + inside) - trans[0, 0] <= limit)).all(0)
    rest = np.flatnonzero(~calm)
    e = e[:, :, rest]
    v = e[0].copy()
    other = np.zeros(len(rest), bool)
    for t in range(1, len(e)):
        out = v[0] + trans[0, 0]
        back = (v[1:] + leave).max(0)
        other |= back > out
        v[1:] = np.maximum(v[0] + enter, v[1:] + inside)
        np.maximum(out, back, out=v[0])
        v += e[t]
    calm[rest] = ~(other | (v.argmax(0) > 0))
    return calm


def viterbi(e: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Best labels (T, N) for emissions (T, K, N); a kind is entered from and left to "outside" only."""
    T, K, N = e.shape
    inside, enter, leave = trans.diagonal()[1:, None], trans[0, 1:, None], trans[1:, 0, None]
    n = np.arange(N)
    v, ways = e[0].copy(), np.empty((T, K, N), np.int8)
    for t in range(1, T):
        back = np.concatenate([v[:1] + trans[0, 0], v[1:] + leave])
        stay = v[1:] + inside > v[0] + enter
        ways[t, 0] = back.argmax(0)
        ways[t, 1:] = np.where(stay, np.arange(1, K, dtype=np.int8)[:, None], 0)
        v[1:] = np.maximum(v[0] + enter, v[1:] + inside)
        v[0] = back.max(0)
        v += e[t]
    lab = np.empty((T, N), np.int8)
    lab[-1] = v.argmax(0)
    for t in range(T - 1, 0, -1):
        lab[t - 1] = ways[t, lab[t], n]
    return lab


_WIDTHS = [1, 2, *(3 << k for k in range(40))]  # chains of about one length are decoded together


def tag_texts(p: dict[str, np.ndarray], texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per text: labels of all its positions, and each position's emission of its label over that of "outside".

    Windows of all texts get their emissions together by length. Of each text, the runs of windows that are not quiet
    are decoded with a quiet one on both sides, as one chain; should a chain end inside a kind, it goes on further.
    """
    core = WINDOW - OVERLAP
    coded = [char_classes(t) for t in texts]
    out = [(np.zeros(len(c), np.int8), np.zeros(len(c), np.float32)) for c in coded]
    jobs: dict[int, list[tuple[int, int]]] = {}
    for k, c in enumerate(coded):
        for w in range(max(1, -(-(len(c) - OVERLAP) // core)) if len(c) else 0):
            jobs.setdefault(-(-min(WINDOW, len(c) - w * core) // 32) * 32, []).append((k, w))
    where: dict[tuple[int, int], tuple[np.ndarray, int]] = {}  # of a window: its lot's emissions and its lane
    loud: dict[int, list[int]] = {}
    for T, todo in jobs.items():
        for lot in range(0, len(todo), LANES):
            part = todo[lot : lot + LANES]
            x = np.zeros((T, len(part)), np.uint8)
            for j, (k, w) in enumerate(part):
                s = coded[k][w * core : w * core + T]
                x[: len(s), j] = s
            e = fast_emissions(p, x)
            found = np.flatnonzero(~quiet(e, p["t"]))
            for j in found:
                loud.setdefault(part[j][0], []).append(part[j][1])
            keep = np.unique(np.concatenate([found - 1, found, found + 1, [0, len(part) - 1]]))  # the others are made again if need be
            keep = keep[(keep >= 0) & (keep < len(part))]
            kept = e[:, :, keep]
            for n, j in enumerate(keep):
                where[part[j]] = kept, n
    chains = []  # text, first window, window after the last
    for k, ws in loud.items():
        last = max(1, -(-(len(coded[k]) - OVERLAP) // core))
        for w in sorted(ws):
            if chains and chains[-1][0] == k and w - 1 <= chains[-1][2]:
                chains[-1][2] = min(last, w + 2)
            else:
                chains.append([k, max(0, w - 1), min(last, w + 2)])

    def emissions_of(k: int, w: int) -> tuple[np.ndarray, int]:
        if (k, w) not in where:
            part = coded[k][w * core : w * core + WINDOW]
            x = np.zeros((-(-len(part) // 32) * 32, 1), np.uint8)
            x[: len(part), 0] = part
            where[k, w] = fast_emissions(p, x), 0
        return where[k, w]

    def place(k: int, w: int) -> int:
        """Where window w's own positions begin."""
        n = len(coded[k])
        return 0 if w == 0 else min(n, w * core + OVERLAP // 2) if w < max(1, -(-(n - OVERLAP) // core)) else n

    while chains:
        groups: dict[int, list[list[int]]] = {}
        for c in chains:
            groups.setdefault(next(n for n in _WIDTHS if n >= c[2] - c[1]), []).append(c)
        chains = []
        for every in groups.values():
            for lot in range(0, len(every), LANES):
                part = every[lot : lot + LANES]
                rows = []
                for k, a, b in part:
                    of = [(emissions_of(k, w), place(k, w) - w * core, place(k, w + 1) - w * core) for w in range(a, b)]
                    rows.append(np.concatenate([e[lo:hi, :, j] for (e, j), lo, hi in of]))
                e = np.zeros((max(map(len, rows)), LABELS, len(rows)), np.float32)
                e[:, 1:] = -1e4
                for j, r in enumerate(rows):
                    e[: len(r), :, j] = r
                y = viterbi(e, p["t"])
                for j, (k, a, b) in enumerate(part):
                    n, at = len(rows[j]), place(k, a)
                    lab = y[:n, j]
                    if lab[-1] and at + n < len(coded[k]):
                        chains.append([k, a, b + 1])
                    out[k][0][at : at + n] = lab
                    out[k][1][at : at + n] = rows[j][np.arange(n), lab] - rows[j][:, 0]
    return out


_DOT, _AT = r" ?(?:\.|\[\.\]|\(\.\)|\(dot\)|\[dot\]|\{dot\}| DOT ) ?", r" ?(?:@|\(at\)|\[at\]|\{at\}| AT ) ?"
#: What a span of the model's own must look like, by kind; telephone numbers are cut out of what was tagged instead.
_FORMS = (
    re.compile(rf"[A-Za-z0-9._%+-]+{_AT}[A-Za-z0-9-]+(?:{_DOT}[A-Za-z0-9-]+)+|[A-Za-z0-9_%+-]+(?: dot [A-Za-z0-9_%+-]+)* at [A-Za-z0-9-]+(?: dot [A-Za-z0-9-]+)+"),
    re.compile(rf"(?<![0-9])[0-9]{{1,3}}(?:{_DOT}[0-9]{{1,3}}){{3}}(?![0-9])"),
    re.compile(r"(?<![0-9])(?<![0-9][ ._/-])[0-9](?:[ ._/-]{0,3}[0-9]){11,18}(?![ ._/-]?[0-9])"),
)


def added_spans(text: str, labels: np.ndarray, margin: np.ndarray, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The model's spans with a sure margin and the form of their kind, that no rule's span and no other touches."""
    out: list[tuple[int, int, int]] = []
    edge = np.flatnonzero(np.diff(labels, prepend=0, append=0))
    for s, e in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
        kind = int(labels[s]) - 1
        if kind < 0 or margin[s:e].mean() < MARGIN:
            continue
        if kind < 3:  # the form says where the span begins and ends, if the tag covers most of it
            found = [(m.start(), m.end()) for m in _FORMS[kind].finditer(text, max(0, s - 40), min(len(text), e + 40)) if 2 * (min(e, m.end()) - max(s, m.start())) > m.end() - m.start()]
            if kind == 1:
                found = [(a, b) for a, b in found if all(int(q) <= 255 for q in _NUMBER.findall(text[a:b]))]
            if kind == 2:
                found = [(a, b) for a, b in found if luhn("".join(_NUMBER.findall(text[a:b])))]
        else:
            while s < e and not (text[s].isascii() and text[s].isdigit() or text[s] in "+("):
                s += 1
            while e > s and not (text[e - 1].isascii() and text[e - 1].isdigit()):
                e -= 1
            got = text[s:e]
            fine = 9 <= sum("0" <= c <= "9" for c in got) <= 15 and all(c in "+().- /" or "0" <= c <= "9" for c in got)
            found = [(s, e)] if fine and not (s and text[s - 1].isalnum()) and not (e < len(text) and text[e].isalnum()) else []
        for a, b in found:
            if not any(bs < b and a < be for bs, _, be in base) and not any(bs < b and a < be for bs, _, be in out):
                out.append((a, kind, b))
    return out


def _lots(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Runs of texts that are tagged together: ``LOT_CHARS`` at most, or one text."""
    lo = size = 0
    for k, t in enumerate(texts):
        if k > lo and size + len(t) > LOT_CHARS:
            yield lo, k
            lo, size = k, 0
        size += len(t)
    if texts:
        yield lo, len(texts)


def find_spans(p: dict[str, np.ndarray], texts: list[str]) -> list[tuple[list, list]]:
    """Per text: the rules' spans, and all spans (the rules' and the model's) sorted. Equal texts are read once."""
    found = {}
    once = list(dict.fromkeys(texts))
    for t, (labels, margin) in zip(once, tag_texts(p, once), strict=True):
        base = base_spans(t)
        more = added_spans(t, labels, margin, base) if labels.any() else []
        found[t] = base, sorted(base + more)
    return [found[t] for t in texts]


def _trained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The parameters of the model of texts (id, t), as bytes by name."""
    t = pa.Table.from_batches(batches, pa.schema([("id", pa.string()), ("t", pa.string())])).sort_by("id")
    p = fit(*labelled_windows(t.column("t").to_pylist()))
    yield pa.RecordBatch.from_arrays([pa.array(list(p)), pa.array([list(v.shape) for v in p.values()], pa.list_(pa.int64())), pa.array([v.astype(np.float32).tobytes() for v in p.values()], pa.binary())], ["name", "shape", "raw"])


def train_model(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> dict[str, np.ndarray]:
    """Train, in one task, on the ``SAMPLE_DOCS`` documents least by a hash of their id (of an id's rows, the least text).
    An empty table gives the parameters that training starts from."""
    known = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_t"))
    ids = known.select("_id").distinct().orderBy(F.xxhash64(F.col("_id").cast("string"), F.lit(29)), "_id").limit(SAMPLE_DOCS)
    rows = known.join(F.broadcast(ids), "_id").groupBy("_id").agg(F.min("_t").alias("t")).selectExpr("cast(_id as string) as id", "t")
    got = rows.repartition(1).mapInArrow(_trained, "name string, shape array<long>, raw binary").collect()
    return {r.name: np.frombuffer(r.raw, np.float32).reshape(r.shape) for r in got} or start_parameters(np.random.default_rng(5))


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, counts of the rules' spans per kind, ``base_sha256``, ``spans``, ``n_added``.

    Null and empty texts have no spans. Repeated rows give repeated results; an empty table gives none; extra
    columns are ignored.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(train_model(docs, id_col, text_col))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            for lo, hi in _lots(texts):
                part = b.slice(lo, hi - lo)
                got = find_spans(p, texts[lo:hi])
                cols = [pa.array([sum(s[1] == k for s in base) for base, _ in got], pa.int64()) for k in range(4)]
                cols += [pa.array([hashlib.sha256(spans_text(base).encode()).hexdigest() for base, _ in got]), pa.array([spans_text(every) for _, every in got], pa.string()), pa.array([len(every) - len(base) for base, every in got], pa.int64())]
                yield pa.RecordBatch.from_arrays([part.column(0), *cols], [id_col, "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"])

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"`{id_col}` {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")


def mask_text(text: str, spans: list[tuple[int, int, int]]) -> str:
    """Each span becomes its kind in brackets; overlapping spans become one, named by the first."""
    out, at = [], 0
    for s, k, e in spans:
        if s >= at:
            out += [text[at:s], f"[{KINDS[k].upper()}]"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def mask(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows and columns of ``docs`` with personal data in ``text_col`` replaced by its kind; null texts stay null."""
    shared = docs.sparkSession.sparkContext.broadcast(train_model(docs, id_col, text_col))
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        for b in batches:
            whole = b.column(at).to_pylist()
            for lo, hi in _lots([t or "" for t in whole]):
                part, texts = b.slice(lo, hi - lo), whole[lo:hi]
                found = find_spans(p, [t or "" for t in texts])
                cols = part.columns
                cols[at] = pa.array([None if t is None else mask_text(t, s) for t, (_, s) in zip(texts, found, strict=True)], part.column(at).type)
                yield pa.RecordBatch.from_arrays(cols, part.schema.names)

    return docs.mapInArrow(run, docs.schema)
