"""SentencePiece encoding and decoding: Gumbel top-k segmentations without replacement (op 10).

A text's segmentations into pieces of an existing vocabulary are paths of a lattice; a path's probability is the
normalised product of its pieces' weights. Adding Gumbel noise to the log-probabilities and taking the k largest gives
k distinct samples without replacement. The search is A* over regions of the lattice: the largest perturbed value of
a *whole region* has a Gumbel distribution at the region's log-mass, so it serves as an exact bound; the region with the
largest is opened, its path drawn, and what is left of it is split into one region for each piece of the path ("the
same pieces up to here, then another"), with values truncated at the path's own. No path is ever listed.

Two neighbouring characters that stand side by side in no piece part the lattice: it is a chain of *units* between
such places. Tables of distinct units are kept by the worker. All texts of a lot are walked together. Random numbers come from a
hash of row key, sample and place, so a row's samples depend on nothing else.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from math import exp

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lm_scoring import default_vocabulary

LOT_CHARS = 1 << 19
UNITS_KEPT = 200_000
LONGEST_UNIT = 40  # longer units, and those with characters outside the vocabulary, are tabled one by one, with rescaling
LEAST_REST = float(np.log(1e-12))  # a place with less left than this is not opened
MARK = "▁"
_STATE: dict = {}


class Lattices:
    """Transition tables of all units met so far: nodes with runs of arcs (next node or -1, piece, weight, chance)."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        plain = [k for k in range(n) if not (sp.is_control(k) or sp.is_unknown(k) or sp.is_byte(k) or sp.is_unused(k))]
        # The vocabulary's own scores are ranks (merge order); a piece's weight falls with its rank as in Zipf's law.
        rank = {k: min(-sp.get_score(k), float(n)) + 10.0 for k in plain}
        total = sum(1 / r for r in rank.values()) + 256 / (n + 10.0)
        self.piece = {sp.id_to_piece(k): (k, 1 / rank[k] / total) for k in plain}
        self.byte_weight = 1 / (n + 10.0) / total
        self.byte = [0] * 256
        for k in range(n):
            if sp.is_byte(k):
                self.byte[int(sp.id_to_piece(k)[1:-1], 16)] = k
        self.heads = {p[:j]: None for p in self.piece for j in range(1, len(p) + 1)} | self.piece  # a head of a piece; its id and weight if it is one
        self.single = {p for p in self.piece if len(p) == 1}
        number = {h: k for k, h in enumerate(["", *sorted(self.heads)])}
        edges = sorted((number[h[:-1]] << 21 | ord(h[-1]), number[h]) for h in self.heads)
        self.trie_key, self.trie_next = np.array([e[0] for e in edges], np.int64), np.array([e[1] for e in edges], np.int64)
        self.trie_piece, self.trie_weight = np.full(len(number), -1, np.int64), np.zeros(len(number))
        for p, (k, w) in self.piece.items():
            self.trie_piece[number[p]], self.trie_weight[number[p]] = k, w
        pairs = {(a, b) for p in self.piece for a, b in zip(p, p[1:], strict=False)}
        chars = sorted({ord(c) for pair in pairs for c in pair})
        self.group = np.zeros(max(chars) + 2, np.int32)  # 0: stands beside no other character in any piece
        self.group[chars] = np.arange(1, len(chars) + 1)
        self.beside = np.zeros((len(chars) + 1, len(chars) + 1), bool)
        for a, b in pairs:
            self.beside[self.group[ord(a)], self.group[ord(b)]] = True
        self.weight = np.full(n, np.log(self.byte_weight))
        for k in plain:
            self.weight[k] = np.log(1 / rank[k] / total)
        raw = [sp.id_to_piece(k).replace(MARK, " ").encode() if k in rank else b"" for k in range(n)]
        for b, k in enumerate(self.byte):
            raw[k] = bytes([b])
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        self.raw_len = np.array([len(r) for r in raw])
        self.raw_at = np.concatenate([[0], np.cumsum(self.raw_len)[:-1]])
        self.clear()

    def clear(self) -> None:
        self.units: dict[str, int] = {}
        self.n_nodes = self.n_arcs = self.n_logged = 0
        self.logged = (np.zeros(1 << 18), np.zeros(1 << 18), np.zeros(1 << 18, bool))
        self.first: list[int] = []  # of nodes not in the arrays yet: the first arc
        self.arcs: list[tuple[int, int, float, int]] = []  # next node or -1, piece, chance, own node
        self.store = {"first": np.zeros(1 << 16, np.int64), "next": np.zeros(1 << 18, np.int32), "piece": np.zeros(1 << 18, np.int32), "chance": np.zeros(1 << 18), "node": np.zeros(1 << 18, np.int32)}

    def split(self, text: str) -> list[str]:
        """Units of a text: cut where two characters are side by side in no piece."""
        code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        g = self.group[np.minimum(code, len(self.group) - 1)]
        cuts = (np.flatnonzero(~self.beside[g[:-1], g[1:]]) + 1).tolist()
        return [text[a:b] for a, b in zip([0, *cuts], [*cuts, len(text)], strict=True)]

    def roots(self, units: list[list[str]]) -> np.ndarray:
        """The first node of each unit, texts one after another; tables of new units are made together."""
        new: set[str] = set()
        new.update(*units)
        new = new.difference(self.units)
        common, odd = [], []
        for u in sorted(new):  # the way a unit is taken depends on the unit alone
            (common if len(u) <= LONGEST_UNIT and self.single.issuperset(u) else odd).append(u)
        for u in odd:
            self.units[u] = self._add(u)
        if common:
            self.tables()
            self._add_together(common)
        get = self.units.__getitem__
        return np.array([get(u) for text in units for u in text], np.int64)

    def _add_together(self, units: list[str]) -> None:
        """Tables of many units by array operations: pieces by a walk down the trie from all places at once, masses
        from the units' ends backwards."""
        lens = np.array([len(u) for u in units])
        begin = np.concatenate([[0], np.cumsum(lens)])
        code = np.frombuffer("".join(units).encode("utf-32-le"), np.uint32).astype(np.int64)
        n = len(code)
        end = np.repeat(begin[1:], lens)
        pos, state = np.arange(n), np.zeros(n, np.int64)
        got: list[tuple[np.ndarray, ...]] = []
        depth = 0
        while len(pos):
            inside = pos + depth < end[pos]
            pos, state = pos[inside], state[inside]
            key = state << 21 | code[pos + depth]
            k = np.minimum(np.searchsorted(self.trie_key, key), len(self.trie_key) - 1)
            ok = self.trie_key[k] == key
            pos, state = pos[ok], self.trie_next[k[ok]]
            depth += 1
            has = self.trie_piece[state] >= 0
            got.append((pos[has], np.full(int(has.sum()), depth), state[has]))
        src, size, node = (np.concatenate(c) for c in zip(*got, strict=True))
        far = end[src] - src  # places to the unit's end
        order = np.lexsort((src, far))
        src, dst, node, far = src[order], (src + size)[order], node[order], far[order]
        w, last = self.trie_weight[node], dst == end[src]
        beta, mass = np.zeros(n + 1), np.empty(len(src))
        cuts = np.searchsorted(far, np.arange(1, int(far[-1]) + 2))
        for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            m = mass[x:y] = w[x:y] * np.where(last[x:y], 1.0, beta[dst[x:y]])
            at = np.flatnonzero(np.concatenate([[True], src[x + 1 : y] != src[x : y - 1]]))
            beta[src[x:y][at]] = np.add.reduceat(m, at)
        chance = mass / beta[src]
        order = np.lexsort((dst, -chance, src))
        src, dst, node, chance, last = src[order], dst[order], node[order], chance[order], last[order]
        st, base, m0 = self.store, self.n_nodes, self.n_arcs
        m1 = m0 + len(src)
        while base + n + 1 > len(st["first"]):
            st["first"] = np.concatenate([st["first"], np.zeros_like(st["first"])])
        while m1 > len(st["next"]):
            for k in ("next", "piece", "chance", "node"):
                st[k] = np.concatenate([st[k], np.zeros_like(st[k])])
        st["first"][base : base + n + 1] = m0 + np.searchsorted(src, np.arange(n + 1))
        st["next"][m0:m1] = np.where(last, -1, base + dst)
        st["piece"][m0:m1] = self.trie_piece[node]
        st["chance"][m0:m1] = chance
        st["node"][m0:m1] = base + src
        self.n_nodes, self.n_arcs = base + n, m1
        for u, x in zip(units, begin[:-1].tolist(), strict=True):
            self.units[u] = base + x

    def _add(self, s: str) -> int:
        n = len(s)
        heads, none = self.heads.get, 0
        out: list[list] = [[] for _ in range(n)]
        beta = [0.0] * n + [1.0]
        scale = 1.0
        for i in range(n - 1, -1, -1):
            here = out[i]
            total = 0.0
            j = i + 1
            while j <= n:
                got = heads(s[i:j], none)
                if got is none:
                    break
                if got is not None:
                    w = got[1] * beta[j]
                    total += w
                    here.append((j, got[0], got[1], w))
                j += 1
            if not here or here[0][0] != i + 1:  # a character outside the vocabulary: its bytes
                code = s[i].encode("utf-8", "surrogatepass")
                w = self.byte_weight ** len(code)
                here.append((i + 1, -len(code), w, w * beta[i + 1]))
                total += w * beta[i + 1]
            beta[i] = total
            if total < 1e-200:  # very long units: rescale the part that later nodes can still reach
                for j in range(i, min(n, i + 20) + 1):
                    beta[j] *= 1e150
                scale *= 1e150
        base = self.n_nodes
        self.n_nodes += n
        chains: list[tuple[int, int, int]] = []
        first, arcs = self.first, self.arcs
        for i in range(n):
            first.append(self.n_arcs + len(arcs))
            here = out[i]
            if len(here) > 1:
                here.sort(key=lambda a: -a[3])  # the likeliest first: draws mostly stop there
                total = sum(a[3] for a in here)
            else:
                total = here[0][3] or 1.0
            for j, k, _, m in here:
                nxt = base + j if j < n else -1
                if k < 0:
                    if k < -1:
                        chains.append((len(arcs), i, nxt))
                    k = self.byte[s[i].encode("utf-8", "surrogatepass")[0]]
                arcs.append((nxt, k, m / total, base + i))
        for at, i, nxt in chains:  # a character's other bytes follow one by one
            code = s[i].encode("utf-8", "surrogatepass")
            a = arcs[at]
            arcs[at] = (self.n_nodes, a[1], a[2], a[3])
            for k, b in enumerate(code[1:], 1):
                first.append(self.n_arcs + len(arcs))
                arcs.append((self.n_nodes + 1 if k < len(code) - 1 else nxt, self.byte[b], 1.0, self.n_nodes))
                self.n_nodes += 1
        return base

    def tables(self) -> tuple[np.ndarray, ...]:
        """Arrays: first arc by node (and the end), next node, piece, chance and own node by arc."""
        st = self.store
        if self.first:
            n, m = self.n_nodes, self.n_arcs + len(self.arcs)
            while n + 1 > len(st["first"]):
                st["first"] = np.concatenate([st["first"], np.zeros_like(st["first"])])
            while m > len(st["next"]):
                for k in ("next", "piece", "chance", "node"):
                    st[k] = np.concatenate([st[k], np.zeros_like(st[k])])
            st["first"][n - len(self.first) : n] = self.first
            st["first"][n] = m
            for k, col in zip(("next", "piece", "chance", "node"), zip(*self.arcs, strict=True), strict=True):
                st[k][self.n_arcs : m] = col
            self.n_arcs = m
            self.first, self.arcs = [], []
        return st["first"], st["next"], st["piece"], st["chance"], st["node"]


    def logs(self) -> tuple[np.ndarray, ...]:
        """By arc: log of its chance, log of the chance of the other arcs of its node, and whether there are others."""
        first, _, _, chance, node = self.tables()
        a, b = self.n_logged, self.n_arcs
        while b > len(self.logged[0]):
            self.logged = tuple(np.concatenate([x, np.zeros_like(x)]) for x in self.logged)
        logc, rest, several = self.logged
        if b > a:
            logc[a:b] = np.log(chance[a:b])
            rest[a:b] = np.log(np.maximum(1.0 - chance[a:b], 1e-300))
            several[a:b] = first[node[a:b] + 1] - first[node[a:b]] > 1
            self.n_logged = b
        return self.logged


def _lattices(path: str) -> Lattices:
    if _STATE.get("path") != path:
        _STATE.update(path=path, tables=Lattices(path))
    if len(_STATE["tables"].units) > UNITS_KEPT:
        _STATE["tables"].clear()
    return _STATE["tables"]


def _uniform(key: np.ndarray, stream: int, at: np.ndarray) -> np.ndarray:
    """Uniform numbers in (0, 1) from row key, stream and place."""
    with np.errstate(over="ignore"):
        z = key + np.uint64(0x9E3779B97F4A7C15) * (at.astype(np.uint64) * np.uint64(64) + np.uint64(stream + 1))
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z ^= z >> np.uint64(31)
    return ((z >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def _walk(lat: Lattices, node: np.ndarray, key: np.ndarray, at: np.ndarray, stream: int, banned: list[set[int]] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Draw a path to the unit's end from each node: (counts, arcs), arcs in order of lane and step. ``banned``: arcs
    that a lane's first step may not take."""
    first, nxt, _, chance, _ = lat.tables()
    lanes = np.arange(len(node))
    node = node.copy()
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    step = 0
    while len(lanes):
        u = _uniform(key[lanes], stream, at[lanes] + step)
        lo, hi = first[node], first[node + 1]
        arc = lo.copy()
        if banned is not None and step == 0:
            for k in range(len(lanes)):
                ok = [a for a in range(lo[k], hi[k]) if a not in banned[k]]
                c = np.cumsum(chance[ok])
                arc[k] = ok[min(int(np.searchsorted(c, u[k] * c[-1])), len(ok) - 1)]
        else:
            acc = chance[arc]
            go = np.flatnonzero((acc < u) & (arc + 1 < hi))
            while len(go):
                arc[go] += 1
                acc[go] += chance[arc[go]]
                go = go[(acc[go] < u[go]) & (arc[go] + 1 < hi[go])]
        steps.append((lanes, arc))
        node = nxt[arc]
        live = node >= 0
        lanes, node = lanes[live], node[live]
        step += 1
    counts = np.zeros(len(at), np.int64)
    for ln, _ in steps:
        counts[ln] += 1
    begin = np.concatenate([[0], np.cumsum(counts)])
    arcs = np.empty(begin[-1], np.int64)
    for k, (ln, a) in enumerate(steps):
        arcs[begin[ln] + k] = a
    return counts, arcs


def _gumbel(u: np.ndarray) -> np.ndarray:
    return -np.log(-np.log(u))


def sample_texts(lat: Lattices, texts: list[str], keys: np.ndarray, k: int) -> list[list[dict]]:
    """Per text, its first k samples by perturbed value (fewer if it has fewer segmentations)."""
    norm = [MARK + t.replace(" ", MARK) if t else "" for t in texts]
    units = [lat.split(t) if t else [] for t in norm]
    n_units = np.array([len(u) for u in units])
    roots = lat.roots(units)
    lens = np.array([len(x) for u in units for x in u], np.int64)
    _, _, piece, chance, node_of = lat.tables()
    log_chance, log_rest, several = lat.logs()
    doc = np.repeat(np.arange(len(texts)), n_units)
    ubegin = np.concatenate([[0], np.cumsum(n_units)])
    cum = np.concatenate([[0], np.cumsum(lens)])
    at = cum[:-1] - cum[ubegin[:-1]][doc] + 1 if len(lens) else lens  # place of a unit's start in its text, from 1
    lane_key = keys[doc] if len(doc) else np.empty(0, np.uint64)
    out: list[list[dict]] = [[] for _ in texts]
    live = np.flatnonzero(n_units > 0)
    for d in np.flatnonzero(n_units == 0):  # an empty text has one segmentation, of no pieces
        out[d].append({"ids": np.empty(0, np.int64), "log_prob": 0.0, "value": float(_gumbel(_uniform(keys[d : d + 1], 60, np.zeros(1)))[0]), "inclusion": 1.0})
    paths: list[dict] = []  # per sample: all texts' pieces, flat
    values = np.full((k + 1, len(texts)), -np.inf)
    values[0] = _gumbel(_uniform(keys, 60, np.zeros(len(texts))))
    src, pos = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
    for s in range(k):
        lanes = np.arange(len(roots))
        if s:  # only what follows the opened place is drawn anew
            opened = np.full(len(texts), len(roots))
            for d in live:
                p = paths[src[d]]
                opened[d] = p["unit"][p["begin"][d] + pos[d]]
            lanes = np.flatnonzero(lanes > opened[doc])
        counts = np.zeros(len(roots), np.int64)
        counts[lanes], arcs = _walk(lat, roots[lanes], lane_key[lanes], at[lanes], s)
        banned: dict[int, set[int]] = {}
        per = np.bincount(doc, counts, len(texts)).astype(np.int64) if len(doc) else np.zeros(len(texts), np.int64)
        if s:  # the opened region's path: its first pieces, another piece, then the rest drawn anew
            parts, units_of, at_opened = [], [], []
            fresh = np.concatenate([[0], np.cumsum(counts)])
            for d in live.tolist():
                p, i = paths[src[d]], pos[d]
                a = p["begin"][d]
                at_opened.append((a + i, p["unit"][a + i]))
                banned[d] = {int(p["arcs"][a + i])} | (p["banned"].get(d, set()) if p["start"][d] == i else set())
            spots, of_unit = np.array([x for x, _ in at_opened], np.int64), np.array([x for _, x in at_opened], np.int64)
            leaving = np.array([paths[src[d]]["arcs"][x] for d, x in zip(live.tolist(), spots.tolist(), strict=True)], np.int64)
            inside = np.array([pos[d] - np.searchsorted(paths[src[d]]["unit"][paths[src[d]]["begin"][d] : paths[src[d]]["begin"][d + 1]], x) for d, x in zip(live.tolist(), of_unit.tolist(), strict=True)], np.int64)
            mids, mid_arcs = _walk(lat, node_of[leaving].astype(np.int64), keys[live], at[of_unit] + inside, s + 20, [banned[d] for d in live.tolist()])
            mid_at = np.concatenate([[0], np.cumsum(mids)])
            for n, d in enumerate(live.tolist()):
                p, unit = paths[src[d]], of_unit[n]
                a = p["begin"][d]
                parts += [p["arcs"][a : spots[n]], mid_arcs[mid_at[n] : mid_at[n + 1]], arcs[fresh[unit + 1] : fresh[ubegin[d + 1]]]]
                units_of += [p["unit"][a : spots[n]], np.full(mids[n], unit), np.repeat(np.arange(unit + 1, ubegin[d + 1]), counts[unit + 1 : ubegin[d + 1]])]
            per = np.zeros(len(texts), np.int64)
            per[live] = np.array([len(x) for x in parts], np.int64).reshape(-1, 3).sum(1)
            arcs = np.concatenate(parts) if parts else np.empty(0, np.int64)
            unit = np.concatenate(units_of) if parts else np.empty(0, np.int64)
        else:
            unit = np.repeat(np.arange(len(roots)), counts)
        begin = np.concatenate([[0], np.cumsum(per)])
        of = np.repeat(np.arange(len(texts)), per)
        logc = log_chance[arcs]
        c = np.empty(len(arcs))
        for a, b in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True):  # text by text: a row's sums depend on nothing else
            np.cumsum(logc[a:b], out=c[a:b])
        start = pos.copy() if s else np.zeros(len(texts), np.int64)
        place = np.arange(len(arcs)) - begin[:-1][of]
        rest = log_rest[arcs]
        for d, ban in banned.items():  # at the place where it left its parent, more arcs are taken
            j = begin[d] + pos[d]
            rest[j] = np.log(max(1e-300, 1.0 - chance[arcs[j]] - sum(chance[a] for a in ban)))
        w = np.flatnonzero(several[arcs] & (rest > LEAST_REST) & (place >= start[of]))
        # Each place's Gumbel at the log-mass of what is left there. Values are truncated at the path's own when they
        # are compared with other paths'; that keeps their order within the path.
        g = np.full(len(arcs), -np.inf)
        g[w] = ((c[w] - logc[w]) + rest[w]) - np.log(-np.log(_uniform(keys[of[w]], 30 + s, place[w] + 1)))
        logp = np.bincount(of, logc, len(texts)) if len(arcs) else np.zeros(len(texts))
        ids = piece[arcs]
        paths.append({"arcs": arcs, "unit": unit, "begin": begin, "g": g, "banned": banned, "start": start})
        for d in live:
            out[d].append({"ids": ids[begin[d] : begin[d + 1]], "log_prob": float(logp[d]), "value": float(values[s][d])})
        best = np.full(len(texts), -np.inf)
        for t, p in enumerate(paths):
            full = np.flatnonzero(np.diff(p["begin"]) > 0)
            if not len(full):
                continue
            m = -np.logaddexp(-values[t][full], -np.maximum.reduceat(p["g"], p["begin"][full]))
            better = m > best[full]
            best[full[better]] = m[better]
            src[full[better]] = t
        for d in np.flatnonzero(best > -np.inf):
            p = paths[src[d]]
            a, b = p["begin"][d], p["begin"][d + 1]
            pos[d] = int(p["g"][a:b].argmax())
            if s + 1 < k:
                p["g"][a + pos[d]] = -np.inf
        values[s + 1] = best
        live = live[best[live] > -np.inf]
    for d, rows in enumerate(out):
        kappa = values[len(rows), d] if n_units[d] and len(rows) <= k else -np.inf
        for r in rows:  # chance to be among the k: the perturbed value passes the first one left out
            r["inclusion"] = 1.0 if kappa == -np.inf else float(-np.expm1(-exp(min(700.0, r["log_prob"] - kappa))))
    return out


def decode_all(lat: Lattices, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
    """UTF-8 of all pieces in a row, and where each piece begins and the last one ends."""
    n = lat.raw_len[ids]
    ends = np.concatenate([[0], np.cumsum(n)])
    if not len(ids):
        return b"", ends
    return lat.raw[np.repeat(lat.raw_at[ids] - ends[:-1], n) + np.arange(ends[-1])].tobytes(), ends


def decode_ids(lat: Lattices, ids: np.ndarray) -> bytes:
    """UTF-8 of a sequence of ids, without the space that encoding puts first."""
    return decode_all(lat, ids)[0][1:]


def sampled_encodings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3, vocabulary: str | None = None, keep_ids: bool = False) -> DataFrame:
    """Per row and sample: id, ``sample`` (from 0, by perturbed value), ``n_pieces``, ``ids_crc32``, ``log_prob``
    (natural, normalised over all segmentations), ``perturbed``, ``inclusion``, ``decoded_equal``; with ``keep_ids``
    also ``ids``.

    Samples of a row are distinct; a text with fewer than k segmentations has fewer rows. Null and empty texts have one
    sample without pieces. A null id is a key like others. Repeated rows give repeated results; an empty table gives
    none; extra columns are ignored. The space mark itself (U+2581) is read as a space, as the vocabulary has it.
    """
    path = vocabulary or default_vocabulary()
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            seeds = np.array([xxhash.xxh64_intdigest(str(i)) for i in b.column(0).to_pylist()], np.uint64)
            lo = 0
            while lo < len(texts):
                hi, size = lo, 0
                while hi < len(texts) and (hi == lo or size + len(texts[hi]) <= LOT_CHARS):
                    size += len(texts[hi])
                    hi += 1
                lat = _lattices(path)
                samples = [(d, s, r) for d, rows in enumerate(sample_texts(lat, texts[lo:hi], seeds[lo:hi], k)) for s, r in enumerate(rows)]
                row, want = [lo + d for d, _, _ in samples], [t.replace(MARK, " ").encode("utf-8", "surrogatepass") for t in texts[lo:hi]]
                ids = np.concatenate([r["ids"] for _, _, r in samples])  # all samples of the lot are decoded together
                raw, at = decode_all(lat, ids)
                words = memoryview(ids.astype("<u4").tobytes())
                edge = np.concatenate([[0], np.cumsum([len(r["ids"]) for _, _, r in samples])]).tolist()
                cols = [[s for _, s, _ in samples], [b - a for a, b in zip(edge, edge[1:], strict=False)], [zlib.crc32(words[4 * a : 4 * b]) for a, b in zip(edge, edge[1:], strict=False)],
                        *([r[name] for _, _, r in samples] for name in ("log_prob", "value", "inclusion")),
                        [raw[at[a] + (b > a) : at[b]] == want[d] for (d, _, _), a, b in zip(samples, edge, edge[1:], strict=False)], [r["ids"] for _, _, r in samples]]
                kinds = [pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.bool_()]
                arrays = [b.column(0).take(pa.array(row, pa.int32())), *(pa.array(c, t) for c, t in zip(cols[:7], kinds, strict=True))]
                names = [id_col, "sample", "n_pieces", "ids_crc32", "log_prob", "perturbed", "inclusion", "decoded_equal"]
                if keep_ids:
                    arrays.append(pa.array(cols[7], pa.list_(pa.int64())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(arrays, names)
                lo = hi

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"`{id_col}` {kind}, sample int, n_pieces long, ids_crc32 long, log_prob double, perturbed double, inclusion double, decoded_equal boolean" + (", ids array<long>" if keep_ids else ""))
