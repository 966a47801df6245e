"""Best-fit packing by patterns and non-negative least squares (op 5).

Lengths of pieces make a histogram of at most ``capacity`` bins, so the plan is made on the driver whatever the size
of the corpus: few-piece patterns that fill a sequence are enumerated, their repeat counts are fitted to the
histogram by non-negative least squares and rounded down, and what is left is packed best fit first, run by run of
equal lengths. Rows then look up their place by their number among the pieces of their length.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from itertools import batched

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, holds

CAPACITY = 4096
END_ID = 1
CACHE_UNITS = 200_000  # about 40 MB in a worker that later stages use again
CELL_ROWS = 200_000
LOT_CHARS = 1 << 22  # of text that is split together
_STATE: dict = {}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: Texts of these characters split into the tokenizer's units by ``_split``; others go to the tokenizer whole.
_PLAIN = re.compile(r"[ -~\n\tÀ-ÖØ-öø-ÿ–—“”‘’…¿¡«»]*+")
_WHITE, _LETTER, _DIGIT, _OTHER = range(4)
#: By byte of lower-case UTF-8 text of those characters; a byte behind 0xC3 is a letter's second one.
_KIND = np.full(256, _OTHER, np.uint8)
_KIND[list(b" \n\t")] = _WHITE
_KIND[[*range(ord("a"), ord("z") + 1), 0xC3]] = _LETTER
_KIND[list(b"0123456789")] = _DIGIT


def _encoder(path: str):
    """The tokenizer and this worker's cache of units; a unit's ids do not depend on its neighbours."""
    if _STATE.get("path") != path:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        tok = Tokenizer.from_file(path)
        # For lower-case runs of letters with spaces between, the same model without the normaliser's regular expressions.
        lean = Tokenizer(tok.model)
        lean.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False), pre_tokenizers.CharDelimiterSplit("Ġ")])
        ends = np.zeros(tok.get_vocab_size(), bool)
        for piece, k in tok.get_vocab().items():
            ends[k] = piece.endswith("</w>")
        _STATE.update(path=path, tok=tok, lean=lean, ends=ends, cache={}, old={})
    return _STATE["tok"], _STATE["cache"]


def _clear() -> bool:
    held = bool(_STATE)
    _STATE.clear()
    return held


holds("packing", _clear)


def _learn(units: list[bytes]) -> None:
    """Put units into the cache. Runs of letters are encoded together, one string for many: the last id of each is one
    that ends a word."""
    tok, cache = _STATE["tok"], _STATE["cache"]
    runs, single = [], []
    for u in units:
        (runs if _KIND[u[0]] == _LETTER else single).append(u)
    lots = list(batched(runs, 200))
    for lot, got in zip(lots, _STATE["lean"].encode_batch_fast([b" ".join(lot).decode() for lot in lots], add_special_tokens=False), strict=True):
        ids = np.array(got.ids, "<u4")
        cuts = np.flatnonzero(_STATE["ends"][ids]) + 1
        if len(cuts) != len(lot) or cuts[-1] != len(ids):
            single += lot
            continue
        raw = ids.tobytes()
        at = 0
        for u, c in zip(lot, (4 * cuts).tolist(), strict=True):
            cache[u] = raw[at:c]
            at = c
    for u in single:
        cache[u] = np.array(tok.encode(u.decode(), add_special_tokens=False).ids, "<u4").tobytes()


def _ids_of(units: list[bytes]) -> list[bytes]:
    """Ids of distinct units. The cache has two halves: a full one becomes the old one, from which units that are met
    again are taken over, so frequent units are not learned twice."""
    cache = _STATE["cache"]
    missing = [u for u in units if u not in cache]
    if cache and len(cache) + len(missing) > CACHE_UNITS // 2:
        _STATE["old"], _STATE["cache"] = cache, (cache := {})
        missing = units
    old = _STATE["old"]
    unknown = []
    for u in missing:
        raw = old.get(u)
        if raw is None:
            unknown.append(u)
        else:
            cache[u] = raw
    _learn(unknown)
    return [cache[u] for u in units]


def _split(texts: list[bytes]) -> tuple[pa.LargeBinaryArray, np.ndarray]:
    """The tokenizer's own pattern, for lower-case texts of plain characters: units, each text's first unit (with the end).
    A unit is a run of letters, a digit, a run of other characters, or one of 's 't 're 've 'm 'll 'd."""
    b = np.frombuffer(b"\n".join(texts) + b"\n\n\n", np.uint8)
    kind = _KIND[b]
    kind[np.flatnonzero(b == 0xC3) + 1] = _LETTER
    start = np.ones(len(b), bool)
    np.not_equal(kind[1:], kind[:-1], out=start[1:])
    start |= kind == _DIGIT
    q = np.flatnonzero((b == ord("'")) & start)
    one, two = b[q + 1], b[q + 2]
    short = np.isin(one, list(b"stmd"))
    long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
    q, size = q[short | long], np.where(short, 1, 2)[short | long]
    start[q + 1] = False
    start[q + 1 + size] = True
    keep = kind != _WHITE
    start &= keep
    at = np.flatnonzero(start)
    data = b[keep]
    offsets = np.append((np.cumsum(keep) - 1)[at], len(data)).astype(np.int64)
    begin = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(data)]), np.searchsorted(at, begin)


def encode_texts(texts: list[str], path: str) -> list[bytes]:
    """Ids of each whole text as little-endian unsigned 32-bit bytes, without the end id."""
    tok, _ = _encoder(path)
    plain = ["<|" not in t and _PLAIN.fullmatch(t) is not None for t in texts]
    units, first = _split([t.lower().encode() for t, p in zip(texts, plain, strict=True) if p])
    coded = units.dictionary_encode()
    known = _ids_of(coded.dictionary.to_pylist())
    code = coded.indices.to_numpy()
    ids = np.frombuffer(b"".join(known), "<u4")
    n = np.array([len(k) // 4 for k in known], np.int64)
    from_ = np.cumsum(n) - n
    count = n[code]
    ends = np.concatenate([[0], np.cumsum(count)])
    raw = ids[np.arange(ends[-1]) + np.repeat(from_[code] - ends[:-1], count)].tobytes()
    cuts = iter((4 * ends[first]).tolist())
    out, lo = [], next(cuts)
    for t, p in zip(texts, plain, strict=True):
        if p:
            hi = next(cuts)
            out.append(raw[lo:hi])
            lo = hi
        else:
            out.append(np.array(tok.encode(t, add_special_tokens=False).ids, "<u4").tobytes())
    return out


def _lots(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Bounds of lots of at most 1,024 texts and about ``LOT_CHARS`` characters."""
    lo, size = 0, 0
    for k, t in enumerate(texts):
        if k > lo and (k - lo == 1024 or size + len(t) > LOT_CHARS):
            yield lo, k
            lo, size = k, 0
        size += len(t)
    if texts:
        yield lo, len(texts)


def token_pieces(docs: DataFrame, id_col: str, text_col: str, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """Per piece: id, ``piece``, ``start``, ``length``, ``ids_crc32``. A null text counts as empty: one piece, the end id."""
    kind = docs.schema[id_col].dataType.simpleString()
    end = np.array([END_ID], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            texts = [t or "" for t in whole.column(1).to_pylist()]
            for lo, hi in _lots(texts):
                b = whole.slice(lo, hi - lo)
                ids = encode_texts(texts[lo:hi], tokenizer)
                rows, piece, start, length, crc = [], [], [], [], []
                for k, raw in enumerate(ids):
                    raw += end
                    for p, at in enumerate(range(0, len(raw), 4 * capacity)):
                        part = raw[at : at + 4 * capacity]
                        rows.append(k)
                        piece.append(p)
                        start.append(at // 4)
                        length.append(len(part) // 4)
                        crc.append(zlib.crc32(part))
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int32())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], ["_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t")).mapInArrow(run, f"_id {kind}, piece int, start long, length long, ids_crc32 long")


def patterns(lengths: np.ndarray, counts: np.ndarray, capacity: int, slack: int = 4, wanted: int = 60_000) -> list[tuple[int, ...]]:
    """Patterns of two to four present lengths whose sum is within ``slack`` of the capacity."""
    present = np.zeros(capacity + 1, bool)
    present[lengths] = True
    below = np.zeros(capacity + 1, int)  # the largest present length up to here
    below[lengths] = lengths
    below = np.maximum.accumulate(below)
    cum = np.cumsum(counts)
    marks = np.unique(lengths[np.searchsorted(cum, np.linspace(0, cum[-1] - 1, 24).astype(int), "right").clip(0, len(lengths) - 1)])
    found: set[tuple[int, ...]] = set()

    def close(part: tuple[int, ...]) -> None:
        left = capacity - sum(part)
        if left > 0 and below[left] and left - below[left] <= slack:
            found.add(tuple(sorted((*part, int(below[left])), reverse=True)))

    for a in map(int, lengths[::-1]):
        close((a,))
        for b in map(int, marks):
            close((a, b))
            if len(found) < wanted:
                for c in map(int, marks[::6]):
                    close((a, b, c))
    return sorted(found, reverse=True)


def fit_repeats(pats: list[tuple[int, ...]], target: np.ndarray, rounds: int = 250) -> np.ndarray:
    """Non-negative least squares: repeat counts x >= 0 that minimise ||A x - target||, by accelerated projected gradient."""
    col = np.repeat(np.arange(len(pats)), [len(p) for p in pats])
    row = np.concatenate([np.array(p) for p in pats])

    def forward(x: np.ndarray) -> np.ndarray:
        return np.bincount(row, x[col], len(target))

    def back(r: np.ndarray) -> np.ndarray:
        return np.bincount(col, r[row], len(pats))

    v = np.ones(len(pats))
    for _ in range(12):
        v = back(forward(v))
        v /= np.linalg.norm(v)
    step = 1 / (1.02 * np.linalg.norm(back(forward(v))))
    x = y = np.zeros(len(pats))
    t = 1.0
    for _ in range(rounds):
        new = np.maximum(0, y - step * back(forward(y) - target))
        nt = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y = new + (t - 1) / nt * (new - x)
        x, t = new, nt
    return x


def best_fit(left: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit by decreasing length over runs of equal lengths: (content, how many sequences)."""
    bins: dict[int, list[list]] = {}
    mask = 0
    full = []

    def put(content: tuple[int, ...], room: int, n: int) -> None:
        nonlocal mask
        if room == 0:
            full.append((content, n))
            return
        bins.setdefault(room, []).append([content, n])
        mask |= 1 << room

    for size in sorted(left, reverse=True):
        n = left[size]
        while n:
            fits = mask >> size
            if not fits:
                each = capacity // size
                if n // each:
                    put((size,) * each, capacity - size * each, n // each)
                if n % each:
                    put((size,) * (n % each), capacity - size * (n % each), 1)
                break
            room = size + (fits & -fits).bit_length() - 1
            top = bins[room][-1]
            take = min(n, top[1])
            top[1] -= take
            if not top[1]:
                bins[room].pop()
                if not bins[room]:
                    mask &= ~(1 << room)
            put((*top[0], size), room - size, take)
            n -= take
    return full + [(c, n) for runs in bins.values() for c, n in runs]


#: Settings tried in turn until one meets the least possible number: slack of a pattern, share of the fitted repeats.
TRIES = [(4, 1.0), (0, 1.0), (1, 0.5), (0, 0.5), (0, 0.25), (0, 0.1)]


def packing_plan(hist: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """(content, repeats) of all sequences: fitted patterns rounded down, then the rest best fit. Of a few settings the
    one with the fewest sequences counts; all work on the histogram, so this costs the same at any size."""
    left = {k: v for k, v in hist.items() if v}
    full = [((capacity,), left.pop(capacity))] if capacity in left else []
    if not left:
        return full
    least = -(-sum(k * v for k, v in left.items()) // capacity)
    best, fewest = None, 0
    for slack, share in TRIES:
        plan = _fitted_plan(dict(left), capacity, slack, share)
        n = sum(r for _, r in plan)
        if best is None or n < fewest:
            best, fewest = plan, n
        if fewest <= least:
            break
    return full + best


def _fitted_plan(left: dict[int, int], capacity: int, slack: int, share: float) -> list[tuple[tuple[int, ...], int]]:
    out = []
    lengths = np.array(sorted(left))
    counts = np.array([left[k] for k in lengths])
    pats = patterns(lengths, counts, capacity, slack)
    if pats:
        target = np.zeros(capacity + 1)
        target[lengths] = counts
        x = fit_repeats(pats, target)
        for k in np.argsort(-x, kind="stable"):
            n = int(x[k] * share + 1e-6)
            if n < 1:
                break
            need: dict[int, int] = {}
            for size in pats[k]:
                need[size] = need.get(size, 0) + 1
            n = min([n, *(left[s] // m for s, m in need.items())])
            if n:
                for s, m in need.items():
                    left[s] -= n * m
                out.append((pats[k], n))
    return out + best_fit({k: v for k, v in left.items() if v}, capacity)


def _places(plan: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per length: the first number of each run of places, the run's first sequence, the offset in it."""
    got: dict[int, list[tuple[int, int, int]]] = {}
    seq = 0
    for content, n in plan:
        at = 0
        for size in content:
            got.setdefault(size, []).append((n, seq, at))
            at += size
        seq += n
    out = {}
    for size, runs in got.items():
        n, s, o = (np.array(v, np.int64) for v in zip(*runs, strict=True))
        out[size] = (np.concatenate([[0], np.cumsum(n)[:-1]]), s, o)
    return out


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Per piece: id, ``piece``, ``start``, ``length``, ``ids_crc32``, ``sequence_id``, ``offset``.

    Documents longer than the capacity are cut into full pieces and a rest. Null and empty texts are one piece, the
    end id. Repeated rows are packed as often as they occur; an empty table gives no rows; extra columns are ignored.
    """
    spark = docs.sparkSession
    pieces = Scratch(spark, "pack").cut(token_pieces(docs, id_col, text_col, tokenizer or default_tokenizer(), capacity))
    hist = {int(r.length): int(r["count"]) for r in pieces.groupBy("length").count().collect()}  # at most `capacity` rows
    places = spark.sparkContext.broadcast(_places(packing_plan(hist, capacity)))
    cells = spark.createDataFrame([(k, max(1, -(-v // CELL_ROWS))) for k, v in sorted(hist.items())] or [(0, 1)], "length long, _cells long")
    rows = pieces.join(F.broadcast(cells), "length").withColumn("_c", F.expr("pmod(xxhash64(_id, piece), _cells)"))
    offs = rows.groupBy("length", "_c").count().withColumn("_o", F.expr("sum(count) over (partition by length order by _c) - count")).drop("count")
    # A length's pieces are numbered cell by cell; a cell holds about CELL_ROWS rows however common the length is.
    placed = rows.withColumn("_n", F.expr("row_number() over (partition by length, _c order by _id nulls last, piece, ids_crc32)")).join(offs, ["length", "_c"])

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = places.value
        for b in batches:
            size, num = b.column(3).to_numpy(), b.column(5).to_numpy()
            seq, off = np.empty(len(size), np.int64), np.empty(len(size), np.int64)
            order = np.argsort(size, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(size[order])) + 1) if len(order) else []:
                first, s, o = table[int(size[part[0]])]
                k = np.searchsorted(first, num[part], "right") - 1
                seq[part], off[part] = s[k] + num[part] - first[k], o[k]
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(seq), pa.array(off)], [id_col, "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    kind = pieces.schema["_id"].dataType.simpleString()
    return placed.select("_id", "piece", "start", "length", "ids_crc32", F.expr("_o + _n - 1").alias("_n")).mapInArrow(look_up, f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
