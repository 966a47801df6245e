"""Language-model scoring over a subword lattice (op 2).

The vocabulary is that of an existing tokenizer. It holds merge ranks, no log-probabilities, so the scores are fitted
here, on the lattice: beginning with the counts of the tokenizer's own pieces, a round sums over all training words how
often each piece is expected to occur in them (forward and backward sums over all segmentations, times the word's
count), and a piece's score is its add-one share of those, with the end of a text as one more piece. A word's probability is summed over all its segmentations into pieces, by a forward recursion in log space;
no piece spans two words, so a document's lattice is the chain of its words' lattices and an end, and its marginal
probability, ``score``, is their product. ``mixed_score`` is another model beside it: words seen in training have their
counts, and the lattice spells the others (Witten-Bell weights).

Each task turns its documents into blocks: a dictionary of the block's words with training counts, and per document
the numbers and counts of its words. Only dictionaries, one row per word and block, are shuffled by word: counts are summed
partially, one lattice is run per distinct word, and a join (which adaptive execution splits at common words) takes
counts and probabilities back to the blocks. Word counts cover all training texts.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import cached_property
from math import exp, log, log1p, log10

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, shuffle_width

ROUNDS = 3  # of expected counts
GRAIN = 1 << 20  # expected counts are summed as whole multiples of this part, so that no order of summation shows
WORDS_A_TASK = 100_000
PLAIN_LETTERS = 24  # words up to this length are summed as they are, longer ones as logarithms
BLOCK_BYTES = 24 << 20  # of text behind one block's dictionary
_STATE: dict = {}


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _processor(path: str):
    if _STATE.get("path") != path:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        _STATE.update(path=path, sp=sp, memo={})
    return _STATE["sp"]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of kind 0: a document of a block; of kind 1: a word of a block's dictionary."""
    part, number = TaskContext.get().partitionId(), 0
    local: dict[bytes, int] = {}
    counts = np.zeros(1 << 16, np.int64)
    size = 0
    names = ["kind", "block", "id", "held", "ids", "reps", "n_tokens", "local", "word", "c"]
    id_type = None

    def dictionary() -> pa.RecordBatch:
        n = len(local)
        none = lambda t: pa.nulls(n, t)
        return pa.RecordBatch.from_arrays([pa.array(np.ones(n, np.int32)), pa.array(np.full(n, part << 24 | number)), none(id_type), none(pa.bool_()), none(pa.binary()), none(pa.binary()), none(pa.int64()), pa.array(np.arange(n, dtype=np.int32)), pa.array(list(local), pa.binary()), pa.array(counts[:n])], names)

    for whole in batches:
        id_type = whole.column(0).type
        for lot in range(0, whole.num_rows, 1024):
            b = whole.slice(lot, 1024)
            ids, reps, totals = [], [], []
            for text, held in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                raw = (text or "").encode("utf-8", "surrogatepass")
                words = raw.lower().split()
                u, c = np.unique(np.array([local.setdefault(w, len(local)) for w in words], np.int32), return_counts=True)
                if len(local) > len(counts):
                    counts = np.concatenate([counts, np.zeros(max(len(counts), len(local)), np.int64)])
                if not held:
                    counts[u] += c
                ids.append(np.diff(u, prepend=np.int32(0)).astype(np.int32).tobytes())
                reps.append(c.astype(np.int32).tobytes())
                totals.append(len(words) + 1)
                size += len(raw)
            n = b.num_rows
            none = lambda t: pa.nulls(n, t)  # noqa: E731, B023
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(n, np.int32)), pa.array(np.full(n, part << 24 | number)), b.column(0), b.column(2), pa.array(ids, pa.binary()), pa.array(reps, pa.binary()), pa.array(totals, pa.int64()), none(pa.int32()), none(pa.binary()), none(pa.int64())], names)
            if size >= BLOCK_BYTES:
                if local:
                    yield dictionary()
                local.clear()
                counts[:] = 0
                size, number = 0, number + 1
    if local:
        yield dictionary()


def _count_pieces(path: str):
    """Counts of the tokenizer's own pieces over words and their training counts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp = _processor(path)
        total = np.zeros(sp.get_piece_size(), np.int64)
        for b in batches:
            words = [w.decode("utf-8", "replace") for w in b.column(0).to_pylist()]
            c = b.column(1).to_numpy()
            for lot in range(0, len(words), 20_000):
                got = sp.encode(words[lot : lot + 20_000], num_threads=1)
                lens = [len(g) for g in got]
                if sum(lens):
                    total += np.bincount(np.concatenate([np.array(g, np.int64) for g in got]), np.repeat(c[lot : lot + 20_000], lens), len(total)).astype(np.int64)
        k = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(total[k])], ["piece", "n"])

    return run


def piece_weights(path: str, counts: dict[int, float], ends: int) -> tuple[dict[str, float], list[float], int]:
    """Natural-log weights of all ordinary pieces and of the byte pieces, add-one smoothed beside ``ends`` ends of texts;
    the longest piece."""
    sp = _processor(path)
    n = sp.get_piece_size()
    total = _mass(sp, counts, ends)
    weight = {k: log((counts.get(k, 0) + 1) / total) for k in range(n)}
    pieces = {sp.id_to_piece(k): weight[k] for k in range(n) if not (sp.is_control(k) or sp.is_unknown(k) or sp.is_byte(k) or sp.is_unused(k))}
    of_byte = [log(1 / total)] * 256
    for k in range(n):
        if sp.is_byte(k):
            of_byte[int(sp.id_to_piece(k)[1:-1], 16)] = weight[k]
    return pieces, of_byte, max(map(len, pieces))


def _mass(sp, counts: dict[int, float], ends: int) -> float:
    return sum(counts.values()) + sp.get_piece_size() + ends + 1


def end_weight(path: str, counts: dict[int, float], ends: int) -> float:
    return log((ends + 1) / _mass(_processor(path), counts, ends))


class Lattice:
    """Sums over all segmentations of words, for one set of weights."""

    def __init__(self, pieces: dict[str, float], of_byte: list[float], longest: int):
        self.log, self.of_byte, self.longest = pieces, of_byte, longest
        # Beginnings of pieces that are none themselves weigh nothing; what is no beginning of a piece ends the look ahead.
        self.plain: dict[str, float] = {}
        for k in pieces:
            for j in range(1, len(k)):
                self.plain.setdefault(k[:j], 0.0)
        self.plain.update({k: exp(v) for k, v in pieces.items()})
        self.ahead = {k: pieces.get(k) for k in self.plain}
        self.names = list(pieces)
        self.weights = np.array([exp(pieces[k]) for k in self.names] + [0.0])
        self.keys, self.slots = _hash_table(self.names)

    def edges(self, s: str) -> list[list[tuple[int, str, float]]]:
        """Per place, (end, piece, log of its weight) of the pieces that begin there, or of the character's bytes."""
        n, ahead = len(s), self.ahead
        out = []
        for i in range(n):
            here = []
            for j in range(i + 1, n + 1):
                p = s[i:j]
                if p not in ahead:
                    break
                if (w := ahead[p]) is not None:
                    here.append((j, p, w))
            if not here or here[0][0] > i + 1:
                here.insert(0, (i + 1, s[i], self.spelled(s[i])))
            out.append(here)
        return out

    def spelled(self, char: str) -> float:
        return sum(self.of_byte[x] for x in char.encode("utf-8", "surrogatepass"))

    def log_probability(self, word: str) -> float:
        """The log of the summed weights of all segmentations of the word, begun by the word mark."""
        s = "▁" + word
        if len(s) <= PLAIN_LETTERS:
            total = self._forward(self._weighed(s))[-1]
            if total > 1e-280:
                return log(total)
        return _log_sums([[(j, w) for j, _, w in here] for here in self.edges(s)])[-1]

    def _weighed(self, s: str) -> list[list[tuple[int, str, float]]]:
        n, get = len(s), self.plain.get
        out = []
        for i in range(n):
            here = []
            for j in range(i + 1, n + 1):
                p = s[i:j]
                w = get(p)
                if w is None:
                    break
                if w:
                    here.append((j, p, w))
            if not here or here[0][0] > i + 1:
                here.insert(0, (i + 1, s[i], exp(self.spelled(s[i]))))
            out.append(here)
        return out

    def _grids(self, words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, list[np.ndarray], list[np.ndarray]]]:
        """Words of one length at a time: which they are, their letters, and per length of piece, at each place, the piece's
        number (the last number for none) and weight."""
        marked = ["▁" + w for w in words]
        size = np.array([len(w) for w in marked])
        letters = np.frombuffer("".join(marked).encode("utf-32-le"), np.uint32)
        start = np.concatenate([[0], np.cumsum(size)[:-1]]) if len(size) else size
        for n in np.unique(size[size <= PLAIN_LETTERS]).tolist():
            rows = np.flatnonzero(size == n)
            c = letters[start[rows][:, None] + np.arange(n)]
            front = np.zeros((len(rows), n + 1), np.uint64)
            for k in range(n):
                front[:, k + 1] = front[:, k] * _BASE + c[:, k] + np.uint64(1)
            ids, weights = [], []
            for k in range(1, min(n, self.longest) + 1):
                power = np.uint64(pow(int(_BASE), k, 1 << 64))
                found = self._numbers(front[:, k:] - front[:, : n - k + 1] * power, k)
                ids.append(found)
                weights.append(self.weights[found])
            none = ids[0] == len(self.names)
            if none.any():
                odd, at = np.unique(c[none], return_inverse=True)
                weights[0][none] = np.array([exp(self.spelled(chr(x))) for x in odd])[at]
            yield rows, c, ids, weights

    def _numbers(self, h: np.ndarray, length: int) -> np.ndarray:
        """Numbers of the pieces with these hashes, or the last number."""
        key = _spread(h, length).ravel()
        last = np.uint64(len(self.keys) - 1)
        at = key & last
        there = self.keys[at]
        out = np.where(there == key, self.slots[at], len(self.names))
        more = np.flatnonzero((there != key) & (there != 0))  # another piece's slot: look at the next one
        at = at[more]
        while len(more):
            at = (at + np.uint64(1)) & last
            there, wanted = self.keys[at], key[more]
            hit = there == wanted
            out[more[hit]] = self.slots[at[hit]]
            go = ~hit & (there != 0)
            more, at = more[go], at[go]
        return out.reshape(h.shape)

    @staticmethod
    def _forwards(weights: list[np.ndarray]) -> np.ndarray:
        m, n = weights[0].shape
        alpha = np.zeros((m, n + 1))
        alpha[:, 0] = 1
        for j in range(1, n + 1):
            for k in range(1, min(j, len(weights)) + 1):
                alpha[:, j] += alpha[:, j - k] * weights[k - 1][:, j - k]
        return alpha

    def log_probabilities(self, words: list[str]) -> np.ndarray:
        """``log_probability`` of many words; those of one length are summed together."""
        out = np.full(len(words), np.nan)
        for rows, _, _, weights in self._grids(words):
            total = self._forwards(weights)[:, -1]
            fine = total > 1e-280
            out[rows[fine]] = np.log(total[fine])
        for k in np.flatnonzero(np.isnan(out)):
            out[k] = self.log_probability(words[k])
        return out

    def expected_counts(self, words: list[str], times: np.ndarray) -> tuple[np.ndarray, dict[str, int]]:
        """Expected counts of all words, each as often as ``times`` says, in parts of ``GRAIN``: per piece, and of the
        characters that are no piece."""
        total, odd = np.zeros(len(self.names) + 1, np.int64), Counter()
        left = np.ones(len(words), bool)
        for rows, c, ids, weights in self._grids(words):
            alpha = self._forwards(weights)
            fine = alpha[:, -1] > 1e-280
            left[rows[fine]] = False
            n = c.shape[1]
            beta = np.zeros_like(alpha)
            beta[:, n] = 1
            for i in range(n - 1, -1, -1):
                for k in range(1, min(n - i, len(weights)) + 1):
                    beta[:, i] += weights[k - 1][:, i] * beta[:, i + k]
            with np.errstate(divide="ignore", invalid="ignore"):
                scale = np.where(fine, times[rows] * GRAIN / alpha[:, -1], 0.0)[:, None]
            for k, w in enumerate(weights, 1):
                e = np.rint(alpha[:, : n - k + 1] * w * beta[:, k:] * scale).astype(np.int64)
                hit = e > 0
                np.add.at(total, ids[k - 1][hit], e[hit])
                if k == 1 and (none := hit & (ids[0] == len(self.names))).any():
                    for x, v in zip(c[none].tolist(), e[none].tolist(), strict=True):
                        odd[chr(x)] += v
        for k in np.flatnonzero(left):
            for p, e in self.expected(words[k]):
                v = round(e * int(times[k]) * GRAIN)
                if (at := self.number.get(p)) is not None:
                    total[at] += v
                else:
                    odd[p] += v
        return total[:-1], odd

    @cached_property
    def number(self) -> dict[str, int]:
        return {p: k for k, p in enumerate(self.names)}

    @staticmethod
    def _forward(edges: list[list[tuple[int, str, float]]]) -> list[float]:
        alpha = [1.0] + [0.0] * len(edges)
        for a, here in zip(alpha, edges, strict=False):  # grows as it is read
            for j, _, w in here:
                alpha[j] += a * w
        return alpha

    def expected(self, word: str) -> list[tuple[str, float]]:
        """(piece, how often it is expected in the word); a piece may come more than once."""
        s = "▁" + word
        n = len(s)
        if n <= PLAIN_LETTERS:
            edges = self._weighed(s)
            alpha = self._forward(edges)
            if alpha[n] > 1e-280:
                beta = [0.0] * n + [1.0]
                out = []
                for i in range(n - 1, -1, -1):
                    b, front = 0.0, alpha[i] / alpha[n]
                    for j, p, w in edges[i]:
                        wb = w * beta[j]
                        b += wb
                        out.append((p, front * wb))
                    beta[i] = b
                return out
        logs = self.edges(s)
        alpha = _log_sums([[(j, w) for j, _, w in here] for here in logs])
        back: list[list[tuple[int, float]]] = [[] for _ in range(n)]
        for i, here in enumerate(logs):
            for j, _, w in here:
                back[n - j].append((n - i, w))
        beta = _log_sums(back)[::-1]
        return [(p, exp(alpha[i] + w + beta[j] - alpha[n])) for i, here in enumerate(logs) for j, p, w in here]


_BASE = np.uint64(0x9E3779B97F4A7C15)


def _spread(h: np.ndarray, length: int) -> np.ndarray:
    """A key from a substring's hash and length; never 0. Pieces have some letters at most, so that equal keys of unequal
    substrings are left to chance (one in 10**14 for a word)."""
    k = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(length)
    return (k ^ (k >> np.uint64(32))) | np.uint64(1)


def _hash_table(names: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Open addressing: keys (0 for an empty slot) and the numbers of the pieces."""
    size = 1 << max(4, (8 * len(names)).bit_length())
    keys, slots = np.zeros(size, np.uint64), np.zeros(size, np.int64)
    by_length: dict[int, list[int]] = {}
    for k, p in enumerate(names):
        by_length.setdefault(len(p), []).append(k)
    for n, some in by_length.items():
        c = np.frombuffer("".join(names[k] for k in some).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(some), n)
        h = np.zeros(len(some), np.uint64)
        for j in range(n):
            h = h * _BASE + c[:, j] + np.uint64(1)
        for k, key in zip(some, _spread(h, n).tolist(), strict=True):
            at = key & (size - 1)
            while keys[at]:
                if int(keys[at]) == key:
                    raise ValueError("two pieces share a key")
                at = (at + 1) & (size - 1)
            keys[at], slots[at] = key, k
    return keys, slots


def _log_sums(edges: list[list[tuple[int, float]]]) -> list[float]:
    """Forward recursion in log space; every place can be reached, since each has an edge to the next."""
    alpha: list[float | None] = [0.0] + [None] * len(edges)
    for i, here in enumerate(edges):
        for j, w in here:
            w += alpha[i]
            a = alpha[j]
            alpha[j] = w if a is None else (a + log1p(exp(w - a)) if a > w else w + log1p(exp(a - w)))
    return alpha


def word_log_probability(word: str, pieces: dict[str, float], of_byte: list[float], longest: int) -> float:
    return Lattice(pieces, of_byte, longest).log_probability(word)


def _expected_pieces(path: str, shared):
    """Expected counts of pieces over (word, c), in parts of ``GRAIN``: (piece, n). Characters outside the vocabulary are
    counted by their bytes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp = _processor(path)
        lattice = Lattice(*piece_weights(path, *shared.value))
        ids = [sp.piece_to_id(p) for p in lattice.names]
        of_byte = {int(sp.id_to_piece(k)[1:-1], 16): k for k in range(sp.get_piece_size()) if sp.is_byte(k)}
        total: dict[int, int] = {}
        for b in batches:
            got, odd = lattice.expected_counts([w.decode("utf-8", "replace") for w in b.column(0).to_pylist()], b.column(1).to_numpy())
            for k in np.flatnonzero(got).tolist():
                total[ids[k]] = total.get(ids[k], 0) + int(got[k])
            for char, n in odd.items():
                for x in char.encode("utf-8", "surrogatepass"):
                    if x in of_byte:
                        total[of_byte[x]] = total.get(of_byte[x], 0) + n
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())], ["piece", "n"])

    return run


def fit_pieces(seen: DataFrame, path: str, ends: int, rounds: int = ROUNDS) -> dict[int, float]:
    """Counts per piece over ``seen`` (word, c): the tokenizer's own, then ``rounds`` times the expected ones. The driver
    gets a row per piece of the vocabulary."""
    counts: dict[int, float] = {int(r.piece): int(r.n) for r in seen.mapInArrow(_count_pieces(path), "piece long, n long").groupBy("piece").agg(F.sum("n").alias("n")).collect()}
    for _ in range(rounds):
        shared = seen.sparkSession.sparkContext.broadcast((counts, ends))
        rows = seen.mapInArrow(_expected_pieces(path, shared), "piece long, n long").groupBy("piece").agg(F.sum(F.col("n").cast("decimal(38,0)")).alias("n")).collect()
        counts = {int(r.piece): int(r.n) / GRAIN for r in rows}
        shared.destroy()
    return counts


def _score_words(path: str, shared):
    """(word, c) of distinct words, with the log of their marginal probability."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(*piece_weights(path, *shared.value))
        for b in batches:
            lp = lattice.log_probabilities([w.decode("utf-8", "replace") for w in b.column(0).to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(lp, pa.float64())], ["word", "c", "lp"])

    return run


def _score_block(total: int, distinct: int, ends: int, end: float):
    """``end``: the natural log of the lattice's weight of an end."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        held, totals = left.column("held"), left.column("n_tokens").to_numpy()
        n = left.num_rows
        ids = [np.cumsum(np.frombuffer(x, np.int32)) for x in left.column("ids").to_pylist()]
        reps = [np.frombuffer(x, np.int32) for x in left.column("reps").to_pylist()]
        doc = np.repeat(np.arange(n), [len(x) for x in ids])
        flat = np.concatenate(ids) if n else np.empty(0, int)
        rep = np.concatenate(reps) if n else np.empty(0, int)
        at = right.column("local").to_numpy()
        c, lp = np.zeros(len(at)), np.zeros(len(at))
        c[at], lp[at] = right.column("c").to_numpy(), right.column("lp").to_numpy()
        base = np.log10((c + 1) / (total + distinct + 1))
        # Witten-Bell: words seen get c / (N + V), and V / (N + V) is spread by the lattice.
        seen, new = c / max(1, total + distinct), (distinct if total else 1) / max(1, total + distinct)
        with np.errstate(divide="ignore"):
            mixed = np.logaddexp(np.log(seen), np.log(new) + lp) / log(10)
        end_base = log10((ends + 1) / (total + distinct + 1))
        sums = [np.bincount(doc, v[flat] * rep if len(at) else None, n) if len(flat) else np.zeros(n) for v in (base, lp / log(10), (c > 0).astype(float), mixed)]
        return pa.table({"doc_id": left.column("id"), "held_out": held, "n_tokens": pa.array(totals), "n_known": pa.array((sums[2] + (ends > 0)).astype(np.int64)), "train_tokens": pa.array(np.full(n, total)), "base_score": pa.array(sums[0] + end_base), "score": pa.array(sums[1] + end / log(10)), "mixed_score": pa.array(sums[3] + end_base)})

    return run


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 7, held: int = 2, vocabulary: str | None = None, rounds: int = ROUNDS) -> DataFrame:
    """Per row: doc_id, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score`` (the
    lattice's marginal), ``mixed_score``; all log10.

    Null texts count as empty: one token, the end. A null id is never held out. Repeated rows are counted and scored
    as often as they occur; an empty table gives no rows; extra columns are ignored.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "lm")
    path = vocabulary or default_vocabulary()
    id_type = docs.schema[id_col].dataType.simpleString()
    fold = F.coalesce(F.crc32(F.encode(F.col(id_col).cast("string"), "UTF-8")) % folds == held, F.lit(False))
    made = scratch.cut(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"), fold.alias("held")).mapInArrow(
        _blocks, f"kind int, block long, id {id_type}, held boolean, ids binary, reps binary, n_tokens long, local int, word binary, c long"), "kind")
    rows = made.filter("kind = 0")
    words = made.filter("kind = 1").select("word", "block", "local", "c")
    # Lattices cost a task's time by words, not bytes: the distinct words are dealt out evenly and evened out for every round.
    distinct = scratch.cut(words.groupBy("word").agg(F.sum("c").alias("c")))
    distinct = scratch.cut(distinct.repartition(max(shuffle_width(spark), -(-distinct.count() // WORDS_A_TASK))))
    total, known = distinct.filter("c > 0").agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    ends = rows.filter("not held").count()
    total, known = int(total) + ends, int(known) + (ends > 0)
    counts = fit_pieces(distinct.filter("c > 0"), path, ends, rounds)
    shared = spark.sparkContext.broadcast((counts, ends))
    lattices = distinct.mapInArrow(_score_words(path, shared), "word binary, c long, lp double")
    scored = words.drop("c").join(lattices, "word").select(F.col("block").alias("of_block"), "local", "c", "lp")
    out = rows.select("block", "id", "held", "ids", "reps", "n_tokens").groupBy("block").cogroup(scored.groupBy("of_block")).applyInArrow(
        _score_block(total, known, ends, end_weight(path, counts, ends)), f"doc_id {id_type}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, mixed_score double")
    return out
