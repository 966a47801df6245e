"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams (op 6).

Words, word heads, bigrams and one-skip bigrams are hashed into ``2**BITS`` coordinates. Training is online, in one
task, over a bounded sample of labelled rows (``MAX_TOXIC`` and ``MAX_CLEAN``, the rows least by a hash of their id);
the class rates over *all* labelled training rows correct the intercept. Per-coordinate rates and the L1 term leave few
weights, of which the driver sees and broadcasts only those that are not zero, as (coordinate, weight).
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import holds

BITS = 20
MAX_TOXIC, MAX_CLEAN = 3000, 6000  # the documented bound of the training sample
ALPHA, BETA, L1, L2, EPOCHS = 0.15, 1.0, 1.0, 0.5, 3
_WORD = re.compile(r"[^\W\d_]+")
STEM = 4  # letters of a word's head, a coordinate of its own: it carries over to inflected forms that training lacks
CACHE_WORDS = 100_000  # about 20 MB in a worker that later stages use again
_CACHE: dict[str, int] = {}
_DENSE: dict[str, object] = {}  # a worker's last model, by coordinate
_TABLE = {"word": np.zeros(1 << 16, np.uint64), "stem": np.zeros(1 << 16, np.uint64)}


def _hashes(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each word and of its head; a worker's cache of words is emptied when full."""
    cache = _CACHE
    words = _WORD.findall(text.lower())
    try:
        ids = [cache[w] for w in words]
    except KeyError:
        if len(cache) > CACHE_WORDS:
            cache.clear()
        for w in words:
            if w not in cache:
                k = cache[w] = len(cache)
                if k >= len(_TABLE["word"]):
                    for name, v in _TABLE.items():
                        _TABLE[name] = np.concatenate([v, np.zeros_like(v)])
                _TABLE["word"][k] = xxhash.xxh64_intdigest(w)
                _TABLE["stem"][k] = xxhash.xxh64_intdigest("^" + w[:STEM])
        ids = [cache[w] for w in words]
    at = np.array(ids, np.int64)
    return _TABLE["word"][at], _TABLE["stem"][at]


def _clear() -> bool:
    """Forget words and model. The table of hashes is addressed by the words' numbers and starts anew with them."""
    held = bool(_CACHE or _DENSE)
    _CACHE.clear()
    _DENSE.clear()
    return held


holds("toxicity", _clear)

Model = tuple[np.ndarray, np.ndarray, float]  # coordinates, their weights, the intercept
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def features(text: str, bits: int = BITS) -> np.ndarray:
    """Coordinates of all words, word heads, bigrams and one-skip bigrams of the whole text, with repeats."""
    h, stem = _hashes(text)
    shift = np.uint64(64 - bits)
    with np.errstate(over="ignore"):
        return np.concatenate([(h * _M1) >> shift, (stem * _M1) >> shift, ((h[:-1] * _M2 + h[1:]) * _M1) >> shift, ((h[:-2] * _M3 + h[2:]) * _M1) >> shift]).astype(np.int64)


def train(texts: list[str], labels: list[int], bits: int = BITS, epochs: int = EPOCHS, seed: int = 7) -> tuple[np.ndarray, float]:
    """FTRL-proximal: weights are a closed form of the sums z and n, zero while |z| is at most L1."""
    rows = [np.unique(features(t, bits)) for t in texts]
    z, n = np.zeros(1 << bits), np.zeros(1 << bits)
    zb = nb = 0.0
    rng = np.random.default_rng(seed)

    def bias() -> float:
        return -zb / ((BETA + nb**0.5) / ALPHA)

    for _ in range(epochs):
        for k in rng.permutation(len(rows)):
            x = rows[k]
            zx, nx = z[x], n[x]
            w = np.where(np.abs(zx) <= L1, 0, -(zx - np.sign(zx) * L1) / ((BETA + np.sqrt(nx)) / ALPHA + L2))
            p = 1 / (1 + np.exp(-np.clip(w.sum() + bias(), -35, 35)))
            g = p - labels[k]
            s = (np.sqrt(nx + g * g) - np.sqrt(nx)) / ALPHA
            z[x] = zx + g - s * w
            n[x] = nx + g * g
            sb = ((nb + g * g) ** 0.5 - nb**0.5) / ALPHA
            zb, nb = zb + g - sb * bias(), nb + g * g
    w = np.where(np.abs(z) <= L1, 0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))
    return w.astype(np.float32), bias()


def predict(texts: list[str], weights: np.ndarray, bias: float, bits: int = BITS) -> np.ndarray:
    out = np.empty(len(texts))
    for k, t in enumerate(texts):
        f = features(t, bits)
        f = np.unique(f[weights[f] != 0])
        out[k] = 1 / (1 + np.exp(-np.clip(weights[f].astype(float).sum() + bias, -35, 35)))
    return out


def _trained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All weights that are not zero of the model of rows (id, text, label), and the intercept at -1; nothing without both labels."""
    t = pa.Table.from_batches(batches, pa.schema([("id", pa.string()), ("t", pa.string()), ("y", pa.int32())])).sort_by("id")
    texts, y = t.column("t").to_pylist(), t.column("y").to_pylist()
    pos, neg = sum(y), len(y) - sum(y)
    if pos and neg:
        weights, bias = train(texts, y)
        k = np.flatnonzero(weights)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(k, -1), pa.int64()), pa.array(np.append(weights[k].astype(float), bias - np.log(pos / neg)))], ["k", "w"])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", usable=None) -> Model:
    """Train on labelled rows for which ``usable`` (a column of the id) holds. Without labels of both kinds: no weights, the prior.

    An id that is labelled or occurs more than once counts once, by its largest label and its least text.
    """
    known = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max(label_col).cast("int").alias("_y"))
    if usable is not None:
        known = known.filter(usable)
    total = {r._y: r["count"] for r in known.groupBy("_y").count().collect()}
    order = F.xxhash64(F.col(id_col).cast("string"), F.lit(17))
    picks = [known.filter(F.col("_y") == y).orderBy(order, id_col).limit(most) for y, most in ((1, MAX_TOXIC), (0, MAX_CLEAN))]
    picked = F.broadcast(picks[0].unionByName(picks[1]).withColumnRenamed(id_col, "_id"))  # at most MAX_TOXIC + MAX_CLEAN ids
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_t")).join(picked, "_id").groupBy("_id").agg(F.min("_t").alias("t"), F.max("_y").alias("y"))
    got = rows.selectExpr("cast(_id as string) as id", "t", "y").repartition(1).mapInArrow(_trained, "k long, w double").toArrow()  # at most 2**BITS + 1 rows
    k, w = got.column("k").to_numpy(), got.column("w").to_numpy()
    prior = float(np.log((total.get(1, 0) + 0.5) / (total.get(0, 0) + 0.5)))
    return k[k >= 0].astype(np.int32), w[k >= 0].astype(np.float32), prior + float(w[k < 0].sum())


def _dense(shared) -> tuple[np.ndarray, float]:
    """The broadcast model as an array of all coordinates, made once per worker."""
    if _DENSE.get("of") != shared.value[-1]:
        k, w, bias, name = shared.value
        all_weights = np.zeros(1 << BITS, np.float32)
        all_weights[k] = w
        _DENSE.update(of=name, model=(all_weights, bias))
    return _DENSE["model"]


def score_toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", score_col: str = "_score") -> DataFrame:
    """All columns of ``docs`` and ``score_col``: the chance of the label 1. Null and empty texts get the intercept's.
    ``score_col`` must be a new name (``common.fresh`` finds one)."""
    if score_col in docs.columns:
        raise ValueError(f"a column {score_col} exists already")
    shared = docs.sparkSession.sparkContext.broadcast((*model, uuid.uuid4().hex))
    schema = StructType([*docs.schema.fields, StructField(score_col, DoubleType())])
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = _dense(shared)
        for b in batches:
            s = predict([t or "" for t in b.column(at).to_pylist()], weights, bias)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s)], [*b.schema.names, score_col])

    return docs.mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame, folds: int = 4, held: int = 2, threshold: float = 0.3) -> DataFrame:
    """Per row: doc_id, ``held_out``, ``score``, ``predicted``. Only ids outside the held-out fold are learnt from; only
    the text enters a score. Null ids are never learnt from; repeated rows are scored alike; empty tables give none."""
    fold = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % folds
    model = fit(docs, labels, usable=fold != held)
    s = score_toxicity(docs.select("doc_id", "text"), model)
    return s.select("doc_id", F.coalesce(fold == held, F.lit(False)).alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= threshold).cast("int").alias("predicted"))
