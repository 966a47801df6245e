"""Null ids, repeated rows, empty tables, very long texts and clashing columns, by operator; stored tensors and plain colours."""

from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from recallium.llm import media as M
from recallium.llm import packing as P
from recallium.llm import pii
from recallium.llm import sp_sampling as S
from recallium.llm import toxicity as T
from recallium.llm.jaccard_join import jaccard_components

ROWS = [(None, "one two three"), (None, None), (1, "mail a.b@c.de now"), (1, "mail a.b@c.de now"), (2, None), (2, ""), (3, "one two three")]
SCHEMA = "doc_id long, text string"


def test_pii_of_null_ids_and_repeated_null_texts(spark):
    got = pii.detect(spark.createDataFrame(ROWS, SCHEMA)).collect()
    assert Counter((r.doc_id, r.n_email, r.spans) for r in got) == Counter({(None, 0, ""): 2, (1, 1, "email:5:13"): 2, (2, 0, ""): 2, (3, 0, ""): 1})
    assert sorted(r.n_email for r in got) == [0] * 5 + [1] * 2
    assert pii.detect(spark.createDataFrame([], SCHEMA)).count() == 0


def test_packing_of_null_and_repeated_ids(spark):
    df = spark.createDataFrame([*ROWS, (None, "w " * 9000), (1, "mail a.b@c.de now")], SCHEMA)
    got = P.pack_documents(df).collect()
    assert Counter(r.doc_id for r in got if r.piece == 0) == Counter(r.doc_id for r in df.collect())
    filled = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == filled.get(r.sequence_id, 0)
        filled[r.sequence_id] = r.offset + r.length
    assert max(filled.values()) <= 4096 and sum(filled.values()) == sum(r.length for r in got)
    assert P.pack_documents(df.limit(0)).count() == 0


def test_patterns_win_where_lengths_pair_up():
    """Pieces of lengths that fill a sequence only in fixed combinations: the fitted patterns need fewer sequences than best fit."""
    hist = {2064: 600, 1056: 600, 1040: 600, 992: 1200}  # 900 sequences hold them exactly

    def best_fit():
        bins: dict[int, int] = {}
        used = 0
        for length, n in sorted(hist.items(), reverse=True):
            for _ in range(n):
                room = min((r for r in bins if r >= length and bins[r]), default=None)
                if room is None:
                    used, room = used + 1, 4096
                else:
                    bins[room] -= 1
                bins[room - length] = bins.get(room - length, 0) + 1
        return used

    plan = P.packing_plan(hist, 4096)
    placed: dict[int, int] = {}
    for content, n in plan:
        assert sum(content) <= 4096
        for size in content:
            placed[size] = placed.get(size, 0) + n
    assert placed == hist
    ours = sum(n for _, n in plan)
    assert ours < best_fit() and ours >= math.ceil(sum(k * n for k, n in hist.items()) / 4096)


def test_sampling_and_media_of_empty_tables_and_null_ids(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    assert S.sampled_encodings(df.limit(0)).count() == 0 and M.media_column(df.limit(0)).count() == 0
    got = S.sampled_encodings(df).collect()
    assert {r.doc_id for r in got} == {None, 1, 2, 3} and Counter((r.doc_id, r.n_pieces) for r in got)[(2, 0)] == 2
    media = M.media_column(df).collect()
    assert Counter(r.doc_id for r in media) == Counter(i for i, _ in ROWS)
    assert len({r.media_sha256 for r in media if r.n_bytes == 0}) == 1


def test_toxicity_of_very_long_texts(spark):
    r = np.random.default_rng(1)
    words = [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(400)]
    rows = [(k, " ".join(r.choice(words, 30)) + (" vile vile scum" if k % 3 == 0 else " fine day")) for k in range(120)]
    rows += [(1000, "vile scum " * 200_000), (1001, "x" * 3_000_000), (1002, None)]
    labels = spark.createDataFrame([(k, 1, int(k % 3 == 0)) for k in range(120)], "doc_id long, quality int, toxic int")
    got = {x.doc_id: x.score for x in T.classify(spark.createDataFrame(rows, SCHEMA), labels).collect()}
    assert len(got) == 123 and all(0 <= s <= 1 and not math.isnan(s) for s in got.values()) and got[1000] > got[1]


def test_jaccard_of_very_long_words(spark):
    rows = [(k, " ".join([w * n, "b", "c", "d", "e"])) for k, (w, n) in enumerate([("x", 511), ("x", 512), ("x", 513), ("X", 513), ("x", 5000), ("X", 5000), ("y", 5000)])]
    got = {r.doc_id: r.component_id for r in jaccard_components(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {0: 0, 1: 1, 2: 2, 3: 2, 4: 4, 5: 4, 6: 6}


def test_pipeline_of_null_ids_empty_tables_and_clashing_columns(spark, tmp_path):
    import corpus_pipeline as C

    r = np.random.default_rng(3)
    text = lambda: " ".join(r.choice(["alpha", "beta", "gamma", "delta", "of", "the", "and"], 40))
    rows = [(k if k % 9 else None, text() if k % 7 else None, "en", "s", 10, 0.5, "x", "y") for k in range(40)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, rk string, _t string"
    labels = spark.createDataFrame([(k, 1, int(k % 5 == 0)) for k in range(40)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    for name, df in (("some", spark.createDataFrame(rows, schema)), ("none", spark.createDataFrame([], schema))):
        seen = df
        for stage, f in C.STAGES:
            out = f(spark, seen, str(tmp_path)).cache()
            if stage != C.STAGES[-1][0]:
                assert out.columns == df.columns, stage
            assert out.count() <= max(seen.count(), 1) * 2 and (name != "none" or out.count() == 0)
            seen = out


def test_stored_tensors_give_the_digests(spark, tmp_path):
    df = spark.createDataFrame([*ROWS, (9, "é" * 3000)], SCHEMA)
    M.store_media(df, f"{tmp_path}/m")
    cols = ["doc_id", "media_bytes", "media_sha256", "feature"]
    key = lambda d: sorted(map(tuple, d.select(*cols).collect()), key=str)
    assert key(M.read_media(spark, f"{tmp_path}/m")) == key(M.media_column(df))
    assert spark.read.parquet(f"{tmp_path}/m").filter(F.octet_length("rgb") != 3 * F.col("width") * F.col("height")).count() == 0


def test_colours_and_upsampling_against_plain_loops():
    """Samples by the transform's sum in floating point, chroma by the sample that covers the pixel, colours by the usual formula."""
    payload = bytes(np.random.default_rng(4).integers(96, 160, 64 * 6).astype(np.uint8))
    files = M.encode_payloads([payload])
    images, coef, base = M.decode_coefficients(files)
    (got,) = M.rgb_tensors(images, coef, base)
    im = images[0]

    def plane(c):
        w, h = im.grids[c]
        out = np.zeros((h * 8, w * 8))
        for b in range(w * h):
            block = np.zeros(64)
            block[M.ZIGZAG] = coef[im.starts[c] + b] * im.quant[im.parts[c][3]]
            f = block.reshape(8, 8)
            for y in range(8):
                for x in range(8):
                    s = sum((0.5**0.5 if u == 0 else 1) * (0.5**0.5 if v == 0 else 1) * f[v, u] * math.cos((2 * x + 1) * u * math.pi / 16) * math.cos((2 * y + 1) * v * math.pi / 16) for u in range(8) for v in range(8)) / 4
                    out[b // w * 8 + y, b % w * 8 + x] = min(255, max(0, round(s) + 128))
        return out

    y, cb, cr = plane(0), plane(1), plane(2)
    worst = 0
    for i in range(im.height):
        for j in range(im.width):
            a, b, c = y[i, j], cb[i // 2, j // 2] - 128, cr[i // 2, j // 2] - 128
            want = [a + 1.402 * c, a - 0.344136 * b - 0.714136 * c, a + 1.772 * b]
            worst = max(worst, *(abs(min(255, max(0, v)) - int(g)) for v, g in zip(want, got[i, j], strict=True)))
    assert worst <= 4  # one step of each sample, and rounding
    assert zlib.crc32(got.tobytes()) == int(M.feature_of(got).rpartition(":")[2], 16)


@pytest.mark.parametrize("texts", [[], [None]])
def test_single_and_no_rows(spark, texts):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], SCHEMA)
    assert M.media_column(df).count() == len(texts) and S.sampled_encodings(df).count() == len(texts)
