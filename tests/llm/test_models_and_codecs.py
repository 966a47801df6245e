"""Models on held-out rows, codecs as exact round trips, extraction and tagging against plain versions."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from recallium.llm import lm_scoring as L
from recallium.llm import media as M
from recallium.llm import pii
from recallium.llm import sp_sampling as S
from recallium.llm import toxicity as T
from recallium.llm.html_text import extract_pages, main_text
from recallium.llm.queries import ORACLE_SQL, QUERIES

ODD = [None, "", " ", "é梦߷ \x00\x7f", "a" * 700, "word " * 3000]


def frame(spark, texts):
    return spark.createDataFrame([(k, t, "x", 1.5) for k, t in enumerate(texts)], "doc_id long, text string, score string, held double")


def test_lm_scores(spark):
    texts = [*ODD, *["the cat sat", "The CAT", "dog the sat on"] * 20]
    toks = [(t or "").encode().lower().split() + [None] for t in texts]
    held = [zlib.crc32(str(k).encode()) % 7 == 2 for k in range(len(texts))]
    c = Counter(w for k, x in enumerate(toks) if not held[k] for w in x)
    n, v = sum(c.values()), len(c)
    got = L.score_documents(frame(spark, texts), rounds=0).collect()  # the tokenizer's own counts
    assert len(got) == len(texts)
    path, ends = L.default_vocabulary(), sum(not h for h in held)
    counts = Counter(p for w, m in c.items() if w is not None for p in L._processor(path).encode(w.decode()) * m)
    pieces, of_byte, longest = L.piece_weights(path, counts, ends)
    mass = sum(math.exp(w) for w in pieces.values()) + math.exp(L.end_weight(path, counts, ends))
    assert mass <= 1 and math.exp(L.end_weight(path, counts, ends)) == pytest.approx((ends + 1) / (sum(counts.values()) + ends + 1 + L._processor(path).get_piece_size()))
    for r in got:
        x = toks[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(x), sum(c[w] > 0 for w in x), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in x))
        spelled = {w: L.word_log_probability(w.decode(), pieces, of_byte, longest) for w in set(x) if w is not None}
        assert r.score == pytest.approx((sum(spelled[w] for w in x if w is not None) + L.end_weight(path, counts, ends)) / math.log(10))
        mixed = [math.log10(c[w] / (n + v) + v / (n + v) * math.exp(spelled[w])) for w in x if w is not None and (c[w] or spelled[w] > -600)]
        assert len(mixed) < len(x) - 1 or r.mixed_score == pytest.approx(sum(mixed) + math.log10((ends + 1) / (n + v + 1)))
    assert L.score_documents(frame(spark, texts).limit(0)).count() == 0


def test_lattice_sums_all_segmentations():
    pieces = {"▁": math.log(0.1), "▁a": math.log(0.2), "a": math.log(0.05), "b": math.log(0.15), "ab": math.log(0.1), "▁ab": math.log(0.3)}
    of_byte = [math.log(0.001)] * 256

    def brute(s):
        if not s:
            return 1.0
        out = sum(math.exp(pieces[s[:k]]) * brute(s[k:]) for k in range(1, len(s) + 1) if s[:k] in pieces)
        return out + (math.exp(sum(of_byte[x] for x in s[0].encode())) * brute(s[1:]) if s[0] not in pieces else 0)

    for w in ("ab", "abab", "aéb", "bbba"):
        assert L.word_log_probability(w, pieces, of_byte, 3) == pytest.approx(math.log(brute("▁" + w)))


def brute_spans(x):
    o = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", x)]
    o += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", x) if all(int(q) <= 255 for q in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", x):
        d = re.sub("[^0-9]", "", m[0])
        if 12 <= len(d) <= 19 and pii.luhn(d):
            o.append((m.start(), 2, m.end()))
    return sorted(o + [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", x) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15])


def test_pii_rules():
    rng = np.random.default_rng(2)
    alphabet = list("01259.@+-() abZ%_é")
    for _ in range(4000):
        x = "".join(rng.choice(alphabet, rng.integers(0, 60)))
        assert pii.base_spans(x) == brute_spans(x)
    for x in ("a@b.c@d.e", "1.2.3.4.5.6.7.8", "300.1.1.1", "4111 1111 1111 1111", "+1 (415) 555-2671.", "000001.2.3.04", "x@a..b a@b-.c"):
        assert pii.base_spans(x) == brute_spans(x)
    assert pii.mask_text("mail a.b@c.de now", pii.base_spans("mail a.b@c.de now")) == "mail [EMAIL] now"


def test_pii_network(spark):
    r = np.random.default_rng(3)
    p = pii.start_parameters(r)
    c, y = r.integers(0, 132, (9, 4)), r.integers(0, 5, (9, 4))
    p = {k: v.astype(np.float64) for k, v in p.items()}
    loss, g = pii.gradient(p, c, y)
    for k in p:  # gradients against differences
        at = tuple(r.integers(0, n) for n in p[k].shape) if k != "e" else (c[0, 0], 1)
        q = {n: v.copy() for n, v in p.items()}
        q[k][at] += 1e-3
        assert (pii.gradient(q, c, y)[0] - loss) / 1e-3 == pytest.approx(g[k][at], abs=2e-2)
    a = pii.emissions(p, pii.run_lstm(p, c)[0]).transpose(0, 2, 1)
    assert np.abs(a - pii.fast_emissions(p, c)).max() < 1e-4
    text = ("lorem ipsum " * 60 + "mail bob.smith@mail.example.com or +1 (415) 555-2671 ") * 3
    df = frame(spark, [*ODD, text])
    got = {x.doc_id: x for x in pii.detect(df).collect()}
    assert len(got) == 7 and (got[6].n_email, got[6].n_phone) == (3, 3)
    for k, t in enumerate([*ODD, text]):
        base = pii.spans_text(brute_spans(t or ""))
        assert got[k].base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert set(filter(None, base.split(","))) <= set(got[k].spans.split(","))
    assert got[1].spans == "" and pii.detect(df.limit(0)).count() == 0
    masked = {x.doc_id: x.text for x in pii.mask(df).collect()}
    assert masked[0] is None and "@" not in masked[6] and pii.mask(df).columns == df.columns


def test_viterbi_against_all_paths():
    from itertools import product

    r = np.random.default_rng(5)
    for T in (1, 2, 4):
        e, trans = r.normal(0, 2, (T, 5, 6)).astype(np.float32), r.normal(0, 1, (5, 5)).astype(np.float32)
        got, still = pii.viterbi(e, trans), pii.quiet(e, trans)
        for n in range(6):
            ways = [y for y in product(range(5), repeat=T) if all(a == b or a == 0 or b == 0 for a, b in zip(y, y[1:], strict=False))]
            best = max(ways, key=lambda y: sum(float(e[t, k, n]) for t, k in enumerate(y)) + sum(float(trans[a, b]) for a, b in zip(y, y[1:], strict=False)))
            assert tuple(got[:, n]) == best and (not still[n] or not any(best))


def test_tagging_does_not_depend_on_where_windows_end(spark, sf_dir):
    r = np.random.default_rng(6)
    p = pii.start_parameters(r)
    p["b"][0] = 0.5  # so that many kinds begin and end
    p["t"] = r.normal(0, 1, (5, 5)).astype(np.float32)
    for n in (5, 256, 257, 900):
        text = "".join(r.choice(list("ab 01.@"), n))
        labels, _ = pii.tag_texts(p, [text])[0]
        c, core = pii.char_classes(text), pii.WINDOW - pii.OVERLAP
        whole = np.empty((n, 5), np.float32)  # each place's emissions from the window in which it is farthest from an edge
        for w in range(max(1, -(-(n - pii.OVERLAP) // core))):
            part = c[w * core : w * core + pii.WINDOW]
            pad = np.zeros((-(-len(part) // 32) * 32, 1), np.uint8)
            pad[: len(part), 0] = part
            at = 0 if w == 0 else w * core + pii.OVERLAP // 2
            whole[at : w * core + len(part)] = pii.fast_emissions(p, pad)[at - w * core : len(part), :, 0]
        assert labels.tolist() == pii.viterbi(whole[:, :, None], p["t"])[:, 0].tolist()


def test_pii_finds_other_forms(spark):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect() if r.text]
    p = pii.fit(*pii.labelled_windows(texts[:500]))
    rng = np.random.default_rng(99)
    placed, found, wrong = Counter(), Counter(), 0
    for t in texts[500:1000] * 3:
        s, y = pii._written(rng)
        at = max(0, t.find(" ", len(t[:600]) // 2))
        x = f"{t[:at]} {s} {t[at:600]}"
        base, every = pii.find_spans(p, [x])[0]
        more, want = [z for z in every if z not in base], (at + 1, y - 1, at + 1 + len(s))
        if y and not any(a < want[2] and want[0] < b for a, _, b in base):
            placed[y - 1] += 1
            found[y - 1] += want in more
        wrong += sum(z != want for z in more)
    assert all(placed[k] > 40 and found[k] >= 0.8 * placed[k] for k in range(4)), (placed, found)
    assert wrong <= 0.03 * sum(found.values())


def test_ftrl_against_a_plain_loop():
    texts, y = ["bad word here", "nice word here today", "bad bad thing", "", "nice thing"] * 4, [1, 0, 1, 0, 0] * 4
    weights, bias = T.train(texts, y, bits=12, epochs=2)
    z, n, zb, nb = {}, {}, 0.0, 0.0
    order = np.random.default_rng(7)
    weight = lambda k: 0.0 if abs(z.get(k, 0)) <= T.L1 else -(z[k] - math.copysign(T.L1, z[k])) / ((T.BETA + math.sqrt(n[k])) / T.ALPHA + T.L2)
    of_bias = lambda: -zb / ((T.BETA + math.sqrt(nb)) / T.ALPHA)
    for _ in range(2):
        for row in order.permutation(len(texts)):
            f = sorted(set(T.features(texts[row], 12).tolist()))
            w = {k: weight(k) for k in f}
            g = 1 / (1 + math.exp(-(sum(w.values()) + of_bias()))) - y[row]
            b = of_bias()
            for k in f:
                s = (math.sqrt(n.get(k, 0) + g * g) - math.sqrt(n.get(k, 0))) / T.ALPHA
                z[k], n[k] = z.get(k, 0) + g - s * w[k], n.get(k, 0) + g * g
            s = (math.sqrt(nb + g * g) - math.sqrt(nb)) / T.ALPHA
            zb, nb = zb + g - s * b, nb + g * g
    want = np.zeros(1 << 12)
    for k in z:
        want[k] = weight(k)
    assert np.abs(want - weights).max() < 1e-5 and bias == pytest.approx(of_bias()) and 0 < np.count_nonzero(weights) < len(z)
    p = T.predict(["bad word", ""], weights, bias, 12)
    f = set(T.features("bad word", 12).tolist())
    assert p[0] == pytest.approx(1 / (1 + math.exp(-(sum(want[k] for k in f) + bias)))) and p[1] == pytest.approx(1 / (1 + math.exp(-bias)))


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    rows = T.classify(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))
    truth = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic").filter("toxic is not null")
    held = rows.filter("held_out").join(truth, "doc_id").toPandas()
    rank = held["score"].rank().to_numpy()
    pos = held["toxic"].to_numpy() == 1
    auc = (rank[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())
    hit = held["predicted"].to_numpy() == 1
    assert auc > 0.88 and (hit & pos).sum() / hit.sum() > 0.9 and (hit & pos).sum() / pos.sum() > 0.5


def test_toxicity_of_clashing_columns(spark):
    docs = spark.createDataFrame([(k, "bad word" if k % 2 else "nice word", 1.0, "q") for k in range(40)] * 2, "doc_id long, text string, _score double, _t string")
    labels = docs.selectExpr("doc_id", "int(doc_id % 2) as toxic")
    model = T.fit(docs, labels)
    with pytest.raises(ValueError):
        T.score_toxicity(docs, model)
    assert T.score_toxicity(docs, model, score_col="s").count() == 80 and T.classify(docs, labels).count() == 80


def test_toxicity(spark, sf_dir):
    docs = spark.createDataFrame([(k, f"filler w{k % 50} some text " + ("you moron clown" if k % 3 == 0 else "you nice person") + " more words here", "x") for k in range(600)], "doc_id long, text string, predicted string")
    labels = docs.selectExpr("doc_id", "1 as quality", "int(doc_id % 3 = 0) as toxic")
    rows = T.classify(docs.unionByName(spark.createDataFrame([(900, None, "x"), (None, "", "x")], docs.schema)), labels).collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == 602 and len(held) > 50 and all(0 <= r.score <= 1 for r in rows)
    assert all(r.predicted == int(r.doc_id % 3 == 0) for r in held)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows if r.doc_id is not None)
    assert T.classify(docs, labels.limit(0)).filter("score > 0.6").count() == 0
    assert T.classify(docs.limit(0), labels).count() == 0


def test_html(spark, sf_dir):
    from html import unescape

    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    got = {r.page_id: r for r in extract_pages(pages).collect()}
    for r in pages.collect():
        body = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        want = " ".join(unescape(re.sub(r"<[^>]+>", "", re.sub(r"<(/?p|br|/?h1)>", " ", body))).split())
        assert got[r.page_id].text == want and got[r.page_id].n_chars == len(want)
    good = "<p>" + "the cat of the house and it was on a mat " * 8 + "</p>"
    for bad in ('<div id="comments"><p>this is a comment and it was of the best kind of the day</p></div>', '<div class="cookie-notice">we use the cookies and it is on</div>', "<form><p>name of the user</p></form>", "<header><p>the site of the day</p></header>", '<ul class="menu"><li><a href="/">Home</a></li></ul>', "<aside><p>more of the same and the rest of it</p></aside>", "<script>if (a < b) { the of and }</script>", "<!-- the of -->", '<p style="display: none">the hidden text of the page</p>'):
        for page in (f"<body>{bad}{good}</body>", f"<body>{good}{bad}", f"<main>{good}{bad}</main>"):
            assert main_text(page) == " ".join(good[3:-4].split()), (bad, page[:60])
    assert main_text(None) == main_text("") == main_text("<nav>x</nav>") == ""
    assert main_text("<article><p>a &lt;b&gt; &amp;amp; c</p><p>x</article>") == "a <b> &amp; c x"
    main_text("<" * 5000 + "<a " * 2000 + '<p class="' + "x" * 10000)


def test_media_round_trip(spark):
    rng = np.random.default_rng(4)
    pay = [rng.choice(v, 64 * n).astype(np.uint8).tobytes() for n in (1, 5, 6, 7, 31) for v in ([128] * 20 + [127, 129], [0, 255, 127, 128, 129, 130], list(range(256)))]
    files = M.encode_payloads(pay)
    assert M.read_back(*M.decode_coefficients(files)) == pay
    for f in files:
        assert f[:2] == b"\xff\xd8" and f[-2:] == b"\xff\xd9" and b"\xff\xc2" in f
    got = {r.doc_id: r for r in M.media_column(frame(spark, [*ODD, "same", "same"]), keep=True).collect()}
    for k, t in enumerate([*ODD, "same", "same"]):
        raw, n = M.payload_of(t)
        r = got[k]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (n, len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-64:]))
        assert r.media_bytes == len(r.media) and r.media_sha256 == hashlib.sha256(r.media).hexdigest() and len(r.rgb) == 3 * r.width * r.height
    assert got[6].feature == got[7].feature and got[6].media_sha256 == got[7].media_sha256


def test_media_transform():
    coef = np.zeros((1, 64), np.int64)
    coef[0, 0], coef[0, 1], coef[0, 4] = 80, -30, 17
    x = np.arange(8)
    basis = np.array([[np.cos((2 * i + 1) * u * np.pi / 16) * (0.5**0.5 if u == 0 else 1) / 2 for i in x] for u in x])
    block = np.zeros(64)
    block[M.ZIGZAG] = coef[0]
    want = basis.T @ block.reshape(8, 8) @ basis
    got = coef[0].astype(float) @ M._BASIS / 8192
    assert np.abs(got.reshape(8, 8) - want).max() < 0.05


def test_sampled_encodings(spark):
    lat = S.Lattices(L.default_vocabulary())
    texts = ["the re\né", "", "x", "a  b", "梦߷"]

    def brute(t):
        s, out = "▁" + t.replace(" ", "▁"), {}

        def walk(i, ids, w):
            if i == len(s):
                out[tuple(ids)] = w
                return
            single = False
            for j in range(i + 1, len(s) + 1):
                if s[i:j] in lat.piece:
                    k, p = lat.piece[s[i:j]]
                    single |= j == i + 1
                    walk(j, [*ids, k], w * p)
            if not single:
                code = s[i].encode()
                walk(i + 1, [*ids, *(lat.byte[b] for b in code)], w * lat.byte_weight ** len(code))

        walk(0, [], 1.0)
        z = sum(out.values())
        return {k: v / z for k, v in out.items()}

    for t in texts[:1] + texts[2:]:
        p = brute(t)
        n = 3000
        got = S.sample_texts(lat, [t] * n, np.arange(n).astype(np.uint64) * np.uint64(7919), 3)
        assert all(len({tuple(r["ids"]) for r in g}) == len(g) == min(3, len(p)) for g in got)
        assert all(r["log_prob"] == pytest.approx(math.log(p[tuple(r["ids"].tolist())]), abs=1e-9) for g in got[:200] for r in g)
        first = Counter(tuple(g[0]["ids"].tolist()) for g in got)
        for k, v in p.items():
            assert abs(first[k] / n - v) < 5 * math.sqrt(v * (1 - v) / n) + 2e-3
        assert np.mean([sum(math.exp(r["log_prob"]) / r["inclusion"] for r in g) for g in got]) == pytest.approx(1, abs=0.03)
        assert all(S.decode_ids(lat, r["ids"]) == t.encode() for g in got[:50] for r in g)
    rows = S.sampled_encodings(frame(spark, [*ODD, "same text", "same text"])).collect()
    assert all(r.decoded_equal for r in rows) and {r.doc_id for r in rows} == set(range(8))
    again = S.sampled_encodings(frame(spark, [*ODD, "same text", "same text"]).repartition(3)).collect()
    key = lambda r: (r.doc_id, r["sample"])
    assert sorted(rows, key=key) == sorted(again, key=key)


@pytest.mark.parametrize("name", [n for n in sorted(ORACLE_SQL) if n.startswith(("op1_", "op3_"))])  # the later ones: test_archives_audit_spelling.py
def test_sql(spark, sf_dir, name):
    c = duckdb.connect()
    for t in ("documents", "labels", "pages", "benchmark"):
        c.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    want = c.execute(ORACLE_SQL[name]).df().sort_values("doc_id").reset_index(drop=True)
    got = QUERIES[name](spark, sf_dir).toPandas().sort_values("doc_id").reset_index(drop=True)
    assert list(want.columns) == list(got.columns) and (want.astype(str) == got.astype(str)).all().all()


def test_pipeline(spark, sf_dir):
    import corpus_pipeline as C

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    seen = docs
    assert len(C.STAGES) == 5
    for name, f in C.STAGES:
        out = f(spark, seen, sf_dir).cache()
        if name != C.STAGES[-1][0]:
            assert out.columns == docs.columns
        if name == "exact dedup":
            key = F.regexp_replace("text", r"[\x20\x09-\x0D]", "")
            assert out.count() == seen.select(key).distinct().count() == out.select(key).distinct().count()
        if name == "n-gram Jaccard join":
            from tests_helpers import brute_kept

            assert {r.doc_id for r in out.collect()} == brute_kept(seen)
        if name == "PII":
            assert all(not brute_spans(r.text or "") or "@" not in r.text for r in out.collect()) and out.count() == seen.count()
        if name == "best-fit packing":
            assert {r.doc_id for r in out.collect()} == {r.doc_id for r in seen.collect()}
        seen = out
