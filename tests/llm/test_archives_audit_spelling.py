"""Archives, the filter audit and spelling variants against brute force, with nulls, repeats, ties and broken input."""

from __future__ import annotations

import gzip
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import duckdb
import pytest

from recallium.llm import queries as Q
from recallium.llm import warc as W
from recallium.llm.common import Scratch
from recallium.llm.filter_audit import filter_audit
from recallium.llm.spelling import bigram_order, near_pairs, spelling_variants

PAGES = "page_id long, url string, html string, rid string, digest string"


# 11


def pages_frame(spark, rows):
    return spark.createDataFrame([(i, f"http://x/{i}", h, "a", "b") for i, h in rows], PAGES)


def some_pages():
    r = random.Random(5)
    long = "".join(r.choice("aé<>\r\n x世") for _ in range(60_000))
    equal = "same " * 300
    return [(0, None), (1, ""), (2, "short"), (3, "short"), (4, equal), (5, equal), (9, equal), (7, long), (8, long + "!"), (6, "WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n" * 90), (None, "no id " * 400), (11, "x" * 999), (10, "x" * 999)]


def brute_pages(rows):
    groups = defaultdict(list)
    for i, h in rows:
        b = (h or "").encode()
        if len(b) >= 1000:
            groups[b].append(i)
    out = []
    for i, h in rows:
        b = (h or "").encode()
        best = max(groups[b], key=lambda k: -1 if k is None else k) if b in groups else i
        out.append((i, len(b), hashlib.sha1(b).hexdigest(), "response" if best == i else "revisit", None if best == i else best))
    return sorted(out, key=str)


def test_archives_round_trip(spark, tmp_path):
    rows = some_pages()
    got = W.archive_pages(pages_frame(spark, rows), f"{tmp_path}/a", segment_bytes=700, chunk_bytes=333, archive_bytes=60_000)
    assert sorted(map(tuple, got.collect()), key=str) == brute_pages(rows)
    read = {r.page_id: r for r in W.read_archives(spark, f"{tmp_path}/a").filter("type = 'response'").collect()}
    assert read["7"].payload.decode() == dict(rows)[7] and read["6"].payload.decode() == dict(rows)[6] and read["2"].url == "http://x/2"
    files = [p for p in (tmp_path / "a").iterdir() if p.name.endswith(".gz")]
    assert len(files) > 1
    whole = b"".join(gzip.decompress(p.read_bytes()) for p in files)
    assert whole.count(b"WARC-Type: continuation") > 100 and whole.count(b"WARC-Segment-Total-Length") == 7  # the responses longer than a segment


def test_archives_of_repeated_rows_and_of_nothing(spark, tmp_path):
    same = "page " * 400
    rows = [(1, same), (1, same), (2, "s"), (2, "s"), (None, same)]
    got = W.archive_pages(pages_frame(spark, rows)).collect()
    assert sorted((r.page_id or -1, r.record_type, r.refers_to) for r in got if r.payload_bytes > 9) == sorted([(1, "response", None), (1, "revisit", 1), (-1, "revisit", 1)], key=lambda x: (x[0], x[1]))
    assert [r.record_type for r in got if r.payload_bytes < 9] == ["response"] * 2
    assert W.archive_pages(pages_frame(spark, rows).limit(0)).count() == 0


def origin(payload: bytes, size=400):
    fields = [("WARC-Type", "response"), ("WARC-Record-ID", "<urn:uuid:1>"), ("WARC-Date", "d"), ("Page-ID", "5"), ("WARC-Payload-Digest", f"sha1:{hashlib.sha1(payload).hexdigest()}")]
    return list(W.segments(fields, W.HEAD + W.chunked(payload, 90), size))


def archive(tmp_path, name, records):
    (tmp_path / name).mkdir()
    for k, lot in enumerate(records):
        (tmp_path / name / f"{k}.warc.gz").write_bytes(b"".join(gzip.compress(r + W.END) for r in lot))
    return str(tmp_path / name)


def test_segments_in_any_order_and_archive(spark, tmp_path):
    payload = bytes(range(256)) * 8
    parts = origin(payload)
    assert len(parts) > 4
    shuffled = [[parts[3], parts[0]], parts[:0:-1], [parts[2]]]  # some twice: copied archives
    (row,) = W.read_archives(spark, archive(tmp_path, "ok", shuffled)).collect()
    assert (row.payload, row.error, row.page_id) == (payload, None, "5")


@pytest.mark.parametrize("change,said", [
    (lambda p: p[:2] + p[3:], "segment is missing"),
    (lambda p: p[1:], "first segment is missing"),
    (lambda p: p[:-1], "segment is missing"),
    (lambda p: [*p[:-1], re.sub(rb"Total-Length: \d+", b"Total-Length: 7", p[-1])], "total length differs"),
    (lambda p: [*p, p[1].replace(b"\r\n\r\n", b"\r\n\r\n", 1)[:-1] + b"?"], "segments differ under one number"),
])
def test_broken_segments_have_no_payload(spark, tmp_path, change, said):
    (row,) = W.read_archives(spark, archive(tmp_path, "bad", [change(origin(bytes(range(256)) * 8))])).collect()
    assert row.payload is None and row.error == said


def test_chunked_framing():
    for n in (0, 1, 89, 90, 91, 1000):
        assert W.dechunked(W.chunked(b"z" * n, 90)) == b"z" * n
    assert W.dechunked(b"3;name=x\r\nabc\r\nA\n0123456789\n0\r\nTrailer: y\r\n\r\n") == b"abc0123456789"
    for bad in (b"", b"5\r\nabc", b"x\r\nabc\r\n0\r\n\r\n", b"3\r\nabcd\r\n0\r\n\r\n", b"3\r\nabc\r\n"):
        with pytest.raises(ValueError):
            W.dechunked(bad)


def test_records_of_broken_archives():
    whole = b"".join(r + W.END for r in origin(b"q" * 900))
    assert [f.get("cut") for f, _ in W.records_of(whole)] == [None] * 3 == [f.get("cut") for f, _ in W.records_of(gzip.compress(whole))]
    assert list(W.records_of(whole[:-50]))[-1][0]["cut"] and list(W.records_of(gzip.compress(whole)[:-30]))[-1][0]["cut"]
    assert list(W.records_of(b"")) == [] and list(W.records_of(b"hello"))[0][0]["cut"]
    folded = b"WARC/1.0\nWARC-Type: response\nX-Note: a\n b\ncontent-length:2\n\nhi\n\n"
    assert [(f["x-note"], b) for f, b in W.records_of(folded)] == [("a b", b"hi")]


def test_urls_cannot_break_headers(spark):
    df = spark.createDataFrame([(1, "http://x/\r\nWARC-Type: revisit\r\n\r\n", "body")], "page_id long, url string, html string")
    assert [r.record_type for r in W.archive_pages(df).collect()] == ["response"]


# 12


def brute_audit(docs, labels):
    least = {}
    for i, t, _ in docs:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    q, x = ({k for k, *v in labels if v[j] == 1 and k is not None} for j in (0, 1))
    parts = defaultdict(list)
    for i, t, lang in docs:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        bad = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and i > least[t]}
        parts[lang or ""].append(({c for c in bad if bad[c]}, i in q, i in x))
    out, shapley = {}, Counter()
    for part, rows in parts.items():
        for order in map("".join, permutations("ABCDE")):
            left = list(rows)
            for k, c in enumerate(order):
                gone = [r for r in left if c in r[0]]
                left = [r for r in left if c not in r[0]]
                shapley[part, c] += len(gone)
                out[part, order, k + 1] = [len(left), len(gone), sum(c in r[0] for r in rows) - len(gone), sum(r[0] == {c} for r in rows), sum(r[1] for r in gone), sum(r[2] for r in gone)]
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_filter_audit(spark):
    r = random.Random(2)
    base = ["", "a", "A " * 300, " ".join(f"w{k}" for k in range(200)), " ".join(f"w{k}" for k in range(199)), "x y " * 150, " ".join(f"w{k}#" for k in range(250)), "ABCD" + "e" * 96, "AB" + "e" * 64, "\x0bq\x0cr ", "q r s"]
    docs = [(k, r.choice([*base, None]), r.choice(["en", "de", "", None])) for k in range(120)]
    docs += [(3, docs[3][1], "en"), (None, "a", "en"), (None, None, None), (500, "É" * 50 + " | " + "long word " * 60_000, "xx")]
    labels = [(k, r.choice([0, 1, None]), r.choice([0, 1, None])) for k in range(0, 120, 2)] + [(4, 1, 1), (4, 0, 0), (None, 1, 1)]
    df = spark.createDataFrame([(*d, 1, "z") for d in docs], "doc_id long, text string, lang string, quality int, part string")
    got = filter_audit(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    cols = "kept removed redundant unique_fails good_lost toxic_lost shapley".split()
    assert {(x.part, x.filter_order, x.step): tuple(x[c] for c in cols) for x in got.collect()} == brute_audit(docs, labels)
    assert filter_audit(df.limit(0), spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0


# 13


def brute_words(docs):
    n = Counter()
    for i, t in docs:
        for r in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            r = "".join(c.lower() if "A" <= c <= "Z" else c for c in r)
            h = zlib.crc32(f"{'' if i is None else i}:{r}".encode())
            n[r[: h % len(r)] + r[h % len(r) + 1 :] if h % 97 == 0 else r] += 1
    return {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute_variants(docs):
    n = brute_words(docs)
    out, form = {}, {}
    for w in n:
        found = [v for v in n if near(w, v)]
        best = min(found, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
        out[w] = [form[w], None, n[w], len(found), n[form[w]] if form[w] else None]
    for w in n:
        v = w
        while form[v]:
            v = form[v]
        out[w][1] = v
    return {w: tuple(v) for w, v in out.items()}


def random_docs(seed, count=40):
    r = random.Random(seed)
    stems = ["aaaaa", "aaaaaa", "banana", "bananas", "colour", "color", "éàüöß", "éàüöñ", "abcabcabc", "Straße", "x" * 700]
    def word():
        w = r.choice(stems)
        for _ in range(r.choice([0, 0, 1, 2])):
            k = r.randrange(len(w) + 1)
            w = r.choice([w[:k] + r.choice("abzéA") + w[k:], w[:k] + w[k + 1 :], w[:k] + r.choice("abzÀ") + w[k + 1 :]])
        return w
    return [(k, r.choice([" ", "-", "1"]).join(word() for _ in range(400))) for k in range(count)]


@pytest.mark.parametrize("seed", [1, 2])
def test_spelling_variants(spark, seed):
    docs = [*random_docs(seed), (None, "colour colour banana"), (7, None), (8, ""), (7, "colour " * 5), (7, "colour " * 5), (9, "123 ×÷×÷× " * 4)]
    df = spark.createDataFrame([(*d, "w", 1) for d in docs], "doc_id long, text string, word string, n int")
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling_variants(df).collect()}
    assert got == brute_variants(docs) and len(got) > 60 and any(v[0] != v[1] for v in got.values() if v[0])
    assert spelling_variants(df.limit(0)).count() == 0


def test_roots_over_long_chains(spark):
    from recallium.llm.spelling import last_forms

    rows = [(f"w{k}", f"w{k + 1}" if k < 21 else None) for k in range(22)]
    got = dict(map(tuple, last_forms(spark.createDataFrame(rows, "word string, form string"), Scratch(spark, "t")).collect()))
    assert got == {f"w{k}": "w21" for k in range(21)}


def test_every_near_pair_is_found(spark):
    r = random.Random(9)
    words = sorted({"".join(r.choice("ab") for _ in range(r.randint(5, 9))) for _ in range(400)})
    df = spark.createDataFrame([(w, 3) for w in words], "word string, n long")
    got = {tuple(sorted((x.a, x.b))) for x in near_pairs(df, bigram_order(df)).collect()}
    assert got == {(a, b) for k, a in enumerate(words) for b in words[k + 1 :] if near(a, b)}


def test_spelling_broadcasts_no_vocabulary(spark):
    from recallium.llm.spelling import best_forms

    scratch = Scratch(spark, "t")
    words = scratch.cut(spark.createDataFrame([("garden", 9), ("gardens", 3), ("warden", 4)], "word string, n long"))
    pairs = scratch.cut(near_pairs(words, bigram_order(words)))
    assert int(spark.conf.get("spark.sql.autoBroadcastJoinThreshold").rstrip("bB")) > 1 << 20
    for df in (near_pairs(words, bigram_order(words)), best_forms(words, pairs)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan


@pytest.mark.parametrize("name", ["op11_warc", "op12_filter_audit", "op13_spelling"])
def test_queries_against_sql(spark, sf_dir, name):
    from test_queries import TABLES, rows

    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    got, want = Q.QUERIES[name](spark, sf_dir).toPandas(), db.execute(Q.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)
