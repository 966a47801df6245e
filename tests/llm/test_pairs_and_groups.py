"""Exact dedup, the Jaccard join, sharding and packing against brute force, with nulls, empties, ties and clashing columns."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict
from itertools import combinations

import numpy as np
import pytest

from recallium.llm import jaccard_join as J
from recallium.llm import packing as P
from recallium.llm import sharding as H
from recallium.llm.components import connected_components
from recallium.llm.common import Scratch
from recallium.llm.exact_dedup import drop_exact_duplicates, exact_dedup
from recallium.llm.jaccard_join import jaccard_components
from recallium.llm.packing import pack_documents
from recallium.llm.sharding import shard_documents

SCHEMA = "doc_id long, text string, id string, block string, n int"


def frame(spark, texts):
    return spark.createDataFrame([(k, t, "x", "y", 1) for k, t in enumerate(texts)], SCHEMA)


def corpus(seed=3):
    r = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    base = [" ".join(r.choice(words) for _ in range(n)) for n in (1, 2, 3, 4, 5, 7, 9, 12, 15, 20, 40, 80, 200, 600)]
    out = [None, "", "  \n", "One two", "one TWO", *base]
    for b in base:
        out += [b, b.replace(" ", "\n", 1), b + " extra", "Head " + b]
        w = b.split()
        for _ in range(3):
            v = list(w)
            v[r.randrange(len(v))] = "changed"
            out.append(" ".join(v))
    return out


def brute_components(texts, n, num, den):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set())
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(range(len(texts)), 2):
        if sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return [find(k) for k in range(len(texts))], [len(s) for s in sets]


@pytest.mark.parametrize("n,num,den", [(4, 85, 100), (5, 80, 100), (1, 50, 100)])
def test_jaccard_components(spark, n, num, den):
    texts = corpus()
    comp, sizes = brute_components(texts, n, num, den)
    got = {r.doc_id: r for r in jaccard_components(frame(spark, texts), n=n, num=num, den=den).collect()}
    assert [got[k].component_id for k in range(len(texts))] == comp
    assert [got[k].n_shingles for k in range(len(texts))] == sizes


def test_jaccard_null_ids_and_empty_table(spark):
    df = spark.createDataFrame([(None, "a b c d e"), (1, "a b c d e"), (1, "a b c d e")], "doc_id long, text string")
    assert sorted(((r.doc_id, r.component_id) for r in jaccard_components(df).collect()), key=str) == [(1, 1), (1, 1), (None, None)]
    assert jaccard_components(df.limit(0)).count() == 0


def test_subset_sizes_cover_every_linked_pair():
    for a in range(1, 15):
        for b in range(a, 15):
            if a * 100 >= 85 * b:
                c = J.least_overlap(a, b, 85, 100)
                if c <= a:
                    assert c in J.subset_sizes(a, 14, 85, 100) and c in J.subset_sizes(b, 14, 85, 100)
                assert all(100 * o < 85 * (a + b - o) for o in range(c))
    assert 0 <= J.light_boundary({k: 10 for k in range(20)}, 85, 100) <= J.LARGEST_LIGHT


def test_bitmaps_never_refuse_a_link():
    r = np.random.default_rng(1)
    for n in (3, 10, 63, 64, 65, 300, 1500):
        s = np.unique(r.integers(0, 2**63, n).astype(np.uint64))
        k = len(s) // 14
        t = np.unique(np.concatenate([s[k:], r.integers(0, 2**63, k).astype(np.uint64)]))
        o = len(np.intersect1d(s, t))
        if o >= J.least_overlap(len(s), len(t), 85, 100):
            assert J.may_link(J.bitmap(s), J.bitmap(t), len(s), len(t), 85, 100)


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(50)] + [(100, 101)], "u long, v long")
    got = {r.node: r.comp for r in connected_components(edges, Scratch(spark, "t")).collect()}
    assert all(got[k] == 0 for k in range(51)) and got[101] == 100


def test_exact_dedup(spark):
    texts = [None, "", " \t", "a b", "ab", "a  b ", "x" * 5000, "x" * 4999 + " x", "x" * 5001, "é" * 3000, "é" * 2999 + "\n" + "é", "y" * 2048, "y" * 2049, "yy" * 2048]
    groups = defaultdict(list)
    strip = str.maketrans("", "", " \t\n\x0b\x0c\r")
    for k, t in enumerate(texts):
        groups[(t or "").translate(strip)].append(k)
    for block in (4, 2048):
        got = {r.doc_id: r for r in exact_dedup(frame(spark, texts), block_bytes=block).collect()}
        assert len(got) == len(texts)
        for text, ids in groups.items():
            keep = min(ids, key=lambda k: (-len(texts[k] or ""), k))
            for k in ids:
                assert (got[k].keep_id, got[k].group_size, got[k].kept) == (keep, len(ids), k == keep)
                assert got[k].text_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_exact_dedup_repeated_rows(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (None, "c"), (2, "c"), (3, None)], "doc_id long, text string")
    rows = exact_dedup(df).collect()
    assert len(rows) == 6 and sum(r.kept for r in rows) == 4  # one row per document, repeated ones too
    assert sorted(r.group_size for r in rows) == [1, 1, 2, 2, 2, 2] and sum(r.kept for r in rows if r.doc_id == 1) == 2
    left = drop_exact_duplicates(df).collect()
    assert sorted(((r.doc_id, r.text) for r in left), key=str) == sorted([(1, "a"), (1, "b"), (2, "c"), (3, None)], key=str)
    assert exact_dedup(df.limit(0)).count() == 0


def test_exact_dedup_of_text_ids_and_clashing_columns(spark, monkeypatch):
    from recallium.llm import exact_dedup as E

    df = spark.createDataFrame([("null", "a", "p", "q"), (None, "a", "r", "s"), ("x", "b", "t", "u")], "doc_id string, text string, _dedup_t string, _dedup_rk string")
    rows = exact_dedup(df).collect()
    assert len(rows) == 3 and sorted(r.group_size for r in rows) == [1, 2, 2]
    left = drop_exact_duplicates(df)
    assert left.columns == df.columns and sorted(tuple(r) for r in left.collect()) == [("null", "a", "p", "q"), ("x", "b", "t", "u")]
    monkeypatch.setattr(E, "AT_ONCE", 3)
    many = spark.createDataFrame([(7, "same")] * 8 + [(8, "sa me")], "doc_id long, text string")
    got = exact_dedup(many).collect()
    assert len(got) == 9 and {r.group_size for r in got} == {9} and [r.doc_id for r in got if r.kept] == [8]


def test_jaccard_repeated_ids_with_different_texts(spark):
    words = [f"w{k}" for k in range(60)]
    near = " ".join([*words[:59], "other"])
    df = spark.createDataFrame([(1, " ".join(words)), (1, "one more text of its own"), (2, near), (3, "one more text of its own"), (4, None)], "doc_id long, text string")
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_components(df).collect())
    assert got == [(1, 3, 1), (1, 57, 1), (2, 57, 1), (3, 3, 1), (4, 0, 4)]


@pytest.mark.parametrize("cell,block", [(3, 4), (2, 2)])
def test_split_lists_and_many_blocks(spark, monkeypatch, cell, block):
    monkeypatch.setattr(J, "CELL", cell)
    monkeypatch.setattr(J, "LINK_SETS", block)
    r = random.Random(8)
    words = [f"v{k}" for k in range(120)]
    texts = [None, "alone in the world"]
    for _ in range(40):  # pairs about the wanted similarity, so that some link only through others
        w = list(words)
        for _ in range(r.choice([1, 2, 2, 3])):
            w[r.randrange(120)] = f"x{r.randrange(10**6)}"
        texts.append(" ".join(w))
    comp, _ = brute_components(texts, 4, 85, 100)
    got = {x.doc_id: x.component_id for x in jaccard_components(frame(spark, texts)).collect()}
    assert [got[k] for k in range(len(texts))] == comp and len(set(comp)) > 3


def test_light_and_heavy_sets_all_take_part():
    hist = {k: 100 for k in range(1, 17)}
    x = J.light_boundary(hist, 85, 100)
    assert 0 < x < J.LARGEST_LIGHT  # the bound on listing never binds
    for n in range(1, 40):
        keys, pos = J._keys(np.arange(1, n + 1, dtype=np.uint64) << np.uint64(50), x, np.ones(1 << J.BIN_BITS, np.int64), 85, 100)
        assert len(keys) and ((pos == J.SUBSET).any() == (n <= x))


def brute_capacity(sums, shards):
    best = [0, *[float("inf")] * len(sums)]
    for _ in range(shards):
        best = [0] + [min(max(best[j], sum(sums[j:i])) for j in range(i)) for i in range(1, len(sums) + 1)]
    return best[-1]


def test_smallest_capacity():
    r = random.Random(4)
    for _ in range(60):
        sums = [r.randrange(1, 50) for _ in range(r.randrange(1, 14))]
        k = r.randrange(1, 6)
        c = H.smallest_capacity(sums, k)
        assert c == brute_capacity(sums, k)
        ends = [0, *H.balanced_ends(sums, c, k)]
        assert ends[-1] == len(sums) and all(sum(sums[a:b]) <= c for a, b in zip(ends[:-1], ends[1:], strict=True))


def test_sharding(spark):
    r = random.Random(5)
    texts = [None, ""] + ["hot text"] * 300 + ["".join(r.choice("abé") for _ in range(r.randrange(0, 200))) for _ in range(600)]
    got = shard_documents(frame(spark, texts)).collect()
    assert len(got) == len(texts)
    sums, slots, where = defaultdict(int), defaultdict(list), defaultdict(set)
    group = defaultdict(int)
    for row in got:
        raw = (texts[row.doc_id] or "").encode()
        assert row.size == len(raw) + 1 and row.text_crc32 == zlib.crc32(raw) and row.law == "bytes"
        sums[row.shard] += row.size
        slots[row.shard].append(row.slot)
        where[raw].add(row.shard)
        group[hashlib.sha256(raw).hexdigest()] += row.size
    assert all(len(s) == 1 for s in where.values()) and set(sums) <= set(range(16))
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert max(sums.values()) == H.smallest_capacity([group[k] for k in sorted(group)], 16)
    assert shard_documents(frame(spark, texts).limit(0)).count() == 0


@pytest.mark.parametrize("n,hot", [(300, 0.05), (3000, 0.05), (3000, 0.3), (2000, 0)])
def test_few_sums_are_collected_whatever_the_largest_group(spark, n, hot):
    r = random.Random(n)
    sizes = {hashlib.sha256(str(k).encode()).hexdigest(): r.randrange(1, 4000) for k in range(n)}
    if hot:
        sizes[hashlib.sha256(b"hot").hexdigest()] = int(hot / (1 - hot) * sum(sizes.values()))
    groups = spark.createDataFrame(list(sizes.items()), "g string, s long")
    cuts, capacity, most = H.minimax_cuts(groups, "g", "s", 16)
    sums = [sizes[k] for k in sorted(sizes)]
    assert capacity == H.smallest_capacity(sums, 16) and most <= 4096
    shards = defaultdict(int)
    for g, size in sizes.items():
        shards[sum(g >= c for c in cuts)] += size
    assert max(shards.values()) == capacity


def test_sharding_null_ids_and_repeated_rows(spark):
    df = spark.createDataFrame([(None, "a", 1)] * 3 + [(5, "b", 2)] * 4 + [(5, None, 3), (6, "", 4)], "doc_id long, text string, shard int")
    got = shard_documents(df).collect()
    assert len(got) == 9
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    assert len({r.shard for r in got if r.doc_id is None}) == 1 and len({r.shard for r in got if r.size == 1}) == 1


def test_packing(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(P.default_tokenizer())
    r = random.Random(6)
    texts = [None, "", "Ça va? Don't 'scar it's <|endoftext|> ÉCOLE İx ΑΣ é é 12a_b!!'s", "word " * 9000] + [" ".join(r.choice(["alpha", "Beta,", "the", "ofthe"]) for _ in range(r.randrange(1, 3000))) for _ in range(60)]
    got = pack_documents(frame(spark, texts)).collect()
    by = defaultdict(list)
    seq = defaultdict(list)
    for row in got:
        by[row.doc_id].append(row)
        seq[row.sequence_id].append(row)
    total = 0
    for k, t in enumerate(texts):
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        total += len(ids)
        parts = [(p // 4096, p, len(ids[p : p + 4096]), zlib.crc32(ids[p : p + 4096].tobytes())) for p in range(0, len(ids), 4096)]
        assert sorted((x.piece, x.start, x.length, x.ids_crc32) for x in by[k]) == parts
    for rows in seq.values():
        at = 0
        for x in sorted(rows, key=lambda x: x.offset):
            assert x.offset == at
            at += x.length
        assert at <= 4096
    assert len(seq) <= -(-total // 4096) * 1.1 + 1
    assert pack_documents(frame(spark, texts).limit(0)).count() == 0


def test_packing_plan_uses_every_piece():
    r = random.Random(7)
    hist = {k: r.randrange(1, 60) for k in r.sample(range(1, 4097), 900)}
    plan = P.packing_plan(hist)
    used = defaultdict(int)
    for content, n in plan:
        assert sum(content) <= 4096
        for s in content:
            used[s] += n
    assert dict(used) == hist
    assert sum(n for _, n in plan) <= 1.003 * sum(n for _, n in P.best_fit(hist, 4096))  # a histogram with more than half of its pieces over half a sequence
