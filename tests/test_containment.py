"""Containment of items in texts, against a plain search of each text."""

from __future__ import annotations

import random

from recallium.operators.relational import contained_items


def test_contained_items(spark):
    r = random.Random(5)
    word = lambda: r.choice(["a", "ab", "b", "ba", "abc"])
    docs = [(k, " ".join(word() for _ in range(r.randint(0, 60)))) for k in range(60)] + [(7, "a b ab ba abc"), (7, "a b ab ba abc"), (None, "ab ba abc a b a"), (99, None), (100, "")]
    items = [(k, " ".join(word() for _ in range(r.randint(1, 8)))) for k in range(50)] + [(3, "b ab b"), (200, None), (201, "ba abc a b a"), (201, "ba abc a b a"), (202, "")]
    for _, t in docs[:20]:
        lo = r.randint(0, max(0, len(t) - 20))
        piece = " ".join(t[lo : lo + 20].split())  # begins and ends inside words
        items.append((len(items) + 300, piece))
    got = contained_items(spark.createDataFrame(docs, "d long, t string"), spark.createDataFrame(items, "i long, b string"), "d", "t", "i", "b").collect()
    want = [(d, i) for d, t in docs for i, b in items if t is not None and b is not None and b in t]
    key = lambda p: (p[0] is None, p[0] or 0, p[1])
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_contained_items_without_rows(spark):
    none = spark.createDataFrame([], "d long, t string")
    some = spark.createDataFrame([(1, "a b c d e f")], "d long, t string")
    assert contained_items(none, some.toDF("i", "b"), "d", "t", "i", "b").count() == 0
    assert contained_items(some, none.toDF("i", "b"), "d", "t", "i", "b").count() == 0
