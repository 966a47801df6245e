"""The splitter against a plain version of its rules, and the markdown sections."""

from __future__ import annotations

import random
import re

import pytest

from recallium.operators.chunking import parents, split_recursive

SEPARATORS = [r"\n\n", r"\n", r"(?<=[.!?])\s+", r" ", ""]


def plain_merge(parts, size, overlap):
    chunks, now = [], []
    for p in parts:
        if now and sum(map(len, now)) + len(p) > size:
            chunks.append("".join(now))
            while now and (sum(map(len, now)) > overlap or sum(map(len, now)) + len(p) > size):
                now = now[1:]
        now = [*now, p]
    return [*chunks, "".join(now)] if now else chunks


def plain_split(text, size, overlap, seps=SEPARATORS):
    rest = []
    for k, s in enumerate(seps):
        if s == "" or re.search(s, text):
            sep, rest = s, seps[k + 1 :]
            break
    if sep:
        bits = re.split(f"({sep})", text)
        parts = [bits[0]] + [bits[k] + bits[k + 1] for k in range(1, len(bits), 2)]
    else:
        parts = list(text)
    out, good = [], []
    for p in filter(None, parts):
        if len(p) < size:
            good.append(p)
            continue
        out += plain_merge(good, size, overlap)
        good = []
        out += plain_split(p, size, overlap, rest) if rest else [p]
    return out + plain_merge(good, size, overlap)


@pytest.mark.parametrize("seed", range(40))
def test_splitter_against_the_plain_version(seed):
    r = random.Random(seed)
    text = "".join(r.choice(["word ", "a", "longer ", "\n", "\n\n", ". ", "! \n", "?", " ", "é", "x" * r.randint(1, 90)]) for _ in range(r.randint(0, 300)))
    for size, overlap in ((40, 10), (17, 0), (100, 50), (400, 50)):
        want = [c.strip() for c in plain_split(text, size, overlap)] if text else []
        assert split_recursive(text, size, overlap) == [c for c in want if c]


def test_a_run_of_letters_is_cut_with_overlap():
    assert [len(c) for c in split_recursive("q" * 1000, 400, 50)] == [400, 400, 300]
    assert split_recursive("", 400, 50) == [] == split_recursive(" \n\n ", 400, 50)


def test_headings_cut_sections():
    text = "# Title\nintro\n\n## One\nbody one\n\n### Two\nbody two\n\n## Three\n" + "long text. " * 400
    got = parents(text)
    assert got[0] == "## One\nbody one" and got[1].startswith("### Two") and len(got) > 3
    assert all(len(c) <= 1500 for c in got)
