"""Parent and child chunks of documents, turn-aligned packs of conversations."""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator
from itertools import groupby, pairwise

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recallium.functions.text import squeeze

PARENT, PARENT_OVERLAP, CHILD, CHILD_OVERLAP = 1500, 150, 400, 50
#: Headings and separators.
_HEADING = re.compile(r"(?m)^#{2,4}\s+\S")
_SECTION = re.compile(r"(?m)(?=^#{2,4}\s)")
_STEPS = [re.compile(p) for p in (r"\n\n", r"\n", r"(?<=[.!?])\s+", r" ")]


def sections(text: str) -> list[str]:
    """Sections that start with a heading of level two to four; text before the first is dropped."""
    return [p.strip() for p in _SECTION.split(text) if re.match(r"#{2,4}\s", p.strip())]


def _parts(text: str, level: int) -> tuple[list[str], int]:
    """``text`` cut before each match of the first separator from ``level`` on that it has; else its characters."""
    for k in range(level, len(_STEPS)):
        starts = [m.start() for m in _STEPS[k].finditer(text)]
        if starts:
            edges = [0, *starts, len(text)]
            return [text[i:j] for i, j in pairwise(edges) if i < j], k + 1
    return list(text), len(_STEPS) + 1


def _merged(parts: list[str], size: int, overlap: int) -> Iterator[str]:
    """Neighbouring parts joined up to ``size``; the next chunk begins with the last parts that ``overlap`` holds."""
    window: deque[str] = deque()
    total = 0
    for p in parts:
        if window and total + len(p) > size:
            yield "".join(window)
            while window and (total > overlap or total + len(p) > size):
                total -= len(window.popleft())
        window.append(p)
        total += len(p)
    if window:
        yield "".join(window)


def _chunks(text: str, size: int, overlap: int, level: int = 0) -> Iterator[str]:
    parts, deeper = _parts(text, level)
    for short, run in groupby(parts, key=lambda p: len(p) < size or deeper > len(_STEPS)):
        if short:
            yield from _merged(list(run), size, overlap)
        else:
            for p in run:
                yield from _chunks(p, size, overlap, deeper)


def split_recursive(text: str, size: int, overlap: int) -> list[str]:
    """Chunks of at most ``size`` characters, each beginning with up to ``overlap`` of the one before.

    The coarsest separator that the text has cuts it, and stays with the piece behind it; pieces of ``size`` or more are cut
    by the finer ones, down to single characters. Pieces of one level that stand together are merged, so a long piece
    between them ends a chunk. Chunks are stripped, and blank ones left out.
    """
    return [c.strip() for c in _chunks(text, size, overlap) if c.strip()] if text else []


def parents(text: str) -> list[str]:
    if not _HEADING.search(text):
        return split_recursive(text, PARENT, PARENT_OVERLAP)
    out: list[str] = []
    for s in sections(text):
        out += [s] if len(s) <= 2 * PARENT else split_recursive(s, PARENT, PARENT_OVERLAP)
    return out


def chunk_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per child: document, parent_index, parent, child_index (through the document), child."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                rows: list[tuple] = []
                for k, t in enumerate(b.column(1).to_pylist()):
                    n = 0
                    for p, parent in enumerate(parents(t or "")):
                        for child in split_recursive(parent, CHILD, CHILD_OVERLAP):
                            rows.append((k, p, parent, n, child))
                            n += 1
                cols = list(zip(*rows, strict=True)) or [()] * 5
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(cols[0], pa.int32())), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.int32()), pa.array(cols[4], pa.string())], [id_col, "parent_index", "parent", "child_index", "child"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, parent_index int, parent string, child_index int, child string")


def pack_turns(turns: DataFrame, size: int, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """Turns of a conversation that have text, in order, in packs of about ``size`` characters; each pack but the first
    starts with the last turn of the one before, whatever its size. One fold per conversation, JVM-side; a
    conversation's turns are its own bound."""
    ordered = turns.filter(F.rlike("text", F.lit(r"(?U)\S"))).groupBy(conv).agg(F.array_sort(F.collect_list(F.struct(turn, F.concat("role", F.lit(": "), "text").alias("line")))).alias("l"))
    start = F.struct(F.array().cast("array<array<int>>").alias("done"), F.array().cast("array<int>").alias("open"), F.lit(0).alias("n"), F.lit(-1).alias("last"), F.lit(0).alias("last_n"))

    def step(s, x):
        n = F.length(x["line"])
        t = x[turn].cast("int")
        full = (F.size(s["open"]) > 0) & (s["n"] + n > size)
        return F.struct(F.when(full, F.concat(s["done"], F.array(s["open"]))).otherwise(s["done"]).alias("done"),
                        F.when(full, F.array(s["last"], t)).otherwise(F.concat(s["open"], F.array(t))).alias("open"),
                        F.when(full, s["last_n"] + n).otherwise(s["n"] + n).alias("n"), t.alias("last"), n.alias("last_n"))

    packs = F.aggregate("l", start, step, lambda s: F.when(F.size(s["open"]) > 0, F.concat(s["done"], F.array(s["open"]))).otherwise(s["done"]))
    return ordered.select(conv, F.posexplode(packs).alias("pack", "turns"))


def session_titles(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", least: int = 24, question: str | None = None) -> DataFrame:
    """The first turn of at least ``least`` characters, white space squeezed, cut to 120; else the conversation's name
    (and its ``question``, a column)."""
    t = turns.select(conv, turn, *([question] if question else []), squeeze(F.coalesce("text", F.lit(""))).alias("x"))
    named = F.concat(F.lit("Conversation "), F.col(conv).cast("string"), *([F.lit(" ("), F.col("q").cast("string"), F.lit(")")] if question else []))
    first = F.min(F.when(F.length("x") >= least, F.struct(turn, "x"))).alias("b")
    g = t.groupBy(conv).agg(first, *([F.first(question, True).alias("q")] if question else []))
    return g.select(conv, F.coalesce(F.left(F.col("b.x"), F.lit(120)), named).alias("title"))
