"""Exact deduplication by deterministic block naming (op 3), DataFrame functions only.

A text without white space is cut into fixed-size byte blocks. All distinct blocks are sorted and numbered: the
number is the block's *name*. Adjacent names are then paired and the distinct pairs named in the same way, halving
the sequence, until each document has one name. Two documents get the same final name if and only if their
normalised texts are the same bytes; names come from whole blocks and whole pairs, never from a hash.

Block texts cross the network once, pre-aggregated, to be named. They are joined back by digest, which is exact
because a digest that two different blocks share is detected in the table of names, and its rows are joined by the
blocks themselves.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, fresh, strip_space, text_of

BLOCK_BYTES = 2048
AT_ONCE = 1 << 16  # repeated rows that are written out of one array


def _numbered(distinct: DataFrame, *keys: str) -> DataFrame:
    """Distinct rows, sorted inside their hash partition and numbered; the partition is the high part of the name."""
    return distinct.sortWithinPartitions(*keys).withColumn("name", F.monotonically_increasing_id())


def block_names(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES,
                scratch: Scratch | None = None) -> DataFrame:
    """One row per distinct (id, text): ``rk`` (row key), ``level`` and ``name``; (level, name) is the text's identity.

    Null texts count as empty and have one empty block. Null ids are rows like others. Rows repeated with the same
    id and text count once. An empty table gives no rows.
    """
    scratch = scratch or Scratch(docs.sparkSession, "names")
    norm = F.encode(strip_space(F.col("t")), "UTF-8")
    src = docs.select(F.col(id_col).alias("i"), text_of(text_col).alias("t")).select(row_key("i", "t").alias("rk"), norm.alias("b"))
    last = F.greatest(F.lit(0), F.floor((F.octet_length("b") - 1) / block_bytes)).cast("int")
    rows = src.select("rk", (last + 1).alias("blocks"), F.posexplode(F.transform(F.sequence(F.lit(0), last), lambda k: F.substring(F.col("b"), k * block_bytes + 1, F.lit(block_bytes)))).alias("pos", "block"))
    names = scratch.cut(_numbered(rows.select("block").distinct(), "block").select("name", F.md5("block").alias("h")))
    clash = scratch.cut(names.groupBy("h").count().filter("count > 1").select("h"))
    addressed = rows.withColumn("h", F.md5("block"))
    if clash.isEmpty():
        named = addressed.drop("block").join(names, "h").select("rk", "blocks", "pos", "name")
    else:
        first = _numbered(rows.select("block").distinct(), "block").withColumn("h", F.md5("block"))
        again = scratch.cut(first.join(clash, "h", "left_semi"))
        named = (addressed.join(clash, "h", "left_anti").drop("block").join(names, "h").select("rk", "blocks", "pos", "name")
                 .unionByName(addressed.join(clash, "h", "left_semi").join(again.select("block", "name"), "block").select("rk", "blocks", "pos", F.expr("-1 - name").alias("name"))))
    live = scratch.cut(named)
    scratch.drop(names, clash)
    most = live.agg(F.max("blocks")).first()[0] or 1
    done, level = [], 0
    while True:
        width = 1 << level
        done.append(live.filter(F.col("blocks") <= width).select("rk", F.lit(level).alias("level"), "name"))
        if most <= width:
            break
        pairs = (live.filter(F.col("blocks") > width).groupBy("rk", "blocks", F.expr("pos div 2").cast("int").alias("pos"))
                 .agg(F.max(F.expr("if(pos % 2 = 0, name, null)")).alias("a"), F.coalesce(F.max(F.expr("if(pos % 2 = 1, name, null)")), F.lit(-(1 << 62))).alias("b")))
        pairs = scratch.cut(pairs)
        names = scratch.cut(_numbered(pairs.select("a", "b").distinct(), "a", "b"))
        live = scratch.cut(pairs.join(names, ["a", "b"]).select("rk", "blocks", "pos", "name"))
        scratch.drop(pairs, names)
        level += 1
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.distinct()


def row_key(i: str, t: str):
    """Address of a row: its id and its original text. Not used to decide what is equal."""
    return F.concat_ws("/", F.coalesce(F.concat(F.lit("="), F.col(i).cast("string")), F.lit("null")), F.md5(F.encode(F.col(t), "UTF-8")))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``exact_dedup`` per row key ``rk``, with the number ``copies`` of rows that have it."""
    scratch = Scratch(docs.sparkSession, "dedup")
    names = scratch.cut(block_names(docs, id_col, text_col, block_bytes, scratch))
    src = docs.select(F.col(id_col).alias(id_col), text_of(text_col).alias("_t"))
    info = src.select(id_col, row_key(id_col, "_t").alias("rk"), F.length("_t").alias("chars"), F.sha2(F.encode(strip_space(F.col("_t")), "UTF-8"), 256).alias("text_sha256"))
    info = info.groupBy("rk").agg(F.first(id_col).alias(id_col), F.first("chars").alias("chars"), F.first("text_sha256").alias("text_sha256"), F.count(F.lit(1)).alias("copies"))
    rows = scratch.cut(info.join(names, "rk"))
    best = rows.groupBy("level", "name").agg(F.sum("copies").alias("group_size"), F.min(F.struct((-F.col("chars")).alias("c"), F.col(id_col).isNull().alias("z"), F.col(id_col).alias("k"), F.col("rk").alias("r"))).alias("best"))
    best = scratch.cut(best)
    scratch.drop(names)
    return rows.join(best, ["level", "name"]).select(
        F.col(id_col), F.col("best.k").alias("keep_id"), "group_size", (F.col("rk") == F.col("best.r")).alias("kept"), "text_sha256", "rk", "copies")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per row: id, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``. Of rows repeated with id and text one is kept.

    Equal texts (white space deleted) form a group; the row with the most code points in its original text, then the
    smallest id, stays (a null id sorts last). Null texts count as empty; an empty table gives no rows; extra columns
    are ignored.
    """
    keys = exact_groups(docs, id_col, text_col, block_bytes)
    some = keys.withColumn("_a", F.explode(F.expr(f"sequence(0L, (copies - 1) div {AT_ONCE})")))
    every = some.withColumn("_b", F.explode(F.expr(f"sequence(0L, least({AT_ONCE}L, copies - _a * {AT_ONCE}) - 1)")))
    return every.select(id_col, "keep_id", "group_size", (F.col("kept") & (F.col("_a") + F.col("_b") == 0)).alias("kept"), "text_sha256")


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; of rows repeated with id and text, one stays."""
    t, rk = fresh(docs.columns, "_dedup_t"), fresh(docs.columns, "_dedup_rk")
    keyed = docs.withColumn(t, text_of(text_col)).withColumn(rk, row_key(id_col, t))
    gone = exact_groups(docs, id_col, text_col).filter("not kept").select(F.col("rk").alias(rk))
    left = keyed.join(gone, rk, "left_anti")
    if not keyed.groupBy(rk).count().filter("count > 1").isEmpty():
        left = left.dropDuplicates([rk])
    return left.select(*docs.columns)
