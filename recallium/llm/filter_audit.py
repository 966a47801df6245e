"""Filter interaction audit (op 12): what each quality filter removes, in every order of the filters.

Native expressions turn each document into the set of filters that it fails, written as their letters (the five-bit
mask). Copies are found by one partial aggregation of text digests to the least id. The documents are then counted in
at most 32 cells per part, and all orders are enumerated from those cells: no document is looked at again.

Nulls: a null text is empty, a null part is the empty string, a row with a null id never counts as a copy and has no
label. Rows that repeat the least id of a text are no copies of each other. A label row repeated for an id counts once,
and a document is good (or toxic) if any of its label rows says so. An empty table gives no rows. Columns of the input
besides the four named ones are ignored.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD_SPLIT, Scratch, text_of

COPY = "E"


def conditions() -> dict[str, Column]:
    """Failure conditions over ``t`` (text) and ``w`` (its words), by letter. They are fixed by the contract."""
    capitals = F.length("t") - F.length(F.regexp_replace("t", "[A-Z]+", ""))
    return {
        "A": F.size("w") < 200,
        "B": 100 * F.size(F.array_distinct("w")) < 50 * F.size("w"),
        "C": 100 * capitals > 3 * F.length("t"),
        "D": F.col("t").rlike("[#$%&*|]"),
    }


def failure_masks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang", scratch: Scratch | None = None) -> DataFrame:
    """Per row: ``i`` (id), ``part``, ``fails`` (letters of the failed filters in order), ``first`` (not a copy).

    Texts are equal when their lengths and SHA-256 digests are. Each digest has one least id, and that row is found
    again by id and digest, so a text that a third of all rows hold is never gathered.
    """
    scratch = scratch or Scratch(docs.sparkSession, "masks")
    src = docs.select(F.col(id_col).alias("i"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text_of(text_col).alias("t"))
    src = src.withColumn("b", F.btrim("t", F.lit(" \t\n\x0b\x0c\r"))).withColumn("w", F.when(F.col("b") == "", F.array().cast("array<string>")).otherwise(F.split("b", WORD_SPLIT)))
    letters = F.concat(*[F.when(fails, letter).otherwise("") for letter, fails in conditions().items()])
    digest = F.concat_ws("/", F.length("t").cast("string"), F.sha2(F.encode("t", "UTF-8"), 256))
    rows = scratch.cut(src.select("i", "part", letters.alias("fails"), digest.alias("h")))
    least = rows.filter("i is not null").groupBy("h").agg(F.min("i").alias("i")).withColumn("_first", F.lit(True))
    marked = rows.join(least, ["i", "h"], "left")
    first = F.col("_first").isNotNull() | F.col("i").isNull()
    return marked.select("i", "part", F.concat("fails", F.when(first, "").otherwise(COPY)).alias("fails"), first.alias("first"))


def mask_cells(masks: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Documents per (part, fails): ``n``, ``good`` (quality 1), ``toxic`` (toxic 1)."""
    marks = labels.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("i")).agg(
        F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("q"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("x"))
    return masks.join(marks, "i", "left").groupBy("part", "fails").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("q", F.lit(0))).alias("good"), F.sum(F.coalesce("x", F.lit(0))).alias("toxic"))


def order_report(cells: DataFrame, letters: str = "ABCDE") -> DataFrame:
    """Every order and step from the cells: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    A filter removes a document in an order if it comes before all others that the document fails, hence in an equal
    share of all orders: the sum over orders needs only the number of failed filters.
    """
    orders = ["".join(p) for p in permutations(letters)]
    every = cells.withColumn("filter_order", F.explode(F.array(*map(F.lit, orders)))).withColumn("step", F.explode(F.array(*[F.lit(k + 1) for k in range(len(letters))])))
    every = every.withColumn("_f", F.expr("substring(filter_order, step, 1)")).withColumn("_before", F.expr("substring(filter_order, 1, step - 1)"))
    here = F.contains("fails", "_f")
    gone = F.expr("length(translate(_before, fails, '')) < length(_before)")
    total = lambda when, what="n": F.sum(F.when(when, F.col(what)).otherwise(0)).cast("long")
    share = F.when(here, F.expr(f"n * ({len(orders)} div length(fails))")).otherwise(0)
    return every.groupBy("part", "filter_order", "step").agg(
        total(~here & ~gone).alias("kept"), total(here & ~gone).alias("removed"), total(here & gone).alias("redundant"), total(F.col("fails") == F.col("_f")).alias("unique_fails"),
        total(here & ~gone, "good").alias("good_lost"), total(here & ~gone, "toxic").alias("toxic_lost"), F.sum(share).cast("long").alias("shapley"))


def filter_audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """The report over all documents: one row per part, order and step, zeros included."""
    scratch = Scratch(docs.sparkSession, "audit")
    cells = scratch.cut(mask_cells(failure_masks(docs, id_col, text_col, part_col, scratch), labels, id_col))
    return order_report(cells)
