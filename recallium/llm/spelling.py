r"""Spelling variant grouping (op 13): a rare-first filter of positional bigrams finds words one edit apart.

Words are counted with partial sums. The bigrams of all words are ordered by their frequency over the vocabulary (at
most 90 x 90 of them, by the alphabet). One edit touches at most two bigrams of a word, and the untouched ones keep
their order in both words; so two words one edit apart share a bigram among the three rarest of each. Its position
then decides more than a shift of at most one: the edit lies wholly behind the bigram or wholly before it, so the
words agree in everything up to and with it, or in everything from it on, and their lengths differ by at most one.
Of what is left, one edit leaves the first two letters or the last two. Those limits are the join key; what the join
finds is verified by edit distance.

All joins are by sort and merge: the cut tables are compressed, and the planner takes their size in files for that of
their rows (exploded ones too), so it would broadcast tables that grow with the vocabulary through the driver.

Forms have at least twice the count of their word, so chains of forms are short (a logarithm of the greatest count) and
are followed by pointer doubling.

Null and empty texts have no words. A null id counts as the empty string in the hash. Rows that repeat count each.
An empty table gives no rows. Other columns are ignored. Words of any length are handled whole.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, text_of

#: Fixed by the contract.
RUN_SPLIT = r"[^A-Za-zÀ-ÿ]+"
DROP_EVERY = 97
LEAST_LETTERS = 5
LEAST_COUNT = 3

RAREST = 3  # one edit touches two bigrams of a word
ALPHABET = 26 + 0xFF - 0xC0 + 1


def lower_ascii(col: Column) -> Column:
    """Lower-case A-Z only; the native fast path where a run has nothing else."""
    plain = F.octet_length(col) == F.char_length(col)
    return F.when(plain, F.lower(col)).otherwise(F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n) of all words with enough letters and occurrences; every 97th (document, run) by hash loses a letter."""
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("i"), F.explode(F.split(text_of(text_col), RUN_SPLIT)).alias("r"))
    runs = runs.filter(F.char_length("r") >= LEAST_LETTERS).select("i", lower_ascii(F.col("r")).alias("r"))
    runs = runs.withColumn("h", F.crc32(F.encode(F.concat("i", F.lit(":"), "r"), "UTF-8")))
    at = F.expr("cast(h % char_length(r) as int)")
    cut = F.concat(F.expr("substring(r, 1, cast(h % char_length(r) as int))"), F.substring(F.col("r"), at + 2, F.char_length("r")))
    words = runs.select(F.when(F.col("h") % DROP_EVERY == 0, cut).otherwise(F.col("r")).alias("word"))
    return words.filter(F.char_length("word") >= LEAST_LETTERS).groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= LEAST_COUNT)


def bigram_order(words: DataFrame) -> dict[str, int]:
    """Each bigram's place in the order (rarest first, ties by the bigram). The alphabet bounds it at 8,100 entries."""
    grams = words.select(F.explode(F.expr("transform(sequence(1, char_length(word) - 1), p -> substring(word, p, 2))")).alias("g"))
    rows = grams.groupBy("g").agg(F.count(F.lit(1)).alias("n")).limit(ALPHABET**2 + 1).collect()
    if len(rows) > ALPHABET**2:
        raise ValueError("words hold characters outside the alphabet that bounds the order of bigrams")
    return {g: k for k, (_, g) in enumerate(sorted((r.n, r.g) for r in rows))}


def rarest_positions(order: dict[str, int]) -> Callable:
    """Positions (from 0) of a word's three rarest bigrams; of one bigram the earlier first."""
    def places(words: pd.Series) -> pd.Series:
        out = []
        for w in words:
            found = sorted([(order[w[p : p + 2]], p) for p in range(len(w) - 1)])
            out.append([p for _, p in found[:RAREST]])
        return pd.Series(out)

    return F.pandas_udf(places, "array<int>")


def near_pairs(words: DataFrame, order: dict[str, int]) -> DataFrame:
    """Pairs (a, an, b, bn) of words that differ by one inserted, deleted or replaced code point, each once."""
    at = words.select("word", "n", F.char_length("word").alias("l"), F.explode(rarest_positions(order)("word")).alias("p"))
    side = lambda name, same, rest: F.struct(F.lit(name).alias("side"), F.expr(same).alias("same"), F.expr(rest).alias("rest"))
    sides = F.array(side("<", "substring(word, 1, p + 2)", "substring(word, p + 3)"), side(">", "substring(word, p + 1)", "substring(word, 1, p)"))
    keys = at.select("word", "n", "l", F.explode(sides).alias("k")).select("word", "n", "l", "k.*").withColumn("m", F.char_length("rest"))
    # One edit of a rest of four letters or more leaves its first two or its last two as they are.
    ends = "array(concat('+', left(rest, 2)), concat('-', right(rest, 2)))"
    longer = keys.select(F.col("word").alias("b"), F.col("n").alias("bn"), "l", "side", "same", F.explode(F.expr(f"case when m > 4 then {ends} when m = 4 then array_append({ends}, '') else array('') end")).alias("end"))
    shorter = keys.select(F.col("word").alias("a"), F.col("n").alias("an"), F.col("l").alias("al"), "side", "same", F.explode(F.expr(f"if(m >= 4, {ends}, array(''))")).alias("end")).withColumn("l", F.explode(F.array("al", F.col("al") + 1)))
    one = (F.col("al") < F.col("l")) | (F.col("a") < F.col("b"))
    pairs = shorter.hint("merge").join(longer, ["l", "side", "same", "end"]).filter(one & (F.levenshtein("a", "b", 1) == 1))
    return pairs.select("a", "an", "b", "bn").distinct()


def best_forms(words: DataFrame, pairs: DataFrame) -> DataFrame:
    """(word, n, n_near, form, form_n) of every word."""
    both = pairs.selectExpr("inline(array(struct(a as word, b as o, bn as c), struct(b as word, a as o, an as c)))")
    near = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("c")).alias("c"), F.col("o").alias("o"))).alias("m"))
    rows = words.hint("merge").join(near, "word", "left")
    better = -F.col("m.c") >= 2 * F.col("n")
    return rows.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(better, F.col("m.o")).alias("form"), F.when(better, -F.col("m.c")).alias("form_n"))


def last_forms(forms: DataFrame, scratch: Scratch) -> DataFrame:
    """(word, root) of every word that has a form: each round doubles the steps that a pointer covers."""
    now = scratch.cut(forms.filter("form is not null").select("word", F.col("form").alias("root")))
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        new = scratch.cut(now.hint("merge").join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        scratch.drop(now)
        now = new
        if now.filter("moved").isEmpty():
            return now.select("word", "root")


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per word of the corpus: its form, root, counts and number of near words."""
    scratch = Scratch(docs.sparkSession, "spelling")
    words = scratch.cut(word_counts(docs, id_col, text_col))
    forms = scratch.cut(best_forms(words, near_pairs(words, bigram_order(words))))
    roots = last_forms(forms, scratch)
    return forms.hint("merge").join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
