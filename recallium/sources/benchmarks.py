"""Question sets over long histories: strict loading, turns, answer kinds, reranking by a model of the caller's."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_TURN = "struct<role:string,content:string,has_answer:boolean,forget:boolean>"
#: The shapes of the two question sets.
HISTORY = f"question_id string, question_type string, question string, answer string, question_date string, haystack_session_ids array<string>, haystack_dates array<string>, haystack_sessions array<array<{_TURN}>>, answer_session_ids array<string>"
MEMORY = f"question_id string, competency string, phase string, question string, answer string, sessions array<array<{_TURN}>>, answer_session_ids array<string>"


def _checked(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Fail the read at the first row that breaks a rule, naming it."""
    bad = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), name) for name, ok in rules.items()]))
    message = F.concat(F.lit("question "), F.coalesce("question_id", F.lit("?")), F.lit(": "), F.array_join(bad, ", "))
    return df.withColumn("question_id", F.when(F.size(bad) > 0, F.raise_error(message)).otherwise(F.col("question_id")))


def load_history(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of questions with their histories; malformed JSON and uneven arrays fail."""
    df = spark.read.schema(HISTORY).option("multiLine", True).option("mode", "FAILFAST").json(path)
    n = F.size("haystack_sessions")
    return _checked(df, {"no id": F.length("question_id") > 0, "no question": F.length("question") > 0, "no sessions": n > 0, "session ids do not match": F.size("haystack_session_ids") == n, "dates do not match": F.size("haystack_dates") == n, "answer sessions unknown": F.size(F.array_except("answer_session_ids", "haystack_session_ids")) == 0})


def load_memory(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.schema(MEMORY).option("multiLine", True).option("mode", "FAILFAST").json(path)
    return _checked(df, {"no id": F.length("question_id") > 0, "no sessions": F.size("sessions") > 0, "no competency": F.length("competency") > 0})


def history_turns(questions: DataFrame) -> DataFrame:
    """One row per turn, with its session's id and date (null where the date is malformed)."""
    from recallium.functions.text import benchmark_date

    s = questions.select("question_id", F.posexplode(F.arrays_zip("haystack_session_ids", "haystack_dates", "haystack_sessions")).alias("session", "s"))
    return s.select("question_id", "session", F.col("s.haystack_session_ids").alias("session_id"), benchmark_date(F.col("s.haystack_dates")).alias("at"), F.posexplode("s.haystack_sessions").alias("turn", "t")).select("question_id", "session", "session_id", "at", "turn", "t.*")


def answer_kind(answer: Column) -> Column:
    """``integer``, ``float`` or ``boolean`` by what the whole answer can be read as, else ``text``."""
    a = F.lower(F.trim(F.coalesce(answer, F.lit(""))))
    digits = r"\d+(?:_\d+)*"
    real = rf"[+-]?(?:(?:{digits}\.?(?:{digits})?|\.{digits})(?:e[+-]?{digits})?|inf|infinity|nan)"
    return F.when(a.isin("yes", "no", "true", "false"), "boolean").when(F.rlike(a, F.lit(rf"^[+-]?{digits}$")), "integer").when(F.rlike(a, F.lit(f"^{real}$")), "float").otherwise("text")


def rerank(candidates: DataFrame, query: str, score: Callable[[str, list[str]], list[float]], top: int, text: str = "content") -> DataFrame:
    """The ``top`` candidates by a caller's cross-encoder, called on Arrow batches; the id breaks ties."""
    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        return pd.Series(score(query, texts.fillna("").tolist()))

    return candidates.withColumn("rerank_score", scored(text)).orderBy(F.desc("rerank_score"), F.asc("id")).limit(top)


def usage_upsert(counters: DataFrame, events: DataFrame, keys: list[str], when: str = "ts") -> DataFrame:
    """Counters (keys, n, last_used) after a batch of events; sums and maxima, so batches can come in any order."""
    new = events.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.max(when).alias("last_used"))
    return counters.select(*keys, "n", "last_used").unionByName(new).groupBy(*keys).agg(F.sum("n").alias("n"), F.max("last_used").alias("last_used"))
