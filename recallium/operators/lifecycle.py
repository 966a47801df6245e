"""Corrections, index outbox, contracts, retry routing, forgetting checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recallium.functions.filters import state
from recallium.functions.text import slot_key

MAX_RETRIES = 2


def _is_iso(c: Column) -> Column:
    """Whether a text is an ISO date, or one with a time and perhaps a zone."""
    form = r"^\d{4}-?\d{2}-?\d{2}([T ]\d{2}(:?\d{2}(:?\d{2}([.,]\d+)?)?)?(Z|[+-]\d{2}(:?\d{2}(:?\d{2})?)?)?)?$"
    day = F.regexp_replace(F.regexp_extract(c, r"^(\d{4}-?\d{2}-?\d{2})", 1), "-", "")
    hour, minute, second = (F.coalesce(F.regexp_extract(c, rf"^[\d-]{{8,10}}[T ]{p}", 1).try_cast("int"), F.lit(0)) for p in (r"(\d{2})", r"\d{2}:?(\d{2})", r"\d{2}:?\d{2}:?(\d{2})"))
    return F.rlike(c, F.lit(form)) & F.try_to_timestamp(F.nullif(day, F.lit("")), F.lit("yyyyMMdd")).isNotNull() & (hour < 24) & (minute < 60) & (second < 60)


def decide_corrections(memories: DataFrame, corrections: DataFrame) -> DataFrame:
    """One batch, one correction per slot: ``added``, ``superseded`` or ``needs-check``, with the ids that match.

    Both sides have user_id, subject, attribute, scope, assertion; corrections also correction_id and may have
    target_id and valid_from; one that is no ISO time supersedes nothing and needs a check. Superseded memories are no
    candidates. Matches are counted per correction before anything is gathered.
    """
    key = lambda: slot_key(F.col("subject"), F.col("attribute"), F.col("scope"))
    live = memories.filter(state() != "superseded").select("user_id", F.col("id").alias("mid"), F.coalesce("assertion", F.lit("fact")).alias("massert"), key().alias("slot")).filter("slot is not null")
    c = corrections.withColumn("slot", key()).withColumn("stem", F.regexp_replace("slot", r"\|[^|]*$", "")).withColumn("scoped", F.trim(F.coalesce("scope", F.lit(""))) != "")
    dated = "valid_from" in corrections.columns
    c = c.withColumn("malformed", F.coalesce((F.col("valid_from") != "") & ~_is_iso(F.col("valid_from")), F.lit(False)) if dated else F.lit(False))
    exact = c.join(live, ["user_id", "slot"]).groupBy("correction_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("massert") != F.coalesce("assertion", F.lit("fact"))).alias("clash"), F.count_if(F.col("mid") == F.col("target_id")).alias("hit"))
    other = c.join(live.withColumn("stem", F.regexp_replace("slot", r"\|[^|]*$", "")).withColumnRenamed("slot", "mslot"), ["user_id", "stem"]).filter("mslot <> slot").select("correction_id").distinct().withColumn("near", F.lit(True))
    fits = (F.col("clash") == 0) & (F.col("target_id").isNull() | (F.col("hit") > 0))
    status = F.when(F.col("slot").isNull(), "added").when((F.col("n") > 0) & F.col("malformed"), "added").when(F.col("n") > 0, F.when(fits, "superseded").otherwise("needs-check")).when(F.coalesce("near", F.lit(False)) & ~F.col("scoped"), "needs-check").otherwise("added")
    return c.join(exact, "correction_id", "left").join(other, "correction_id", "left").select("correction_id", "user_id", "slot", F.coalesce("n", F.lit(0)).alias("matches"), status.alias("status"), *([(F.col("malformed") | (status == "needs-check")).alias("needs_check")] if dated else []))


def apply_corrections(memories: DataFrame, decisions: DataFrame) -> DataFrame:
    """Rows after the batch: exact matches superseded by their correction, dependents one hop away dirty. Of several
    corrections of one slot the one with the largest id counts. Rows superseded before the batch are left alone."""
    hits = decisions.filter("status = 'superseded'").groupBy("user_id", "slot").agg(F.max("correction_id").alias("_by"))
    keyed = memories.withColumn("slot", slot_key(F.col("subject"), F.col("attribute"), F.col("scope"))).join(hits, ["user_id", "slot"], "left")
    is_hit = F.col("_by").isNotNull() & (state() != "superseded")
    marked = keyed.withColumn("_hit", is_hit)
    gone = marked.filter("_hit").select("user_id", F.col("id").alias("dep"))
    deps = marked.select("user_id", "id", F.explode("derived_from").alias("dep")).join(gone, ["user_id", "dep"], "left_semi").select("id").distinct().withColumn("_dep", F.lit(True))
    out = marked.join(deps, "id", "left")
    return (out.withColumn("_dirty", F.coalesce("_dep", F.lit(False)) & ~F.col("_hit") & ~state().isin("dirty", "superseded"))
            .withColumn("superseded_by", F.when(F.col("_hit"), F.col("_by").cast("string")).otherwise(F.col("superseded_by").cast("string")))
            .withColumn("dirty", F.when(F.col("_dirty"), True).otherwise(F.col("dirty"))).drop("_by", "_hit", "_dep", "_dirty"))


def supersede_links(memories: DataFrame) -> DataFrame:
    """(id, supersedes): each link of the chains, a scalar or a list alike."""
    return memories.filter(F.col("supersedes").isNotNull()).select("id", F.explode("supersedes").alias("supersedes"))


def drain(outbox: DataFrame, memories: DataFrame, generations: DataFrame, now: Column, batch: int = 50) -> DataFrame:
    """The due pending intents in order with what each comes to: blocked, skipped, delete or upsert."""
    due = outbox.filter((F.col("status") == "pending") & (F.col("next_attempt_at").isNull() | (F.col("next_attempt_at") <= now))).orderBy("seq").limit(batch)
    g = generations.select("kind", F.col("generation").alias("_g"))
    m = memories.select(F.col("id").alias("entity_id"), F.col("revision").alias("_r"))
    outcome = (F.when(~F.col("kind").isin("memory", "chunk") | ~F.col("target_generation").eqNullSafe(F.col("_g")), "blocked").when(F.col("_r").isNull(), "delete")
               .when(F.col("revision") < F.col("_r"), "skipped").when(F.col("operation") == "delete", "delete").otherwise("upsert"))
    return due.join(F.broadcast(g), "kind", "left").join(m, "entity_id", "left").withColumn("outcome", outcome).drop("_g", "_r")


#: What makes an intent unique.
INTENT_KEY = ["kind", "entity_id", "revision", "operation", "target_generation"]


def enqueue(outbox: DataFrame, intents: DataFrame) -> DataFrame:
    """New intents only, each once."""
    return intents.dropDuplicates(INTENT_KEY).join(outbox.select(*INTENT_KEY), INTENT_KEY, "left_anti")


def check_contract(claimed: dict | None, offered: dict, populated: bool) -> None:
    """Refuse to mix vectors of different contracts; an index with rows but no claim is refused too."""
    if claimed is None:
        if populated:
            raise ValueError("the index holds rows but states no contract")
        return
    for k in ("dim", "metric", "token"):
        if claimed.get(k) != offered.get(k):
            raise ValueError(f"contract mismatch in {k}: {claimed.get(k)!r} and {offered.get(k)!r}")


def route_after_documents() -> Column:
    c = F.col
    done = (c("query_type") != "rag") | ~c("has_context") | F.coalesce(c("context_relevant"), F.lit(True)) | ~F.coalesce(c("has_documents"), F.lit(False))
    return F.when(done, "answer").when(F.coalesce(c("retry_count"), F.lit(0)) < MAX_RETRIES, "retry_retrieval_for_irrelevant_context").otherwise("record_irrelevant_context_retry_limit")


def route_after_generation() -> Column:
    c = F.col
    made_up = F.coalesce(c("is_hallucination"), F.lit(False))
    good = (c("query_type") != "rag") | ~c("has_context") | (~made_up & F.coalesce(c("answers_question"), F.lit(True)))
    return F.when(good, "save").when(F.coalesce(c("retry_count"), F.lit(0)) >= MAX_RETRIES, "record_generation_retry_limit").when(made_up, "retry_answer_for_hallucination").otherwise("retry_retrieval_for_unanswered_question")


def forgetting_check(before: DataFrame, after: DataFrame, answers: DataFrame) -> DataFrame:
    """Per question: what had to stay is still found and what had to go is not."""
    kept = after.select("turn_id").withColumn("_k", F.lit(True))
    t = before.join(kept, "turn_id", "left").join(answers, "question_id")
    wrong = F.count_if(F.col("forget") & F.coalesce("_k", F.lit(False)))
    lost = F.count_if(~F.col("forget") & F.col("_k").isNull())
    return t.groupBy("question_id").agg(wrong.alias("not_forgotten"), lost.alias("lost")).withColumn("passed", (F.col("not_forgotten") == 0) & (F.col("lost") == 0))
