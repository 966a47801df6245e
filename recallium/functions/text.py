"""Text scalars: slots, names, patterns, coercions, evaluation checks."""

from __future__ import annotations

import hashlib
import json
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

CONTENT_CAP = 10_000
CUT_MARK = "\n\n[import truncated]"
#: Words that make a query need its context.
PRONOUNS = ("it", "its", "this", "that", "these", "those", "he", "him", "his", "she", "her", "they", "them", "their", "nó", "chúng", "đó")
#: Vocabularies of the knowledge graph.
ENTITY_TYPES = ("person", "organization", "project", "place", "topic", "event", "document", "date", "product", "technology", "concept", "other")
#: Forms of dates and of capitalised phrases.
DATE_PATTERN = r"\b(?:20\d{2}[-/][01]?\d[-/][0-3]?\d|[0-3]?\d[-/][01]?\d[-/]20\d{2})\b"
PHRASE_PATTERN = r"\b(?:[A-Z][\wÀ-ỹ]+|[A-Z]{2,})(?:\s+(?:[A-Z][\wÀ-ỹ]+|[A-Z]{2,}|\d+)){0,3}\b"
#: Forms of citations.
CITATIONS = (r"\[source\s*\d+\]", r"\(source:\s*[^)]+\)", r"source\s*:\s*\S+")

#: Phrases of an answer that has found nothing.
FALLBACKS = ("i don't know", "i do not know", "i don't recall", "don't recall", "không tìm thấy", "không có thông tin", "outside the available support documentation", "outside what you've stored with", "don't have information", "cannot answer")


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def normalise_slot(c: Column) -> Column:
    """Trimmed, lower case, inner white space as one space; null counts as empty."""
    return F.lower(squeeze(F.coalesce(c, F.lit(""))))


def slot_key(subject: Column, attribute: Column, scope: Column) -> Column:
    """``subject|attribute|scope`` with an empty scope as ``default``; null if the subject or the attribute is empty."""
    s, a, p = normalise_slot(subject), normalise_slot(attribute), normalise_slot(scope)
    return F.when((s != "") & (a != ""), F.concat_ws("|", s, a, F.when(p == "", "default").otherwise(p)))


def entity_name(c: Column) -> Column:
    return F.left(squeeze(F.coalesce(c, F.lit(""))), F.lit(255))


def vocabulary(c: Column, words: tuple[str, ...], default: str) -> Column:
    v = F.replace(F.lower(F.trim(F.coalesce(c, F.lit(default)))), F.lit(" "), F.lit("_"))
    return F.when(v.isin(*words), v).otherwise(default)


def dates(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(DATE_PATTERN), F.lit(0))


def phrases(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit("(?U)" + PHRASE_PATTERN), F.lit(0))


def needs_rewrite(c: Column) -> Column:
    """Whether a word of the text is a pronoun as written: a capitalised one is none."""
    return F.arrays_overlap(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit("(?i)[a-zà-ỹ]+"), F.lit(0)), F.array(*map(F.lit, PRONOUNS)))


def cap_content(c: Column, n: int = CONTENT_CAP) -> Column:
    """At most n characters, the mark of a cut included."""
    return F.when(F.length(c) > n, F.concat(F.left(c, F.lit(n - len(CUT_MARK))), F.lit(CUT_MARK))).otherwise(c)


def clip(c: Column, n: int) -> Column:
    """Stripped and cut; empty becomes null."""
    t = F.regexp_replace(c, r"^\s+|\s+$", "")
    return F.when(t != "", F.left(t, F.lit(n)))


def to_utc(c: Column, now: Column) -> Column:
    """Epoch seconds above 0 or ISO 8601 text as a UTC timestamp; a text without zone is UTC; else ``now``."""
    epoch = F.expr("cast(null as double)") if c is None else F.try_to_number(c, F.lit("999999999999.999999")).cast("double")
    return F.coalesce(F.when(epoch > 0, F.timestamp_seconds(epoch)), F.when(epoch.isNull(), F.try_to_timestamp(F.trim(c))), now)


def llm_json(c: Column) -> Column:
    """The object inside a model's answer: a fenced block if there is one, then from the first brace to the last."""
    fenced = F.regexp_extract(c, r"(?s)```(?:json)?\s*(.*?)```", 1)
    body = F.trim(F.when(fenced != "", fenced).otherwise(c))
    braces = F.regexp_extract(body, r"(?s)\{.*\}", 0)
    return F.when(braces != "", braces).otherwise(body)


def coerce_bool(c: Column, default: bool) -> Column:
    v = F.lower(F.trim(c.cast("string")))
    return F.when(v.isin("true", "yes", "y", "1"), True).when(v.isin("false", "no", "n", "0"), False).otherwise(default)


def coerce_float(c: Column, default: float, low: float | None = None, high: float | None = None) -> Column:
    out = F.coalesce(c.try_cast("double"), F.lit(default))
    if low is not None:
        out = F.greatest(out, F.lit(low))
    return out if high is None else F.least(out, F.lit(high))


def merge_aliases(old: Column, new: Column, most: int = 20) -> Column:
    return F.slice(F.array_distinct(F.concat(old, new)), 1, most)


def last_reasons(a: Column, n: int = 5) -> Column:
    return F.when(F.size(a) > n, F.slice(a, -n, n)).otherwise(a)


def should_compress(enabled: bool, c: Column, least: int = 2000) -> Column:
    return F.lit(enabled) & (F.length(c) >= least)


def accept_compression(before: Column, after: Column) -> Column:
    """An answer that is empty or no shorter is refused."""
    return F.when((F.length(F.trim(after)) > 0) & (F.length(after) < F.length(before)), after).otherwise(before)


def outbox_backoff(attempts: Column, base: int = 60, most: int = 3600) -> Column:
    return F.least(F.lit(base) * F.pow(F.lit(2.0), attempts - 1), F.lit(float(most)))


def retry_delay(attempt: Column, retry_after: Column, base: float = 1.0, most: float = 60.0) -> Column:
    """The server's wait if it names one, else capped exponential growth, without its jitter."""
    return F.least(F.coalesce(retry_after, F.lit(base) * F.pow(F.lit(2.0), attempt)), F.lit(most))


def normalise(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"\s+", " "))


def is_fallback(answer: Column, more: tuple[str, ...] = ()) -> Column:
    """Whether an answer says that there is none; ``more`` are markers of one's own product, in lower case."""
    out = F.lit(False)
    for m in (*FALLBACKS, *more):
        out = out | F.contains(normalise(answer), F.lit(m))
    return out


def fallback_accuracy(expected: Column, answer: Column, more: tuple[str, ...] = ()) -> Column:
    """1 if the answer fell back exactly when it should have, else 0."""
    return (is_fallback(answer, more) == expected).cast("double")


def keyword_coverage(text: Column, keywords: Column) -> Column:
    kept = F.filter(keywords, lambda k: F.coalesce(k, F.lit("")) != "")
    hits = F.filter(kept, lambda k: F.contains(normalise(text), normalise(k)))
    return F.when(F.size(kept) == 0, 1.0).otherwise(F.size(hits) / F.size(kept))


def source_hit(returned: Column, expected: Column) -> Column:
    """Share of expected sources that contain, or are contained in, a returned one."""
    clean = lambda a: F.array_distinct(F.transform(F.filter(a, lambda x: F.coalesce(x, F.lit("")) != ""), normalise))
    exp, got = clean(expected), clean(returned)
    hits = F.filter(exp, lambda e: F.exists(got, lambda s: F.contains(s, e) | F.contains(e, s)))
    return F.when(F.size(exp) == 0, 1.0).when(F.size(got) == 0, 0.0).otherwise(F.size(hits) / F.size(exp))


def has_citation(answer: Column, sources: Column | None = None) -> Column:
    out = F.lit(False)
    for p in CITATIONS:
        out = out | F.rlike(F.coalesce(answer, F.lit("")), F.lit("(?i)" + p))
    return out if sources is None else out | (F.coalesce(F.size(sources), F.lit(0)) > 0)


def word_match(haystack: Column, needle: Column) -> Column:
    """Whether the needle stands between word boundaries, ignoring case."""
    return F.rlike(F.lower(haystack), F.concat(F.lit(r"(?U)(?<!\w)\Q"), F.lower(needle), F.lit(r"\E(?!\w)")))


def canonical_token(settings: dict[str, Any]) -> str:
    """SHA-256 of the settings as JSON with sorted keys."""
    return hashlib.sha256(json.dumps(settings, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


def generation_name(prefix: str, settings: dict[str, Any]) -> str:
    return f"{prefix}_{canonical_token(settings)[:8]}"


def cache_key(*parts: str) -> str:
    """Length-prefixed, so no two lists of parts share a key."""
    return hashlib.sha256("".join(f"{len(p)}:{p}" for p in parts).encode()).hexdigest()


def cache_key_of(*parts: Column) -> Column:
    """``cache_key`` of each row; a null part is empty. Lengths are in characters."""
    text = [F.coalesce(p.cast("string"), F.lit("")) for p in parts]
    return F.sha2(F.concat(*[F.concat(F.length(t).cast("string"), F.lit(":"), t) for t in text]), 256)


def benchmark_date(c: Column) -> Column:
    """Dates like ``2023/05/20 (Sat) 02:21``; malformed ones are null."""
    g = lambda k: F.regexp_extract(c, r"^(\d{4})[/-](\d{2})[/-](\d{2})(?:\s*\([A-Za-z]+\))?\s+(\d{2}):(\d{2})", k)
    return F.try_to_timestamp(F.concat(g(1), F.lit("-"), g(2), F.lit("-"), g(3), F.lit(" "), g(4), F.lit(":"), g(5)), F.lit("yyyy-MM-dd HH:mm"))


