"""Filter language, lifecycle state and visibility as Column builders."""

from __future__ import annotations

from datetime import date, datetime, timezone
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The fields that a filter may name, and its operators.
FIELDS = ("source_type", "captured_at", "salience", "pinned", "tags")
OPERATORS = ("$eq", "$ne", "$gt", "$gte", "$lt", "$lte", "$in", "$nin", "$contains")
_RANGES = {"$gt": "__gt__", "$gte": "__ge__", "$lt": "__lt__", "$lte": "__le__"}
_RANGE_FIELDS = ("captured_at", "salience")


def _instant(field: str, value: Any) -> datetime:
    if isinstance(value, str):
        try:
            value = datetime.fromisoformat(value.replace("Z", "+00:00"))
        except ValueError as e:
            raise ValueError(f"{field}: {value!r} is no ISO 8601 timestamp") from e
    elif isinstance(value, date) and not isinstance(value, datetime):
        value = datetime(value.year, value.month, value.day, tzinfo=timezone.utc)
    if not isinstance(value, datetime) or value.tzinfo is None:
        raise ValueError(f"{field} needs a timestamp with a time zone, not {value!r}")
    return value.astimezone(timezone.utc)


def _equals(field: str, value: Any) -> Column:
    if isinstance(value, float):
        raise ValueError(f"{field}: equality on a float is not offered, use a range")
    if not isinstance(value, (bool, int, str)):
        raise ValueError(f"{field} needs a scalar, not {type(value).__name__}")
    return F.array_contains(field, value) if field == "tags" else F.col(field) == F.lit(value)


def _condition(field: str, op: str, value: Any) -> Column:
    if op in _RANGES:
        if field not in _RANGE_FIELDS:
            raise ValueError(f"{field} has no ranges")
        if field == "captured_at":
            bound = F.lit(_instant(field, value).replace(tzinfo=None)).cast("timestamp_ntz")
        else:
            try:
                bound = F.lit(float(value))
            except (TypeError, ValueError) as e:
                raise ValueError(f"{field} needs a number") from e
        return getattr(F.col(field), _RANGES[op])(bound)
    if op in ("$in", "$nin"):
        if not isinstance(value, (list, tuple, set)):
            raise ValueError(f"{field} {op} needs a list")
        values = list(value)
        if not values:
            return F.lit(False)
        return F.arrays_overlap(field, F.array(*map(F.lit, values))) if field == "tags" else F.col(field).isin(values)
    return _equals(field, value)


def build_filter(user_id: Any, where: dict[str, Any] | None = None) -> Column:
    """The tenant's clause and the caller's: one operator per field, a bare value means equality.

    ``$ne`` and ``$nin`` keep rows where the field is absent. Unknown fields or operators, ranges on other fields, float
    equality and naive timestamps raise ``ValueError`` before any plan is built.
    """
    out = F.col("user_id") == F.lit(user_id)
    if where is None:
        return out
    if not isinstance(where, dict):
        raise ValueError("filters must be a mapping")
    for field, value in where.items():
        if field not in FIELDS:
            raise ValueError(f"{field} cannot be filtered on")
        op = "$eq"
        if isinstance(value, dict):
            if len(value) != 1:
                raise ValueError(f"{field} needs exactly one operator")
            op, value = next(iter(value.items()))
        if op not in OPERATORS:
            raise ValueError(f"unknown operator {op}")
        c = _condition(field, op, value)
        out = out & (F.coalesce(~c, F.lit(True)) if op in ("$ne", "$nin") else c)
    return out


def chunk_scope(user_id: Any, conversation_id: Any, document_id: Any = None) -> Column:
    """Chunks of one conversation of one user, or of one document of it. Empty tenants are refused."""
    if user_id in (None, "") or conversation_id in (None, ""):
        raise ValueError("chunks are only read for a user and a conversation")
    out = (F.col("user_id") == F.lit(user_id)) & (F.col("conversation_id") == F.lit(conversation_id))
    return out if document_id is None else out & (F.col("document_id") == F.lit(document_id))


def state(superseded_by: str = "superseded_by", dirty: str = "dirty", needs_check: str = "needs_check") -> Column:
    """Lifecycle state by truth of the markers; superseded before dirty before needs-check."""
    true = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).isin("", "false", "0") == F.lit(False)
    return F.when(true(superseded_by), "superseded").when(true(dirty), "dirty").when(true(needs_check), "needs-check").otherwise("current")


def state_by_presence(superseded_by: str = "superseded_by", dirty: str = "dirty", needs_check: str = "needs_check") -> Column:
    """The same by presence of the markers' keys: a false marker counts."""
    return F.when(F.col(superseded_by).isNotNull(), "superseded").when(F.col(dirty).isNotNull(), "dirty").when(F.col(needs_check).isNotNull(), "needs-check").otherwise("current")


def not_dirty(dirty: str = "dirty") -> Column:
    """What list views show."""
    return F.col(dirty).isNull()


def current_only(superseded_by: str = "superseded_by", dirty: str = "dirty") -> Column:
    """What recall and context show."""
    return F.col(superseded_by).isNull() & F.col(dirty).isNull()


def list_filter(source_type: str | None = None, pinned: bool | None = None, tag: str | None = None, q: str | None = None) -> Column:
    """Predicates of a list view; ``q`` is a case-insensitive pattern (its % and _ are wildcards) on title or content."""
    out = F.lit(True)
    if source_type is not None:
        out = out & (F.col("source_type") == source_type)
    if pinned is not None:
        out = out & (F.col("pinned") == F.lit(pinned))
    if tag is not None:
        out = out & F.array_contains("tags", tag)
    if q:
        out = out & (F.col("title").ilike(f"%{q}%") | F.col("content").ilike(f"%{q}%"))
    return out


def sort_keys(sort: str) -> list[Column]:
    """``newest``, ``salience`` or ``last_used``; the id closes every order."""
    first = {"newest": "captured_at", "salience": "salience", "last_used": "last_used_at"}[sort]
    return [F.col(first).desc_nulls_last(), F.col("id").asc()]


def snippet(c: Column, n: int = 160) -> Column:
    """At most n characters; what is cut ends in an ellipsis after its trailing space is gone."""
    return F.when(F.length(c) > n, F.concat(F.rtrim(F.left(c, F.lit(n))), F.lit("…"))).otherwise(c)


def document_text(title: Column, content: Column) -> Column:
    """The text that is embedded."""
    return F.when(F.coalesce(F.trim(title), F.lit("")) != "", F.concat(F.lit("Title: "), title, F.lit("\n"), F.coalesce(content, F.lit("")))).otherwise(F.coalesce(content, F.lit("")))


def context_line(captured_at: Column, title: Column, content: Column, n: int = 120) -> Column:
    """``YYYY-MM-DD title: content`` with the content's first n characters on one line."""
    body = F.replace(F.coalesce(content, F.lit("")), F.lit("\n"), F.lit(" "))
    cut = F.when(F.length(body) > n, F.concat(F.left(body, F.lit(n)), F.lit("..."))).otherwise(body)
    day = F.coalesce(F.date_format(captured_at, "yyyy-MM-dd"), F.lit("????-??-??"))
    name = F.when(F.coalesce(title, F.lit("")) == "", "(untitled)").otherwise(title)
    return F.concat(day, F.lit(" "), name, F.lit(": "), cut)
