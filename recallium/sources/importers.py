"""Chat and memory exports as DataFrames: detection, parsing, dedup, capping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recallium.functions.text import cap_content, clip, to_utc

FORMATS = ("chatgpt", "claude", "gemini", "copilot", "openclaw", "generic")
ITEM = "title string, content string, source_ref string, source_url string, created string, tags array<string>"


class ImportFormatError(ValueError):
    """The file is not of the format that was asked for or found."""


def read_export(spark: SparkSession, path: str) -> DataFrame:
    """(path, value): each file whole, through Spark's reader."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")


def _j(c: Column | str, path: str) -> Column:
    return F.get_json_object(c, path)


def detect_format(value: Column) -> Column:
    """By the first element of an array or the keys of an object; else ``unknown``."""
    t = F.trim(value)
    is_array = F.startswith(t, F.lit("["))
    keys = F.coalesce(F.json_object_keys(F.when(is_array, _j(t, "$[0]")).otherwise(t)), F.array().cast("array<string>"))
    has = lambda k: F.array_contains(keys, k)
    array = F.when(has("mapping"), "chatgpt").when(has("chat_messages"), "claude").when(has("session_id") & has("memory_entries"), "openclaw").when(has("content"), "generic")
    obj = (F.when(_j(t, "$.schema") == "portable-ai-memory", "generic").when(has("session_id") & F.startswith(F.ltrim(_j(t, "$.entries")), F.lit("[")), "openclaw")
           .when(has("memories") & has("export_version"), "gemini").when(has("memory_entries"), "openclaw").when(has("conversations") & F.contains(F.lower(F.array_join(keys, ",")), F.lit("copilot")), "copilot"))
    return F.coalesce(F.when(is_array, array).otherwise(obj), F.lit("unknown"))


def _strings(value: Column) -> Column:
    """Elements of a JSON array as JSON texts; null if it is none."""
    return F.from_json(value, "array<string>")


def _lines(entries: Column, role: str, texts: tuple[str, ...], users: tuple[str, ...], others: tuple[str, ...] | None, default_role: str | None) -> Column:
    """``User: ...`` and ``Assistant: ...`` of the entries, in order, blank ones left out."""
    def line(e):
        obj = F.when(F.startswith(F.ltrim(e), F.lit("{")), e)
        text = F.coalesce(*[F.when(F.trim(_j(obj, f"$.{t}")) != "", F.trim(_j(obj, f"$.{t}"))) for t in texts], F.when(obj.isNull() & F.lit(default_role is not None), F.trim(e)))
        who = F.lower(F.coalesce(_j(obj, f"$.{role}"), F.lit(default_role or "")))
        label = F.when(who.isin(*users), "User").when(F.lit(True) if others is None else who.isin(*others), "Assistant")
        return F.when(text.isNotNull() & label.isNotNull(), F.concat(label, F.lit(": "), text))

    return F.array_join(F.filter(F.transform(entries, line), lambda x: x.isNotNull()), "\n\n")


def _first(c: Column, *paths: str) -> Column:
    return F.coalesce(*[F.when(_j(c, f"$.{p}") != "", _j(c, f"$.{p}")) for p in paths])


def _text_part(p: Column) -> Column:
    """A part that is a string, stripped; images, files, numbers and nulls are no text."""
    return F.when(F.schema_of_variant(p) == "STRING", F.regexp_replace(F.variant_get(p, "$", "string"), r"(?U)^\s+|\s+$", ""))


def _chatgpt(e: Column) -> dict[str, Column]:
    nodes = F.map_values(F.from_json(_j(e, "$.mapping"), "map<string,string>"))
    turns = F.transform(nodes, lambda n, i: F.struct(F.coalesce(_j(n, "$.message.create_time").try_cast("double"), F.lit(0.0)).alias("ts"), i.alias("pos"), _j(n, "$.message.author.role").alias("role"),
                        F.array_join(F.filter(F.transform(F.from_json(_j(n, "$.message.content.parts"), "array<variant>"), _text_part), lambda p: p.isNotNull() & (p != "")), "\n").alias("text")))
    kept = F.array_sort(F.filter(turns, lambda t: t["role"].isin("user", "assistant") & (F.coalesce(t["text"], F.lit("")) != "")))
    text = F.array_join(F.transform(kept, lambda t: F.concat(F.when(t["role"] == "user", "User: ").otherwise("Assistant: "), t["text"])), "\n\n")
    return {"title": F.coalesce(clip(_j(e, "$.title"), 500), F.lit("Untitled ChatGPT conversation")), "content": text, "source_ref": clip(_j(e, "$.id"), 500), "created": _j(e, "$.create_time"), "tags": F.array(F.lit("chatgpt"))}


def _claude(e: Column) -> dict[str, Column]:
    return {"title": F.coalesce(clip(_j(e, "$.name"), 500), F.lit("Untitled Claude conversation")), "content": _lines(_strings(_j(e, "$.chat_messages")), "sender", ("text",), ("human",), ("assistant",), None), "source_ref": clip(_j(e, "$.uuid"), 500), "created": _j(e, "$.created_at"), "tags": F.array(F.lit("claude"))}


def _gemini(e: Column) -> dict[str, Column]:
    lines = _lines(_strings(_j(e, "$.messages")), "role", ("text",), ("user", "human"), None, "user")
    return {"title": F.coalesce(clip(_first(e, "title", "text"), 500), F.lit("Untitled Gemini conversation")), "content": _preclip(F.when(F.coalesce(lines, F.lit("")) != "", lines).otherwise(F.trim(_j(e, "$.text")))), "source_ref": clip(_first(e, "id", "title"), 500), "created": _first(e, "created_date", "time"), "tags": F.array(F.lit("gemini"))}


def _copilot(e: Column) -> dict[str, Column]:
    lines = _lines(_strings(_first(e, "thread", "messages")), "role", ("text", "content"), ("user", "human"), None, "user")
    return {"title": F.coalesce(clip(_j(e, "$.title"), 500), F.lit("Untitled Copilot conversation")), "content": _preclip(lines), "source_ref": clip(_first(e, "conversation_id", "id"), 500), "created": _j(e, "$.created_at"), "tags": F.array(F.lit("copilot"))}


def _openclaw(e: Column) -> dict[str, Column]:
    sid = F.trim(F.coalesce(_j(e, "$.session_id"), F.lit("")))
    lines = _lines(_strings(_first(e, "entries", "logs")), "role", ("content", "text"), ("user", "human"), None, "user")
    title = F.when(sid != "", F.coalesce(clip(_j(e, "$.title"), 500), F.concat(F.lit("OpenClaw session "), F.left(sid, F.lit(8))))).otherwise(F.lit("OpenClaw session"))  # without a session id its own title is not used
    return {"title": title, "content": _preclip(lines), "source_ref": clip(F.coalesce(F.when(sid != "", sid), _j(e, "$.id")), 500), "created": _first(e, "created_at", "timestamp"), "tags": F.array(F.lit("openclaw"))}


def _pam(e: Column) -> dict[str, Column]:
    content = F.trim(_j(e, "$.content"))
    kind = F.coalesce(_first(e, "type"), F.lit("memory"))
    return {"title": clip(F.concat(F.lit("["), kind, F.lit("] "), F.left(content, F.lit(120))), 500), "content": content, "source_ref": clip(_j(e, "$.id"), 500), "created": _j(e, "$.temporal.created_at"), "tags": F.array(kind)}


def _generic(e: Column) -> dict[str, Column]:
    tags = F.slice(F.filter(F.coalesce(_strings(F.when(F.startswith(F.ltrim(_j(e, "$.tags")), F.lit("[")), _j(e, "$.tags"))), F.array().cast("array<string>")), lambda t: F.trim(t) != ""), 1, 50)
    return {"title": clip(_j(e, "$.title"), 500), "content": F.trim(_j(e, "$.content")), "source_ref": clip(_j(e, "$.ref"), 500), "source_url": clip(_j(e, "$.url"), 1000), "created": _j(e, "$.created_at"), "tags": tags}


def _preclip(c: Column) -> Column:
    """These formats are cut to the cap plus the mark first; the final cap then cuts again."""
    from recallium.functions.text import CONTENT_CAP, CUT_MARK

    return F.when(F.length(c) > CONTENT_CAP, F.concat(F.left(c, F.lit(CONTENT_CAP)), F.lit(CUT_MARK))).otherwise(c)


_PARSERS = {"chatgpt": _chatgpt, "claude": _claude, "gemini": _gemini, "copilot": _copilot, "openclaw": _openclaw, "generic": _generic, "pam": _pam}


def _elements(value: Column, fmt: str) -> Column:
    """The items of a file; null if it has not the format's shape."""
    t = F.trim(value)
    array = F.when(F.startswith(t, F.lit("[")), _strings(t))
    if fmt == "pam":
        return _strings(_j(t, "$.memories"))
    if fmt in ("gemini", "copilot"):
        return F.coalesce(array, _strings(_j(t, "$.conversations")))
    if fmt == "openclaw":
        return F.coalesce(array, _strings(_j(t, "$.memory_entries")), F.when(_j(t, "$.session_id").isNotNull(), F.array(t)))
    return array


def parse_export(files: DataFrame, fmt: str, now: Column, value: str = "value") -> DataFrame:
    """Files of one format to items: title, content (capped), source_ref, source_url, captured_at, tags, import_format.

    Items that cannot be read are skipped; a file that has not the format's shape raises ``ImportFormatError``'s message.
    """
    if fmt not in _PARSERS:
        raise ImportFormatError(f"unknown format {fmt!r}; known: {', '.join(FORMATS)}")
    items = _elements(F.col(value), fmt)
    checked = F.when(items.isNull(), F.raise_error(F.lit(f"not a {fmt} export"))).otherwise(items)
    rows = files.select(F.posexplode(checked.cast("array<string>")).alias("pos", "e")).filter(F.startswith(F.ltrim("e"), F.lit("{")))
    cols = _PARSERS[fmt](F.col("e"))
    out = rows.select("pos", cols["title"].alias("title"), cap_content(cols["content"]).alias("content"), cols["source_ref"].alias("source_ref"), cols.get("source_url", F.lit(None).cast("string")).alias("source_url"), to_utc(cols["created"], now).alias("captured_at"), cols["tags"].alias("tags"), F.lit("generic" if fmt == "pam" else fmt).alias("import_format"))
    return out.filter(F.coalesce("content", F.lit("")) != "")


def dedup_import(items: DataFrame, stored: DataFrame) -> DataFrame:
    """First item of each reference in file order that is not stored yet; items without one are never duplicates."""
    named = items.filter("source_ref is not null")
    rest = [c for c in items.columns if c not in ("source_ref", "pos")]
    first = named.groupBy("source_ref").agg(F.min(F.struct("pos", *rest)).alias("r")).select(F.col("r.pos").alias("pos"), *[F.col("r")[c].alias(c) if c != "source_ref" else F.col(c) for c in items.columns if c != "pos"])
    return first.join(stored.select("source_ref"), "source_ref", "left_anti").select(*items.columns).unionByName(items.filter("source_ref is null"))


def import_summary(items: DataFrame, imported: DataFrame) -> DataFrame:
    return items.agg(F.count(F.lit(1)).alias("seen")).join(F.broadcast(imported.agg(F.count(F.lit(1)).alias("imported")))).withColumn("duplicates", F.col("seen") - F.col("imported"))


def transcripts(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """Stored turns as transcripts, by turn; roles other than user and assistant are left out. One row per conversation."""
    t = conversations.filter(F.col("role").isin("user", "assistant") & (F.trim("text") != "")).select(conv, turn, F.concat(F.when(F.col("role") == "user", "User: ").otherwise("Assistant: "), F.trim("text")).alias("line"))
    return t.groupBy(conv).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(turn, "line"))), lambda x: x["line"]), "\n\n").alias("content"), F.count(F.lit(1)).alias("turns"))
