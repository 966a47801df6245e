"""Connectors as Python data sources: spools of mails and feed entries, for ``spark.read`` and ``spark.readStream``.

A spool is a folder of files with one item per line: a mail's MIME tree as JSON, or a feed's ``item`` or ``entry`` as
XML. A file is a partition. Filters on ``file`` leave whole files unread, filters on ``sent`` leave out items before
their texts are decoded. A stream's offset is a cursor (the newest file time and the files that have it), so it stays
small, and a checkpoint takes it up after a restart; a file that comes late with the cursor's time is still read.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, datetime
from email.utils import parsedate_to_datetime
from xml.etree import ElementTree

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition

from recallium.sources.connectors import mail_text

SCHEMA = "file string, item_id string, sent timestamp, sender string, title string, text string"


@dataclass
class SpoolFile(InputPartition):
    uri: str


def _files(path: str) -> list[tuple[int, str]]:
    """(time in nanoseconds, path) of a spool's files, oldest first; names that begin with a dot or underscore are no items."""
    from pyarrow import fs

    system, at = fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
    found = system.get_file_info(fs.FileSelector(at, recursive=True, allow_not_found=True))
    return sorted((f.mtime_ns or 0, f.path) for f in found if f.is_file and f.base_name[0] not in "._")


def _lines(path: str, uri: str) -> Iterator[str]:
    from pyarrow import fs

    system, _ = fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
    with system.open_input_stream(uri) as f:
        rest = b""
        while block := f.read(1 << 20):
            *whole, rest = (rest + block).split(b"\n")
            yield from (x.decode("utf-8", "replace") for x in whole)
        if rest:
            yield rest.decode("utf-8", "replace")


def when(text: str | None) -> datetime | None:
    """A mail's or feed's date (RFC 2822 or ISO 8601) in UTC; null where it is none."""
    for read in (datetime.fromisoformat, parsedate_to_datetime):
        try:
            t = read((text or "").strip())
            return t.astimezone(UTC) if t.tzinfo else t.replace(tzinfo=UTC)
        except (ValueError, TypeError, IndexError):
            continue
    return None


def mail_item(line: str) -> tuple | None:
    """(id, date, sender, subject, a way to the text); null for a line that is no mail."""
    try:
        m = json.loads(line)
        head = {h["name"].lower(): h["value"] for h in (m.get("payload") or {}).get("headers") or []}
    except (ValueError, AttributeError, KeyError, TypeError):
        return None
    return m.get("id"), when(head.get("date")), head.get("from"), head.get("subject"), lambda: mail_text(m.get("payload"))


def feed_item(line: str) -> tuple | None:
    try:
        e = ElementTree.fromstring(line)
    except ElementTree.ParseError:
        return None
    name = lambda x: x.tag.rpartition("}")[2].lower()
    own = {name(c): "".join(c.itertext()).strip() for c in reversed(list(e))}  # the first of a name counts
    first = lambda *k: next((own[x] for x in k if own.get(x)), None)
    body = lambda: " ".join(re.sub(r"<[^>]+>", " ", first("encoded", "content", "description", "summary") or "").split())
    return first("guid", "id", "link"), when(first("pubdate", "published", "updated", "date")), first("author", "creator"), first("title"), body


KINDS = {"mail": mail_item, "feed": feed_item}


class _Reader:
    def __init__(self, options: dict[str, str]):
        self.path, self.item = options["path"], KINDS[options.get("kind", "mail")]
        self.after: tuple[datetime, bool] | None = None
        self.only: str | None = None

    def partitions_of(self, files: list[tuple[int, str]]) -> list[SpoolFile]:
        return [SpoolFile(p) for _, p in files if self.only is None or p.rpartition("/")[2] == self.only]

    def read(self, partition: SpoolFile) -> Iterator[tuple]:
        for line in _lines(self.path, partition.uri):
            found = self.item(line) if line.strip() else None
            if found is None:
                continue
            key, sent, sender, title, text = found
            if self.after and (sent is None or sent < self.after[0] or (sent == self.after[0] and not self.after[1])):
                continue
            yield partition.uri.rpartition("/")[2], key, sent, sender, title, text()


class SpoolReader(_Reader, DataSourceReader):
    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        """Takes a lower bound of ``sent`` and a ``file``; Spark applies the others."""
        for f in filters:
            if isinstance(f, GreaterThan | GreaterThanOrEqual) and f.attribute == ("sent",) and self.after is None:
                at = f.value if f.value.tzinfo else f.value.replace(tzinfo=UTC)
                self.after = (at, isinstance(f, GreaterThanOrEqual))
            elif isinstance(f, EqualTo) and f.attribute == ("file",) and self.only is None:
                self.only = f.value
            else:
                yield f

    def partitions(self) -> list[SpoolFile]:
        return self.partitions_of(_files(self.path)) or [SpoolFile("")]

    def read(self, partition: SpoolFile) -> Iterator[tuple]:
        return super().read(partition) if partition.uri else iter(())


class SpoolStream(_Reader, DataSourceStreamReader):
    def initialOffset(self) -> dict:  # noqa: N802
        return {"time": -1, "files": []}

    def latestOffset(self) -> dict:  # noqa: N802
        files = _files(self.path)
        if not files:
            return self.initialOffset()
        last = files[-1][0]
        return {"time": last, "files": sorted(p for t, p in files if t == last)}

    def partitions(self, start: dict, end: dict) -> list[SpoolFile]:
        known, wanted = set(start["files"]), set(end["files"])
        new = [(t, p) for t, p in _files(self.path) if (t > start["time"] or (t == start["time"] and p not in known)) and (t < end["time"] or p in wanted)]
        return self.partitions_of(new)


class SpoolSource(DataSource):
    """``format("spool")`` with ``path`` and ``kind`` (mail or feed)."""

    @classmethod
    def name(cls) -> str:
        return "spool"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> SpoolReader:
        return SpoolReader(dict(self.options))

    def streamReader(self, schema: object) -> SpoolStream:  # noqa: N802
        return SpoolStream(dict(self.options))


def register(spark: SparkSession) -> None:
    """Make ``format("spool")`` known to the session, with filters pushed into it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SpoolSource)
