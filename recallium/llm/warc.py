r"""WARC archives (op 11): pages written as records, long ones in segments, and put together again on reading.

Writing: a page becomes an HTTP response in chunked framing; a block longer than ``segment_bytes`` is cut into a first
record and continuation records. Of pages with equal payloads of at least ``least_bytes`` one is a response, the
others are revisits that refer to it and hold no body. Each task writes one gzip archive by Spark's text sink, with the
blank lines that end a record as its line separator; so the archives lie wherever Spark can write.

Reading: archives are parsed by their lengths, never by separators. Continuation records are grouped by the identifier
of their origin, in whatever archive they lie, ordered by segment number, their total length is verified, and the
chunked framing is decoded. What cannot be put together has a null payload and an ``error``, never a wrong payload.

Nulls: a null html is an empty payload; a null page id is written as none and read as null (it ranks below all others);
a null url is left out. Rows that repeat a page id and payload are rows like others: one is the response (or each, below
``least_bytes``). An empty table gives no rows. Columns besides the three named ones are ignored.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch

CHUNK_BYTES = 4096
SEGMENT_BYTES = 1 << 14
ARCHIVE_BYTES = 1 << 24
LEAST_BYTES = 1000  # fixed by the contract
LOT_BYTES = 1 << 22

HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
END = b"\r\n\r\n"
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
PIECE = "origin string, segment int, total long, type string, page_id string, url string, refers_to string, digest string, body binary, error string"
PIECE_ARROW = pa.schema([("origin", pa.string()), ("segment", pa.int32()), ("total", pa.int64()), *[(c, pa.string()) for c in ("type", "page_id", "url", "refers_to", "digest")], ("body", pa.binary()), ("error", pa.string())])


# Records


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    """Chunked transfer framing of a payload."""
    out = []
    for k in range(0, len(payload), size):
        part = payload[k : k + size]
        out += [b"%x\r\n" % len(part), part, b"\r\n"]
    return b"".join([*out, b"0\r\n\r\n"])


def dechunked(body: bytes) -> bytes:
    """The payload of a chunked body; extensions and trailers are skipped. ValueError if the framing does not hold."""
    out, at = [], 0
    while True:
        end = body.find(b"\n", at)
        size = body[at:end].split(b";")[0].strip() if end >= 0 else b""
        if not re.fullmatch(rb"[0-9A-Fa-f]+", size):
            raise ValueError("bad chunk size")
        n, at = int(size, 16), end + 1
        if n == 0:
            return b"".join(out)
        if at + n > len(body):
            raise ValueError("chunk is cut off")
        out.append(body[at : at + n])
        at += n
        if body[at : at + 2] == b"\r\n":
            at += 2
        elif body[at : at + 1] == b"\n":
            at += 1
        else:
            raise ValueError("chunk without end")


def header_lines(block: bytes, at: int = 0) -> tuple[str, dict[str, str], int]:
    """First line, fields by lower-case name (a line that starts with a blank goes on the one before), and what follows."""
    first, fields, last = None, {}, ""
    while True:
        end = block.find(b"\n", at)
        if end < 0:
            raise ValueError("headers are cut off")
        line, at = block[at:end].rstrip(b"\r").decode("utf-8", "replace"), end + 1
        if first is None:
            first = line
        elif not line:
            return first, fields, at
        elif line[0] in " \t" and last:
            fields[last] += " " + line.strip()
        else:
            name, _, value = line.partition(":")
            last = name.strip().lower()
            fields[last] = value.strip()


def payload_of(block: bytes) -> bytes:
    """The entity of an HTTP response, out of its transfer framing."""
    _, fields, at = header_lines(block)
    if "chunked" in fields.get("transfer-encoding", "").lower():
        return dechunked(block[at:])
    return block[at:]


def record(fields: list[tuple[str, str | None]], block: bytes) -> bytes:
    """One record without the blank lines behind it. Characters of a value that would break its line are percent-coded."""
    safe = lambda v: re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", v)
    lines = [f"{k}: {safe(v)}" for k, v in [*fields, ("Content-Length", str(len(block)))] if v is not None]
    return b"WARC/1.1\r\n" + "\r\n".join(lines).encode("utf-8", "surrogatepass") + END + block


def segments(fields: list[tuple[str, str | None]], block: bytes, size: int) -> Iterator[bytes]:
    """A block as one record, or as a first segment and its continuations."""
    if len(block) <= size:
        yield record(fields, block)
        return
    own = dict(fields)
    yield record([*fields, ("WARC-Segment-Number", "1")], block[:size])
    count = -(-len(block) // size)
    for k in range(1, count):
        name = f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{own["WARC-Record-ID"]}/{k + 1}')}>"
        more = [("WARC-Type", "continuation"), ("WARC-Record-ID", name), ("WARC-Date", own["WARC-Date"]), ("WARC-Segment-Origin-ID", own["WARC-Record-ID"]), ("WARC-Segment-Number", str(k + 1))]
        yield record(more + [("WARC-Segment-Total-Length", str(len(block)))] * (k + 1 == count), block[k * size : (k + 1) * size])


def records_of(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of one archive, gzip members or plain. Where bytes lack or no record begins, ``cut`` is set."""
    whole, rest, broken = [], data, False
    while rest[:2] == b"\x1f\x8b":
        member = zlib.decompressobj(31)
        try:
            whole.append(member.decompress(rest))
            rest, broken = member.unused_data, not member.eof
        except zlib.error:
            rest, broken = b"", True
    data, at = b"".join(whole) if whole or broken else data, 0
    while True:
        while data[at : at + 1] in (b"\r", b"\n"):
            at += 1
        if at >= len(data):
            break
        try:
            if data[at : at + 5] != b"WARC/":
                raise ValueError("no record begins")
            _, fields, at = header_lines(data, at)
            n = int(fields["content-length"])
        except (ValueError, KeyError):
            yield {"cut": "no record, or one without a length"}, b""
            return
        block = data[at : at + n]
        if len(block) < n:
            fields["cut"] = "record is cut off"
        yield fields, block
        at += n
    if broken:
        yield {"cut": "archive is cut off"}, b""


# Writing


def decide(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """(rid, ref_rid, ref_page) of the pages that only refer to another: of equal payloads that with the largest page id stays.

    Groups are aggregated to their best row before anything is joined; only groups of two or more are joined back.
    """
    keys = pages.filter(F.col("payload_bytes") >= least_bytes).select("rid", "page_id", "payload_bytes", "digest")
    best = keys.groupBy("digest", "payload_bytes").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("page_id", "rid")).alias("best")).filter("n > 1")
    return keys.join(best, ["digest", "payload_bytes"]).filter("rid <> best.rid").select("rid", F.col("best.rid").alias("ref_rid"), F.col("best.page_id").alias("ref_page"))


def _records(segment_bytes: int, chunk_bytes: int, date: str) -> Callable:
    def name(rid: int) -> str:
        return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page/{rid}')}>"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        info = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", date), ("Content-Type", "application/warc-fields")]
        lot, held, begun = [], 0, False
        for b in batches:
            for rid, page, url, payload, digest, ref in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if not begun:
                    lot.append(record(info, b"format: WARC File Format 1.1\r\n"))
                    begun = True
                own = [("WARC-Type", "response" if ref is None else "revisit"), ("WARC-Record-ID", name(rid)), ("WARC-Date", date), ("WARC-Target-URI", url), ("Page-ID", page), ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http;msgtype=response")]
                if ref is None:
                    made = list(segments(own, HEAD + chunked(payload, chunk_bytes), segment_bytes))
                else:
                    made = [record([*own, ("WARC-Profile", IDENTICAL), ("WARC-Refers-To", name(ref))], HEAD)]
                lot += made
                held += sum(map(len, made))
                if held >= LOT_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(lot, pa.binary())], ["record"])
                    lot, held = [], 0
        if lot:
            yield pa.RecordBatch.from_arrays([pa.array(lot, pa.binary())], ["record"])

    return write


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", segment_bytes: int = SEGMENT_BYTES, chunk_bytes: int = CHUNK_BYTES,
                   archive_bytes: int = ARCHIVE_BYTES, least_bytes: int = LEAST_BYTES, date: str = "2024-01-01T00:00:00Z", scratch: Scratch | None = None) -> None:
    """All pages as gzip WARC archives of about ``archive_bytes`` (before compression) under ``path``.

    Rows are numbered once, in a written table, so that the same numbers name a record and what refers to it.
    """
    scratch = scratch or Scratch(pages.sparkSession, "warc")
    payload = F.encode(F.coalesce(F.col(html_col), F.lit("")), "UTF-8")
    rows = pages.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    rows = scratch.cut(rows.select("*", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("digest")))
    total = rows.agg(F.sum(F.col("payload_bytes") + 512)).first()[0] or 0
    width = max(1, -(-total // archive_bytes))
    refers = decide(rows, least_bytes).select("rid", "ref_rid").repartition(width, "rid")
    full = rows.select("rid", F.col("page_id").cast("string").alias("page"), "url", "payload", "digest").repartition(width, "rid").join(refers, "rid", "left")
    body = F.when(F.col("ref_rid").isNull(), F.col("payload"))
    made = full.select("rid", "page", "url", body.alias("payload"), "digest", "ref_rid").mapInArrow(_records(segment_bytes, chunk_bytes, date), "record binary")
    made.select(F.col("record").cast("string").alias("value")).write.option("lineSep", END.decode()).option("compression", "gzip").text(path)
    scratch.drop(rows)


# Reading


def _pieces(segmented: bool) -> Callable:
    """Records of archives (content binary) that are in segments, as they are, or those that are whole, decoded."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for b in batches:
            for cell in b.column(0):
                for f, block in records_of(cell.as_py()):
                    kind, number = f.get("warc-type"), f.get("warc-segment-number")
                    if kind not in ("response", "revisit", "continuation", None) or segmented != (number is not None or kind == "continuation"):
                        continue
                    rows.append(_piece(f, kind, number, block))
                    held += len(block) + 512
                    if held >= LOT_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, schema=PIECE_ARROW)
                        rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=PIECE_ARROW)

    return read


def _piece(f: dict[str, str], kind: str | None, number: str | None, block: bytes) -> dict:
    digits = lambda x: int(x) if x and x.isdigit() else None
    out = {"origin": f.get("warc-segment-origin-id") if kind == "continuation" else f.get("warc-record-id"), "segment": digits(number), "total": digits(f.get("warc-segment-total-length")), "type": kind,
           "page_id": f.get("page-id"), "url": f.get("warc-target-uri"), "refers_to": f.get("warc-refers-to"), "digest": f.get("warc-payload-digest"), "body": block, "error": f.get("cut")}
    if out["error"]:
        out["body"] = None
    elif number is None and kind != "continuation":
        out |= _decoded(kind, block)
    return out


def _decoded(kind: str, block: bytes) -> dict:
    """A whole block's payload; a revisit has none of its own."""
    if kind == "revisit":
        return {"body": None}
    try:
        return {"body": payload_of(block)}
    except ValueError as e:
        return {"body": None, "error": str(e)}


def _join_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last two columns, parts and error, become body and error."""
    for b in batches:
        *kept, parts, errors = b.columns
        kinds = b.column(b.schema.names.index("type"))
        new = [_decoded(k.as_py(), b"".join(x.as_py())) if not e.is_valid else {"body": None, "error": e.as_py()} for k, x, e in zip(kinds, parts, errors, strict=True)]
        done = [pa.array([x["body"] for x in new], pa.binary()), pa.array([x.get("error") for x in new], pa.string())]
        yield pa.RecordBatch.from_arrays([*kept, *done], [*b.schema.names[:-2], "body", "error"])


def reassemble(pieces: DataFrame) -> DataFrame:
    """Segments of each origin, in the order of their numbers, as one block; ``error`` where they do not make up the whole.

    A group is the segments of one record, and so of one payload's size. A segment that occurs again with the same bytes
    (a copied archive) counts once; with other bytes it is an error.
    """
    once = pieces.groupBy("origin", "segment", F.sha1("body").alias("h")).agg(F.max("total").alias("total"), *[F.max(c).alias(c) for c in ("type", "page_id", "url", "refers_to", "digest", "error")], F.first("body").alias("body"))
    part = F.struct("segment", "body")
    first = lambda c: F.max(F.when(F.col("segment") == 1, F.col(c))).alias(c)
    whole = once.groupBy("origin").agg(F.sort_array(F.collect_list(part)).alias("parts"), F.count(F.lit(1)).alias("n"), F.max("segment").alias("last"), F.max("total").alias("total"), F.count_distinct("segment").alias("numbers"),
                                       F.sum(F.octet_length("body").cast("long")).alias("size"), F.max("error").alias("error"), *[first(c) for c in ("type", "page_id", "url", "refers_to", "digest")])
    error = F.coalesce("error", F.when(F.col("type").isNull(), "first segment is missing").when(F.col("n") > F.col("numbers"), "segments differ under one number")
                       .when(F.col("total").isNull() | (F.col("last") != F.col("n")), "segment is missing").when(F.col("total") != F.col("size"), "total length differs"))
    return whole.select("origin", "type", "page_id", "url", "refers_to", "digest", F.when(error.isNull(), F.col("parts.body")).alias("parts"), error.alias("error")).mapInArrow(_join_blocks, "origin string, type string, page_id string, url string, refers_to string, digest string, body binary, error string")


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per page record: record_id, page_id (text), url, type, refers_to, digest, payload, error.

    An archive is read whole by one task (a file of at most 2 GB); the records in segments are read in a pass of their
    own, so that whole records cross no shuffle.
    """
    files = spark.read.format("binaryFile").load(path).select("content")
    whole = files.mapInArrow(_pieces(False), PIECE).select("origin", "type", "page_id", "url", "refers_to", "digest", "body", "error")
    split = reassemble(files.mapInArrow(_pieces(True), PIECE))
    every = whole.unionByName(split)
    claimed = F.lower(F.regexp_replace("digest", "^sha1:", ""))
    wrong = F.when(F.col("body").isNotNull() & F.col("digest").startswith("sha1:") & (F.length(claimed) == 40) & (claimed != F.sha1("body")), "payload digest differs")
    return every.select(F.col("origin").alias("record_id"), "page_id", "url", "type", "refers_to", "digest", F.col("body").alias("payload"), F.coalesce("error", wrong).alias("error"))


def page_report(records: DataFrame, scratch: Scratch) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to from what was read; a revisit has its response's payload."""
    read = records.select("record_id", F.col("page_id").cast("long").alias("page_id"), "type", F.col("refers_to").alias("ref"), F.octet_length("payload").cast("long").alias("b"), F.sha1("payload").alias("d"), "error")
    read = scratch.cut(read)
    bad = read.filter("error is not null or type is null").select("record_id", "error").first()
    if bad:
        raise ValueError(f"record {bad.record_id} cannot be read back: {bad.error}")
    own = read.filter("type = 'response'").select("page_id", F.col("b").alias("payload_bytes"), F.col("d").alias("payload_digest"), F.col("type").alias("record_type"), F.lit(None).cast("long").alias("refers_to"))
    goal = read.filter("type = 'response'").select(F.col("record_id").alias("ref"), F.col("b").alias("payload_bytes"), F.col("d").alias("payload_digest"), F.col("page_id").alias("refers_to"))
    again = read.filter("type = 'revisit'").select("page_id", "ref", F.col("type").alias("record_type")).join(goal, "ref", "left")
    return own.unionByName(again.select(*own.columns))


def archive_pages(pages: DataFrame, path: str | None = None, **options) -> DataFrame:
    """Write all pages as archives, read them back, and report each page as it was read."""
    scratch = Scratch(pages.sparkSession, "warc")
    path = path or f"{scratch.base}/archives"
    write_archives(pages, path, scratch=scratch, **options)
    return page_report(read_archives(pages.sparkSession, path), scratch)
