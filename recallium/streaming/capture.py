"""Capture of a folder's files as a stream: new and changed ones, each once; files that were only touched pass silently."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from recallium.sources.spools import SpoolFile, _files


class _Changes(DataSourceStreamReader):
    """Files whose time is at or after the last seen one. Those of exactly that time are read again, since one of them may
    have been written after the look; the state behind knows their digests."""

    def __init__(self, path: str):
        self.path = path

    def initialOffset(self) -> dict:  # noqa: N802
        return {"time": -1, "count": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        files = _files(self.path)
        last = files[-1][0] if files else -1
        return {"time": last, "count": sum(t == last for t, _ in files)}

    def partitions(self, start: dict, end: dict) -> list[SpoolFile]:
        return [SpoolFile(f"{t}:{p}") for t, p in _files(self.path) if start["time"] <= t <= end["time"]]

    def read(self, partition: SpoolFile) -> Iterator[tuple]:
        from pyarrow import fs

        time, _, at = partition.uri.partition(":")
        system, _ = fs.FileSystem.from_uri(self.path if ":" in self.path else f"file://{self.path}")
        try:
            with system.open_input_stream(at) as f:
                yield at, int(time) // 1000, bytes(f.read())
        except FileNotFoundError:  # deleted since the look
            return


class FileChanges(DataSource):
    """``format("file_changes")`` with ``path``: (path, mtime in microseconds, content)."""

    @classmethod
    def name(cls) -> str:
        return "file_changes"

    def schema(self) -> str:
        return "path string, mtime long, content binary"

    def streamReader(self, schema: object) -> _Changes:  # noqa: N802
        return _Changes(self.options["path"])


class KnownDigests(StatefulProcessor):
    """Per path, the digest and time last captured."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "sha16 string, mtime long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802
        known = self.last.get() if self.last.exists() else None
        out = []
        for r in pd.concat(list(rows)).sort_values("mtime").itertuples(index=False):
            if known is None or known[0] != r.sha16:
                out.append((r.path, r.mtime, r.sha16, "new" if known is None else "changed", r.text))
            known = (r.sha16, int(r.mtime))
        self.last.update(known)
        yield pd.DataFrame(out, columns=["path", "mtime", "sha16", "change", "text"])

    def close(self) -> None:
        pass


def captured_files(spark: SparkSession, path: str) -> DataFrame:
    """The stream of (path, mtime, sha16, change, text); the first sixteen digits of the SHA-256 decide what is changed.

    Blank files count as captured, with their text. The session's state store must be RocksDB.
    """
    from recallium.sources.connectors import file_text

    spark.dataSource.register(FileChanges)
    files = spark.readStream.format("file_changes").option("path", path).load()
    rows = files.select("path", "mtime", F.left(F.sha2("content", 256), F.lit(16)).alias("sha16"), file_text(F.col("content")).alias("text"))
    return rows.groupBy("path").transformWithStateInPandas(KnownDigests(), "path string, mtime long, sha16 string, change string, text string", "Append", "None")
