"""Helpers shared by the training-data operators: cut tables, key columns, word patterns."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed by the contracts: a word is a run of anything but ASCII white space.
WORD_SPLIT = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share; set here only where the session leaves it unset (tests, one machine)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return (found or "/tmp/checkpoints").rstrip("/")


class Scratch:
    """Tables written to the shared folder to cut lineage.

    ``cut`` writes once and reads back, so a lost executor costs a re-read and nothing upstream is computed
    twice. ``drop`` removes tables that no later plan needs.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{shared_dir(spark)}/recallium/{name}-{uuid.uuid4().hex}"
        self.n = 0

    def cut(self, df: DataFrame, *partition_by: str) -> DataFrame:
        self.n += 1
        path = f"{self.base}/{self.n}"
        writer = df.write.option("compression", "zstd")
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._cut_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(t._cut_path)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def fresh(columns: list[str], name: str) -> str:
    """``name``, with underscores behind it until no column has it (names differ by more than case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_of(col: str = "text"):
    """Null counts as empty."""
    return F.coalesce(F.col(col), F.lit(""))


def strip_space(col):
    r"""Delete every character of ``[\x20\x09-\x0D]``; byte replacement, no regular expression."""
    for ch in " \t\n\x0b\x0c\r":
        col = F.replace(col, F.lit(ch), F.lit(""))
    return col


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


_HELD: dict[str, Callable[[], bool]] = {}


def holds(name: str, clear: Callable[[], bool]) -> None:
    """An operator's caches in a worker; ``clear`` empties them and says whether there was anything."""
    _HELD[name] = clear


def free_caches() -> None:
    """Give back what earlier stages keep in this worker, which Spark uses again for later ones."""
    if any([clear() for clear in _HELD.values()]):
        gc.collect()
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (OSError, AttributeError):  # another C library
            pass
