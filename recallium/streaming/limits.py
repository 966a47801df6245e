"""A sliding-log rate limit over a stream: users' recent events are state, and timers forget them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class SlidingLog(StatefulProcessor):
    """Keeps, per user, the times (microseconds) of the last ``seconds`` and counts each event against them.

    A state is that of a group of users, whose events are counted at once. Events of one batch may come in any order;
    batches must come in order of time, as the watermark demands. Equal times count each other, as in the batch form. A
    user's times are dropped when all of them are too old to count; a timer does so where a group gets no more events.
    """

    def __init__(self, seconds: int, limit: int, id_col: str):
        self.span, self.limit, self.id_col = seconds * 1_000_000, limit, id_col

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.log = handle.getListState("log", "user string, at long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        new = pd.concat(list(rows))  # one batch's events of a group
        old = list(self.log.get()) if self.log.exists() else []
        users, names = pd.factorize(np.array([*(u for u, _ in old), *new["user"]], object))
        at = np.concatenate([np.array([t for _, t in old], np.int64), new["at"].to_numpy(np.int64)])
        n = counts_within(users, at, self.span)[len(old) :]
        last = np.full(len(names), np.iinfo(np.int64).min)
        np.maximum.at(last, users, at)
        kept = (at >= last[users] - self.span) & (last[users] + self.span >= timerValues.getCurrentWatermarkInMs() * 1000)
        self.log.put([(u, int(t)) for u, t in zip(names[users[kept]], at[kept], strict=True)])
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t[0] if isinstance(t, tuple) else t)
        self.handle.registerTimer(int((at.max() + self.span) // 1000 + 1))
        yield pd.DataFrame({self.id_col: new["id"].to_numpy(), "in_window": n.astype(np.int64), "limited": n > self.limit})

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.log.clear()
        return iter([])

    def close(self) -> None:
        pass


def counts_within(users: np.ndarray, at: np.ndarray, span: int) -> np.ndarray:
    """Of each (user, time), how many of the user's times lie in the ``span`` that ends with it, itself included."""
    times = np.unique(np.concatenate([at, at - span]))
    place = lambda t: users.astype(np.int64) * len(times) + np.searchsorted(times, t)
    every = np.sort(place(at))
    return np.searchsorted(every, place(at), "right") - np.searchsorted(every, place(at - span), "left")


def rate_limited_stream(events: DataFrame, seconds: int, limit: int, user: str = "user_id", when: str = "ts", id_col: str = "event_id", late: str = "0 seconds", groups: int = 512) -> DataFrame:
    """The streaming form of ``rate_limited``: (event id, in_window, limited) for each event as it comes.

    Users are dealt to ``groups`` states by a hash, so that a batch costs a call per group, not per user; the number is
    fixed with the checkpoint, and a batch's events of a group should fit in a worker. Null times are dropped (they are
    in no window). The session's state store must be RocksDB (``ROCKSDB``).
    """
    kind = events.schema[id_col].dataType.simpleString()
    who = F.to_json(F.struct(F.col(user).alias("u")))  # a null user is one user, as in the batch form
    rows = events.filter(F.col(when).isNotNull()).select(who.alias("user"), id_col, F.col(when).cast("timestamp").alias("_when")).withWatermark("_when", late)
    rows = rows.withColumn("at", F.unix_micros("_when")).withColumn("_group", F.pmod(F.xxhash64("user"), F.lit(groups)).cast("int"))
    return rows.select(F.col(id_col).alias("id"), "user", "at", "_when", "_group").groupBy("_group").transformWithStateInPandas(SlidingLog(seconds, limit, id_col), f"`{id_col}` {kind}, in_window long, limited boolean", "Append", "EventTime")
