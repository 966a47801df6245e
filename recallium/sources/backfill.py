"""A backfill in pages of a key's range that can be stopped after any page and begun again.

The plan (where pages end) is written once. A page's rows go to a folder of their own; the page counts as done when
its entry in the log is created, which happens once: of two writers of a page the second fails, and a writer that was
replaced (an older epoch) commits nothing. What was written by a page that never got its entry is not part of the result.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recallium.sources.stores import Conflict, Folder

MOST_PAGES = 10_000


class Backfill:
    def __init__(self, spark: SparkSession, path: str, key: str):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key
        self.log, self.writers, self.plans = (Folder(spark, f"{self.path}/{x}") for x in ("done", "writers", "plan"))

    def plan(self, table: DataFrame, page_rows: int) -> list:
        """Upper ends of all pages but the last, as first planned; at most ``MOST_PAGES`` pages. Keys are whole numbers; null keys go with the first page."""
        if "plan.json" not in self.plans.names():
            many = table.count()
            pages = min(MOST_PAGES, max(1, -(-many // page_rows)))
            ends = table.agg(F.percentile_approx(self.key, [k / pages for k in range(1, pages)], 4 * MOST_PAGES)).first()[0] if pages > 1 else []
            self.plans.create("plan.json", json.dumps(sorted(set(ends or []))))
        return json.loads(self.plans.read("plan.json"))

    def done(self) -> dict[int, dict]:
        return {int(n.split(".")[0]): json.loads(self.log.read(n)) for n in self.log.names() if n.endswith(".json")}

    def take_over(self) -> int:
        """A new writer; those before it can commit no more."""
        epoch = 1 + max([int(n) for n in self.writers.names() if n.isdigit()], default=0)
        self.writers.create(str(epoch), "")
        return epoch

    def _is_mine(self, epoch: int) -> None:
        newest = max([int(n) for n in self.writers.names() if n.isdigit()], default=0)
        if newest != epoch:
            raise Conflict(f"the writer of epoch {epoch} was replaced by {newest}")

    def run(self, table: DataFrame, page_rows: int, each: Callable[[DataFrame], DataFrame] = lambda page: page, stop_after: int | None = None, epoch: int | None = None) -> int:
        """Write the pages that are not done yet (at most ``stop_after`` of them); returns how many were."""
        epoch = epoch or self.take_over()
        ends, done, made = self.plan(table, page_rows), self.done(), 0
        for n, (low, high) in enumerate(zip([None, *ends], [*ends, None], strict=True)):
            if n in done:
                continue
            if stop_after is not None and made >= stop_after:
                break
            k = F.col(self.key)
            page = table.filter((k > low) if low is not None else F.lit(True)).filter((k <= high) if high is not None else F.lit(True)) if low is not None or high is None else table.filter(k.isNull() | (k <= high))
            part = f"pages/{n:06d}-{uuid.uuid4().hex}"
            self._is_mine(epoch)
            each(page).write.parquet(f"{self.path}/{part}")
            self._is_mine(epoch)
            self.log.create(f"{n:06d}.json", json.dumps({"path": part, "after": low, "to": high, "epoch": epoch}))
            made += 1
        return made

    def complete(self) -> bool:
        return "plan.json" in self.plans.names() and len(self.done()) == len(json.loads(self.plans.read("plan.json"))) + 1

    def read(self) -> DataFrame:
        """The rows of the pages that are done."""
        return self.spark.read.parquet(*[f"{self.path}/{d['path']}" for _, d in sorted(self.done().items())])
