"""Sharding by minimax contiguous partition (op 8).

Rows with equal texts form one atomic group. Groups are ordered by the digest of their text. The smallest capacity
for which a greedy left-to-right filling needs at most ``n_shards`` shards is found by binary search, and the groups
are cut there. The search never holds all groups: it works on cells (ranges of digests) with their sums and largest
groups. For a capacity, two greedy fillings bound the true one: an early one, whose cuts in a cell of several groups
fall as early as its largest group allows, and a late one, whose cuts fall as late as can be. If the early one needs
few enough shards, or the late one too many, the capacity is decided; else the cells where the two cut are split, at
most two per shard. A round asks ``PROBES`` capacities at once, so it collects at most
2 * shards * PROBES * 16**MORE_DIGITS sums, whatever the number of groups or the size of the largest.
"""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, text_of

FIRST_DIGITS = 3  # 4096 cells to begin with
MORE_DIGITS = 1  # a cell is split into at most 16
PROBES = 8  # capacities that a round asks
SLOT_ROWS = 200_000  # rows that one numbering task gets, on average


def _ends(sums: list[int], capacity: int, shards: int) -> list[int] | None:
    """Greedy ends (index after the last cell) of each shard; None if it takes more than ``shards``."""
    cum = [0, *accumulate(sums)]
    at, ends = 0, []
    while at < len(sums):
        end = bisect_right(cum, cum[at] + capacity) - 1
        if end == at or len(ends) == shards:
            return None
        ends.append(end)
        at = end
    return ends


def smallest_capacity(sums: list[int], shards: int) -> int:
    """Binary search over capacities; ``_ends`` says whether one is enough."""
    low, high = max([1, *sums, -(-sum(sums) // shards)]), max(1, sum(sums))
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if _ends(sums, mid, shards) is not None else (mid + 1, high)
    return low


Cell = tuple[str, int, int, int]  # digest prefix, bytes, groups, bytes of the largest group


def _greedy(cells: list[Cell], cum: list[int], capacity: int, shards: int, early: bool) -> tuple[bool, set[int]]:
    """Whether the early (or late) filling reaches the end, and the cells of several groups that its cuts fall into."""
    at, unsure = 0, set()
    for _ in range(shards):
        aim = at + capacity
        if aim >= cum[-1]:
            return True, unsure
        k = bisect_right(cum, aim) - 1
        if cells[k][2] == 1 or aim == cum[k]:
            at = cum[k]
        else:
            unsure.add(k)
            at = max(cum[k], aim - cells[k][3] + 1) if early else aim
    return at >= cum[-1], unsure


def _summed(groups: DataFrame, key: str, size: str, digits: int) -> list[Cell]:
    got = groups.groupBy(F.substring(key, 1, digits).alias("p")).agg(F.sum(size).alias("s"), F.count(F.lit(1)).alias("n"), F.max(size).alias("m")).collect()
    return [(r.p, int(r.s), int(r.n), int(r.m)) for r in got]


def _split(groups: DataFrame, key: str, size: str, cells: list[Cell], which: set[int]) -> tuple[list[Cell], int]:
    """The cells with those of ``which`` split by ``MORE_DIGITS`` (hexadecimal digits sort before "g"), and the number collected."""
    def any_of(parts: list[str]):
        if len(parts) == 1:
            return (F.col(key) >= parts[0]) & (F.col(key) < parts[0] + "g")
        return any_of(parts[: len(parts) // 2]) | any_of(parts[len(parts) // 2 :])

    new: list[Cell] = []
    for digits in sorted({len(cells[k][0]) for k in which}):
        new += _summed(groups.filter(any_of([cells[k][0] for k in which if len(cells[k][0]) == digits])), key, size, digits + MORE_DIGITS)
    return sorted([c for k, c in enumerate(cells) if k not in which] + new), len(new)


def balanced_ends(sums: list[int], capacity: int, shards: int) -> list[int]:
    """Ends of the shards at this capacity: each at its even share of what is left, if the rest still fits."""
    cum = [0, *accumulate(sums)]
    at, ends = 0, []
    for k in range(shards):
        left = shards - k
        most = bisect_right(cum, cum[at] + capacity) - 1
        aim = cum[at] + (cum[-1] - cum[at]) / left
        near = bisect_right(cum, aim) - 1
        if near + 1 < len(cum) and cum[near + 1] - aim < aim - cum[near]:
            near += 1
        end = min(most, max(near, at))
        if left == 1 or (left > 1 and _ends(sums[end:], capacity, left - 1) is None):
            end = most
        ends.append(end)
        at = end
    return ends


def minimax_cuts(groups: DataFrame, key: str, size: str, shards: int) -> tuple[list[str], int, int]:
    """Upper bounds (exclusive digest prefixes) of all shards but the last, the capacity, and the most sums collected in a round."""
    cells = sorted(_summed(groups, key, size, FIRST_DIGITS))
    most = len(cells)
    if not cells:
        return [""] * (shards - 1), 0, 0
    low = max(max(c[3] for c in cells), -(-sum(c[1] for c in cells) // shards))
    high = max(low, smallest_capacity([c[1] for c in cells], shards))  # enough, as cuts between cells show
    while low < high:
        cum = [0, *accumulate(c[1] for c in cells)]
        unsure: set[int] = set()
        for c in sorted({low + (high - low) * k // PROBES for k in range(PROBES)}):
            if not low <= c < high:
                continue
            sure, a = _greedy(cells, cum, c, shards, early=True)
            fits, b = _greedy(cells, cum, c, shards, early=False)
            if sure:
                high = c
            elif not fits:
                low = c + 1
            else:
                unsure |= a | b
        if unsure and low < high:
            cells, n = _split(groups, key, size, cells, unsure)
            most = max(most, n)
    while True:  # cells that the cuts at this capacity fall into
        cum = [0, *accumulate(c[1] for c in cells)]
        sums = [c[1] for c in cells]
        if _ends(sums, high, shards) is not None:
            break
        cells, n = _split(groups, key, size, cells, _greedy(cells, cum, high, shards, early=True)[1])
        most = max(most, n)
    ends = balanced_ends(sums, high, shards)
    return [cells[e][0] if e < len(cells) else "g" for e in ends[:-1]], high, most


def shard_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_shards: int = 16) -> DataFrame:
    """Per row: id, ``size`` (UTF-8 bytes plus 1), ``text_crc32``, ``law``, ``shard``, ``slot``, ``grown_shard``.

    Law ``bytes``: the largest shard is as small as contiguous whole groups of equal texts allow, and the others near
    their even share. Null texts count as empty. Rows repeated are rows of their own, in the same shard; null ids
    are numbered last. An empty table gives no rows. Extra columns are ignored.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "shards")
    raw = F.encode(text_of(text_col), "UTF-8")
    rows = scratch.cut(docs.select(F.col(id_col).alias(id_col), raw.alias("b")).select(
        id_col, (F.octet_length("b") + 1).cast("long").alias("size"), F.crc32("b").alias("text_crc32"), F.sha2("b", 256).alias("_g")))
    groups = scratch.cut(rows.groupBy("_g").agg(F.sum("size").alias("_s")).sortWithinPartitions("_g"))  # in order, so that a round reads only the pages of its cells
    cuts, _, _ = minimax_cuts(groups, "_g", "_s", n_shards)
    scratch.drop(groups)
    shard = F.lit(0)
    for c in cuts:
        shard = shard + (F.col("_g") >= F.lit(c)).cast("int")
    placed = rows.withColumn("shard", shard)
    # Slots: each shard's rows fall into cells by a hash of the id, numbered alone and set off by the cells before.
    n = rows.count()
    per_shard = max(1, min(4096, -(-n // (SLOT_ROWS * n_shards)), ) if n > SLOT_ROWS * n_shards else 8)
    placed = placed.withColumn("_c", F.expr(f"cast(pmod(xxhash64({id_col}, _g), {per_shard}) as int)"))
    counts = placed.groupBy("shard", "_c").count().collect()  # at most n_shards * 4096
    start, offsets = {}, []
    for r in sorted(counts, key=lambda r: (r.shard, r._c)):
        offsets.append((r.shard, r._c, start.get(r.shard, 0)))
        start[r.shard] = start.get(r.shard, 0) + r["count"]
    offs = spark.createDataFrame(offsets, "shard int, _c int, _o long")
    number = F.expr(f"row_number() over (partition by shard, _c order by {id_col} nulls last, _g)")
    return placed.withColumn("_n", number).join(F.broadcast(offs), ["shard", "_c"]).select(
        id_col, "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("_o") + F.col("_n") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
