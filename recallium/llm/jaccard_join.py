"""N-gram Jaccard join, size-aware and heavy-light (op 1).

A document's set holds the hashes of its distinct word shingles; documents with equal sets are one *class* and take
part once. Two classes of sizes a and b link when their overlap reaches c(a, b), the least overlap that gives the
wanted similarity.

* Light sets (at most ``x`` shingles) list all their subsets of the sizes c(a, b) that their partners among light
  sets can ask for: a linked pair of light sets shares a whole subset, which is its key.
* Heavy sets, and the light ones large enough to be a heavy set's partner, are entered in inverted lists of single
  shingles. A linked pair shares one of its rarest ``n - ceil(t n) + 1`` shingles, so only those lists are kept.
  "Rarest" is by counts of shingles over all documents, in 2**18 bins.
* ``x`` is the size at which the listing of subsets becomes dearer than the scan of lists, by the sizes' histogram.

Documents become classes first (one row and one number each, whatever the count of copies), so a list holds each set
once. Only lists of two sets at least are kept; one of more than ``CELL`` sets is split into cells, and each two cells
meet in one task. There sets whose sizes, positions and parity bitmaps let them link (one bit or two per shingle: as
many bits as differ, so many shingles differ at least) are joined by union-find, and only a forest leaves the task: at
most one row per set and cell, never the pairs. The forests' components are *clusters*: every link is inside one.

A cluster's whole sets, made from the texts again, are dealt in blocks; blocks that meet in a task are compared at once
by a product of 0/1 matrices, and again only a forest of the links leaves it. First each block meets itself and its
neighbours in a ring, which is all there is in clusters of three blocks at most. In larger clusters, what is one
component by then is never compared with itself: its blocks meet only the blocks of others.
Any pair that is skipped is either impossible or already in one component, so components are exact.

Numbers of links are a job of their own (``jaccard_links``): all blocks of a component meet, and only counts leave.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_caches, shuffle_width, Scratch
from .components import connected_components

BIN_BITS = 18
LARGEST_LIGHT = 16  # subsets are never listed for sets above this size
SCAN_COST = 4.0  # of an entry of a list, in subsets listed
LOT_BYTES = 2 << 20  # of text that is hashed in one go
LONG_WORD = 512
CELL = 2048  # sets of one list that meet in a task, twice as many where two cells meet
LINK_SETS, LINK_SHINGLES = 512, 1 << 20  # of a block of whole sets, about
TREE_NODES = 400_000  # in a task's union-find; it starts anew beyond that
LINK_COLUMNS = 8192  # of the matrices, at once
_MULT = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


def _mix(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def _byte_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    codes = _mix(np.arange(1, 257, dtype=np.uint64) * _MULT[0])
    codes[65:91] = codes[97:123]  # A-Z as a-z
    word = np.ones(256, bool)
    word[[32, *range(9, 14)]] = False
    return codes, word, np.cumprod(np.full(LONG_WORD, _MULT[4], np.uint64), dtype=np.uint64)


_CODES, _IS_WORD, _POWERS = _byte_tables()


def _word_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the concatenated texts ``raw``, and the number of words before each text's start."""
    inside = _IS_WORD[raw]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    begin = offsets[:-1][offsets[:-1] < len(raw)]
    first[begin] |= inside[begin]
    starts = np.flatnonzero(first)
    before = np.searchsorted(starts, offsets)
    if not len(starts):
        return np.empty(0, np.uint64), before
    at = np.flatnonzero(inside)
    number = np.searchsorted(at, starts)
    lengths = np.diff(np.append(number, len(at)))
    place = np.arange(len(at)) - np.repeat(number, lengths)
    h = np.add.reduceat(_CODES[raw[at]] * _POWERS[place % LONG_WORD], number)
    for k in np.flatnonzero(lengths > LONG_WORD):
        h[k] = xxhash.xxh64_intdigest(raw[starts[k] : starts[k] + lengths[k]].tobytes().lower())
    h += lengths.astype(np.uint64)
    return _mix(h), before


def shingle_sets(texts: pa.Array, n: int) -> Iterator[np.ndarray]:
    """Per text, in order: sorted hashes of its distinct n-word shingles; with fewer words, of the whole sequence; without
    words (or text), none. Texts are hashed in lots of about ``LOT_BYTES``."""
    col = texts.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(col.buffers()[2] or b"", np.uint8)
    lo = 0
    while lo < len(col):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + LOT_BYTES, "right")) - 1)
        hi = min(hi, len(col))
        w, before = _word_hashes(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        h = np.empty(0, np.uint64)
        if len(w) >= n:
            h = np.full(len(w) - n + 1, n, np.uint64)
            for k in range(n):
                h *= _MULT[k % len(_MULT)]
                h += w[k : len(w) - n + 1 + k]
                h ^= h >> np.uint64(29)
            _mix(h)
        for a, b in zip(before[:-1].tolist(), before[1:].tolist(), strict=True):
            if b - a >= n:
                s = np.sort(h[a : b - n + 1])
                yield s[np.concatenate([[True], s[1:] != s[:-1]])]
            elif b > a:
                yield np.array([xxhash.xxh64_intdigest(w[a:b].tobytes(), b - a)], np.uint64)
            else:
                yield np.empty(0, np.uint64)
        lo = hi


def shingle_set(text: str | None, n: int) -> np.ndarray:
    return next(shingle_sets(pa.array([text], pa.string()), n))


def bitmap(s: np.ndarray) -> bytes:
    """Parities of the number of shingles per bin; bins are at least as many as shingles, a power of two."""
    bins = 1 << max(6, int(len(s) - 1).bit_length())
    return np.packbits(np.bincount((s & np.uint64(bins - 1)).astype(np.int64), minlength=bins).astype(np.uint8) & 1, bitorder="little").tobytes()


def may_link(x: bytes, y: bytes, a: int, b: int, num: int, den: int) -> bool:
    """Whether sets of sizes a and b with these bitmaps can have the overlap."""
    u, v = int.from_bytes(x, "little"), int.from_bytes(y, "little")
    bits = 8 * min(len(x), len(y))
    size = 8 * max(len(x), len(y))
    if len(x) < len(y):
        u, v = v, u
    while size > bits:
        size //= 2
        u = (u >> size) ^ (u & ((1 << size) - 1))
    most = (a + b - (u ^ v).bit_count()) // 2
    return most >= least_overlap(a, b, num, den)


def least_overlap(a: int, b: int, num: int, den: int) -> int:
    """Overlap at which den * intersection >= num * union."""
    return -(-num * (a + b) // (num + den))


def subset_sizes(a: int, x: int, num: int, den: int) -> list[int]:
    """Sizes of the subsets that a light set of size a lists, for partners of at most x."""
    return sorted({c for b in range(-(-num * a // den), min(x, den * a // num) + 1) if (c := least_overlap(a, b, num, den)) <= min(a, b)})


def prefix_length(n: int, num: int, den: int) -> int:
    return n - -(-num * n // den) + 1


def light_boundary(hist: dict[int, int], num: int, den: int) -> int:
    """The x of least cost: subsets listed up to x, list entries scanned from the least partner of x + 1 up.

    Sets above ``LARGEST_LIGHT`` are scanned at any x, so they add the same to each cost and need no count here; that
    bound never binds in practice, since subsets outgrow entries well below it.
    """
    def cost(x: int) -> float:
        listed = sum(hist.get(a, 0) * sum(comb(a, c) for c in subset_sizes(a, x, num, den)) for a in range(1, x + 1))
        scanned = sum(hist.get(a, 0) * prefix_length(a, num, den) for a in range(max(1, -(-num * (x + 1) // den)), LARGEST_LIGHT + 1))
        return listed + SCAN_COST * scanned

    return min(range(LARGEST_LIGHT + 1), key=cost)


SUBSET = (1 << 28) - 1


def _keys(s: np.ndarray, x: int, weight: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of a set and each key's position: SUBSET for subsets, else the shingle's place in the set's order."""
    n, out, pos = len(s), [], []
    if 0 < n <= x:
        for c in subset_sizes(n, x, num, den):
            found = [xxhash.xxh64_intdigest(b"".join(t), c) for t in combinations([v.tobytes() for v in s], c)]
            out.append(np.array(found, np.uint64))
            pos.append(np.full(len(found), SUBSET, np.int32))
    if n and n * den >= num * (x + 1):
        p = prefix_length(n, num, den)
        order = np.lexsort((s, weight[(s >> np.uint64(64 - BIN_BITS)).astype(np.int64)]))[:p]
        out.append(s[order])
        pos.append(np.arange(p, dtype=np.int32))
    if not out:
        return np.empty(0, np.int64), np.empty(0, np.int32)
    return np.concatenate(out).view(np.int64), np.concatenate(pos)


def _count_bins(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free_caches()
        bins = np.zeros(1 << BIN_BITS, np.int64)
        sizes = np.zeros(LARGEST_LIGHT + 1, np.int64)
        for b in batches:
            held, some = [], 0
            for s in shingle_sets(b.column(0), n):
                held.append((s >> np.uint64(64 - BIN_BITS)).astype(np.int64))
                some += len(s)
                if len(s) <= LARGEST_LIGHT:
                    sizes[len(s)] += 1
                if some > 1 << 20:
                    bins += np.bincount(np.concatenate(held), minlength=1 << BIN_BITS)
                    held, some = [], 0
            if some:
                bins += np.bincount(np.concatenate(held), minlength=1 << BIN_BITS)
        k, z = np.flatnonzero(bins), np.flatnonzero(sizes)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([k, -1 - z])), pa.array(np.concatenate([bins[k], sizes[z]]))], ["bin", "n"])

    return run


POS_BITS = 28  # sizes and positions travel as one number: size << POS_BITS | position


def _sets(n: int, shared, num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free_caches()
        x, weight = shared.value
        seen: set[bytes] = set()  # classes this task has given the keys of; at most its rows
        for whole in batches:
            for lot in range(0, whole.num_rows, 512):
                b = whole.slice(lot, 512)
                fa, fb, sizes, keys, pos, maps = [], [], [], [], [], []
                for i, s in zip(b.column(0).to_pylist(), shingle_sets(b.column(1), n), strict=True):
                    d = xxhash.xxh3_128_digest(s.tobytes())
                    fa.append(int.from_bytes(d[:8], "little", signed=True))
                    fb.append(int.from_bytes(d[8:], "little", signed=True))
                    sizes.append(len(s))
                    if i is None or not len(s) or d in seen:
                        keys.append(None)
                        pos.append(None)
                        maps.append(None)
                        continue
                    seen.add(d)
                    k, p = _keys(s, x, weight, num, den)
                    keys.append(k)
                    pos.append(p)
                    maps.append(bitmap(s))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fa, pa.int64()), pa.array(fb, pa.int64()), pa.array(sizes, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(pos, pa.list_(pa.int32())), pa.array(maps, pa.binary())], ["id", "fa", "fb", "n", "keys", "pos", "bits"])

    return run


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Blocks of rows sorted by the first column such that no run of it is cut."""
    held: list[np.ndarray] | None = None
    for b in batches:
        cols = [c.to_numpy(zero_copy_only=False) for c in b.columns]
        if held is not None:
            cols = [np.concatenate([h, c]) for h, c in zip(held, cols, strict=True)]
        if not len(cols[0]):
            continue
        last = np.searchsorted(cols[0], cols[0][-1], "left")
        held = [c[last:] for c in cols]
        if last:
            yield [c[:last] for c in cols]
    if held is not None and len(held[0]):
        yield held


def _possible(x: np.ndarray, y: np.ndarray, num: int, den: int) -> np.ndarray:
    """Whether two sets whose first common shingle has these places (size << POS_BITS | position) can link."""
    mask = (1 << POS_BITS) - 1
    a, b, p, q = x >> POS_BITS, y >> POS_BITS, x & mask, y & mask
    fits = (np.minimum(a, b) * den >= np.maximum(a, b) * num)
    return fits & ((p == SUBSET) | (np.minimum(a - p, b - q) >= -(-num * (a + b) // (num + den))))


class _Union:
    """Union-find over numbers as they come; the root is the least."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        up, root = self.parent, x
        while (p := up.get(root, root)) != root:
            root = p
        while (p := up.get(x, x)) != root:
            up[x] = root
            x = p
        return root

    def join(self, x: int, y: int) -> bool:
        a, b = self.find(x), self.find(y)
        if a != b:
            self.parent[max(a, b)] = min(a, b)
        return a != b


def _candidates(num: int, den: int):
    """Of rows (cell, side, sp, node, bits) sorted by cell and size: a forest over the sets that may link.

    All rows are held against the ones d places on, for d from 1 up, until sizes or cells no longer fit; sets already in
    one tree are passed over. ``side`` tells the two cells of a list apart where two meet (else null).
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free_caches()
        trees = _Union()
        for cell, side, sp, node, bits in _runs(batches):
            if len(trees.parent) > TREE_NODES:  # what is forgotten costs an edge that another already implies
                trees = _Union()
            size, label = sp >> POS_BITS, np.array([trees.find(x) for x in node.tolist()], np.int64)
            us, vs = [], []
            i = np.arange(len(cell))
            d = 1
            while len(i):
                i = i[i + d < len(cell)]
                j = i + d
                fits = (cell[j] == cell[i]) & (size[i] * den >= num * size[j])
                i, j = i[fits], j[fits]
                hit = np.flatnonzero((label[i] != label[j]) & ((side[i] < 0) | (side[i] != side[j])))
                hit = hit[_possible(sp[i[hit]], sp[j[hit]], num, den)]
                new = 0
                for a, b in zip(i[hit].tolist(), j[hit].tolist(), strict=True):
                    u, v = int(node[a]), int(node[b])
                    if trees.find(u) != trees.find(v) and may_link(bits[a], bits[b], int(size[a]), int(size[b]), num, den):
                        trees.join(u, v)
                        us.append(u)
                        vs.append(v)
                        new += 1
                if new:
                    label = np.array([trees.find(x) for x in node.tolist()], np.int64)
                d += 1
            if us:
                yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], ["u", "v"])

    return run


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 4, num: int = 85, den: int = 100) -> DataFrame:
    """Per row: id, ``n_shingles``, ``component_id`` (the least id linked directly or through others).

    Null, empty and blank texts have no shingles and are linked with nothing. Ids are whole numbers; a null id is
    linked with nothing and has a null component. Rows that repeat an id get the component of their own text's class
    (one id with different texts joins those classes where it stands for them). An empty table gives no rows; extra columns are ignored.
    """
    _, _, rows, classes = _labelled(docs, id_col, text_col, n, num, den)
    return _by_row(rows, classes.select("fa", "fb", "component_id"), id_col)


def jaccard_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 4, num: int = 85, den: int = 100) -> DataFrame:
    """``jaccard_components`` with ``n_links``: the number of other classes (texts with another set of shingles) that the
    row's class links with directly, each counted once, inside its component too.

    Rows with a null id take no part; they have no links and are nobody's.
    """
    scratch, src, rows, classes = _labelled(docs, id_col, text_col, n, num, den)
    members = _dealt(classes)
    whole = scratch.cut(_with_sets(src, members, n))
    dealt = whole.withColumn("o", F.explode(F.expr("sequence(0, m - 1)"))).selectExpr("comp", "least(b, o) as i", "greatest(b, o) as j", "b", "node", "s")
    counts = scratch.cut(_meeting(dealt).mapInArrow(_count_links(num, den), "node long, n_links long").groupBy("node").agg(F.sum("n_links").alias("n_links")))
    scratch.drop(whole)
    return _by_row(rows, classes.join(counts, "node", "left").selectExpr("fa", "fb", "component_id", "coalesce(n_links, 0) as n_links"), id_col)


def _dealt(classes: DataFrame) -> DataFrame:
    """Classes (node, least, fa, fb, n, comp) of the groups ``comp`` of two at least, each group dealt in ``m`` blocks ``b``."""
    groups = classes.groupBy("comp").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("total")).filter("k > 1")
    groups = groups.selectExpr("comp", f"cast(greatest(ceil(k / {LINK_SETS}), ceil(total / {LINK_SHINGLES})) as int) as m")
    return classes.join(groups, "comp").selectExpr("fa", "fb", "node", "least", "comp", "m", "cast(pmod(xxhash64(node), m) as int) as b")


def _with_sets(src: DataFrame, members: DataFrame, n: int) -> DataFrame:
    """``members`` (node, fa, fb, least, comp, m, b) with their whole sets, from the texts of the rows with the id ``least``."""
    texts = src.join(members.selectExpr("least as id").distinct(), "id", "left_semi")
    sets = texts.mapInArrow(_packed_classes(n), "fa long, fb long, s binary").dropDuplicates(["fa", "fb"])
    return members.join(sets, ["fa", "fb"]).select("node", "comp", "m", "b", "s")


def _meeting(dealt: DataFrame) -> DataFrame:
    """Rows of (comp, i, j, ...) such that each two blocks' rows stand together in one task."""
    return dealt.repartition(shuffle_width(dealt.sparkSession), "comp", "i", "j").sortWithinPartitions("comp", "i", "j")


def _by_row(rows: DataFrame, by_class: DataFrame, id_col: str) -> DataFrame:
    out = rows.select("id", "fa", "fb", F.col("n").alias("n_shingles")).join(by_class, ["fa", "fb"], "left")
    links = [F.when(F.col("id").isNotNull(), F.coalesce("n_links", F.lit(0))).otherwise(0).alias("n_links")] if "n_links" in by_class.columns else []
    return out.select(F.col("id").alias(id_col), "n_shingles", F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id")).alias("component_id"), *links)


def _labelled(docs: DataFrame, id_col: str, text_col: str, n: int, num: int, den: int) -> tuple[Scratch, DataFrame, DataFrame, DataFrame]:
    """The scratch tables' keeper, (id, text), a row per document with its class, and a row per class (fa, fb): ``node``, ``n``, ``least``, ``comp``, ``component_id``."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "jaccard")
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    bins = src.select("text").mapInArrow(_count_bins(n), "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n")).toArrow()  # at most 2**18 + 17 rows
    at, many = bins.column("bin").to_numpy(), bins.column("n").to_numpy()
    weight = np.zeros(1 << BIN_BITS, np.int64)
    weight[at[at >= 0]] = many[at >= 0]
    x = light_boundary({int(-1 - k): int(c) for k, c in zip(at[at < 0], many[at < 0], strict=True)}, num, den)
    shared = spark.sparkContext.broadcast((x, np.minimum(weight, 2**31 - 1).astype(np.int32)))
    made = scratch.cut(src.mapInArrow(_sets(n, shared, num, den), "id long, fa long, fb long, n long, keys array<long>, pos array<int>, bits binary"))
    shared.destroy()
    # One row and one number per class. Each task gave a class's keys once; any of them will do.
    one = F.min_by(F.struct("keys", "pos", "bits"), F.expr("if(keys is null, null, id)")).alias("k")
    keyed = made.filter("id is not null and n > 0").groupBy("fa", "fb").agg(one, F.min("id").alias("least"), F.max("n").alias("n"))
    keyed = scratch.cut(keyed.select(F.monotonically_increasing_id().alias("node"), "fa", "fb", "least", "n", "k.keys", "k.pos", "k.bits"))
    rows = scratch.cut(made.select("id", "fa", "fb", "n"))
    scratch.drop(made)
    classes = keyed.select("node", "fa", "fb", "least", "n")

    entries = keyed.selectExpr("inline(arrays_zip(keys, pos))", "n", "node").selectExpr("keys as key", f"shiftleft(n, {POS_BITS}) | pos as sp", "node")
    several = entries.groupBy("key").agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
    lists = scratch.cut(entries.join(several, "key"))
    cells = lists.join(keyed.select("node", "bits"), "node").selectExpr("*", f"cast(ceil(c / {CELL}) as int) as m").withColumn("b", F.expr("cast(pmod(xxhash64(node), m) as int)"))
    cells = cells.withColumn("o", F.explode(F.expr("sequence(0, m - 1)"))).selectExpr("xxhash64(key, least(b, o), greatest(b, o)) as cell", "if(b = o, -1, b) as side", "sp", "node", "bits")
    edges = scratch.cut(_in_cells(cells).mapInArrow(_candidates(num, den), "u long, v long"))
    scratch.drop(lists)
    clusters = scratch.cut(connected_components(edges, scratch))
    scratch.drop(edges)
    comp = _linked(scratch, src, classes.join(clusters, "node"), n, num, den)
    scratch.drop(clusters)
    inside = scratch.cut(classes.join(comp, "node", "left").select("node", "fa", "fb", "least", "n", F.expr("coalesce(comp, node)").alias("comp")))
    scratch.drop(keyed)
    least = inside.groupBy("comp").agg(F.min("least").alias("component_id"))
    return scratch, src, rows, scratch.cut(inside.join(least, "comp").select("fa", "fb", "node", "least", "n", "comp", "component_id"))


def _linked(scratch: Scratch, src: DataFrame, clusters: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """(node, comp) of the classes with links, for ``clusters`` (node, fa, fb, least, n, comp) that hold every link."""
    members = _dealt(clusters)
    whole = scratch.cut(_with_sets(src, members, n))
    ring = "array_distinct(array(struct(b as i, b as j), struct(least(b, (b + 1) % m) as i, greatest(b, (b + 1) % m) as j), struct(least(b, (b + m - 1) % m) as i, greatest(b, (b + m - 1) % m) as j)))"
    first = _meeting(whole.selectExpr("comp", f"inline({ring})", "b", "node", "s").select("comp", "i", "j", "b", "node", "s"))
    links = scratch.cut(first.mapInArrow(_link_forest(num, den), "u long, v long"))
    comp = scratch.cut(connected_components(links, scratch))
    scratch.drop(links)
    wide = whole.filter("m > 3")
    if not wide.isEmpty():
        inside = wide.join(comp.selectExpr("node", "comp as c"), "node", "left").withColumn("c", F.expr("coalesce(c, node)"))
        sizes = inside.groupBy("comp", "c").agg(F.count(F.lit(1)).alias("k"), F.sum(F.octet_length("s") / 8).alias("total"))
        sizes = sizes.selectExpr("comp", "c", f"k >= {LINK_SETS} as own", f"cast(greatest(ceil(k / {LINK_SETS}), ceil(total / {LINK_SHINGLES})) as int) as blocks")
        # Large components have blocks of their own; the others share the cluster's mixed ones (owner -1).
        placed = inside.join(sizes, ["comp", "c"]).selectExpr("comp", "node", "s", "if(own, c, -1) as owner", "cast(if(own, pmod(xxhash64(node), blocks), pmod(xxhash64(c), m)) as int) as part")
        placed = scratch.cut(placed)
        table = placed.select("comp", "owner", "part").distinct().groupBy("comp").agg(F.array_sort(F.collect_list(F.struct("owner", "part"))).alias("every"))  # a cluster's blocks: its sets over LINK_SETS
        others = "filter(sequence(0, size(every) - 1), x -> owner < 0 or every[x].owner <> owner)"
        numbered = placed.join(table, "comp").selectExpr("comp", "node", "s", "cast(array_position(every, struct(owner, part)) - 1 as int) as b", f"explode({others}) as o")
        more = scratch.cut(_meeting(numbered.selectExpr("comp", "least(b, o) as i", "greatest(b, o) as j", "b", "node", "s")).mapInArrow(_link_forest(num, den), "u long, v long"))
        joined = scratch.cut(connected_components(comp.selectExpr("node as u", "comp as v").unionByName(more), scratch))
        scratch.drop(placed, more, comp)
        comp = joined
    scratch.drop(whole)
    return comp


def _in_cells(cells: DataFrame) -> DataFrame:
    by_size = F.expr(f"shiftright(sp, {POS_BITS})")
    return cells.select("cell", "side", "sp", "node", "bits").repartition(shuffle_width(cells.sparkSession), "cell").sortWithinPartitions("cell", by_size, "node")


def _class_of(s: np.ndarray) -> tuple[int, int]:
    d = xxhash.xxh3_128_digest(s.tobytes())
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def _packed_classes(n: int):
    """The sets of texts, each with its class."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free_caches()
        for whole in batches:
            for lot in range(0, whole.num_rows, 512):
                sets = list(shingle_sets(whole.slice(lot, 512).column(1), n))
                names = [_class_of(s) for s in sets]
                yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in names], pa.int64()), pa.array([b for _, b in names], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["fa", "fb", "s"])

    return run


def link_matrix(sets: list[np.ndarray], first: np.ndarray | None, num: int, den: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(left, right, which of them link): all sets on both sides, or those that ``first`` marks against the others."""
    lengths = np.array([len(s) for s in sets], np.int64)
    left = np.arange(len(sets)) if first is None else np.flatnonzero(first)
    right = left if first is None else np.flatnonzero(~first)
    if not len(left) or not len(right):
        return left, right, np.zeros((len(left), len(right)), bool)
    if len(sets) == 2:
        both = np.sort(np.concatenate(sets))
        common = int((both[1:] == both[:-1]).sum())
        link = common >= least_overlap(*lengths.tolist(), num, den)
        return left, right, np.array([[link]]) if first is not None else np.array([[False, link], [link, False]])
    row = np.repeat(np.arange(len(sets)), lengths)
    found, col = np.unique(np.concatenate(sets), return_inverse=True)
    if first is None:
        shared = np.bincount(col, minlength=len(found)) > 1
    else:
        at_first = first[row]
        shared = (np.bincount(col[at_first], minlength=len(found)) > 0) & (np.bincount(col[~at_first], minlength=len(found)) > 0)
    keep = shared[col]
    row, col = row[keep], (np.cumsum(shared) - 1)[col[keep]]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    common = np.zeros((len(left), len(right)))
    for at in range(0, int(shared.sum()), LINK_COLUMNS):
        lo, hi = np.searchsorted(col, [at, at + LINK_COLUMNS])
        has = np.zeros((len(sets), min(LINK_COLUMNS, int(shared.sum()) - at)), np.float32)
        has[row[lo:hi], col[lo:hi] - at] = 1
        common += has[left] @ has[right].T
    link = common >= least_overlap(lengths[left][:, None], lengths[right][None, :], num, den)
    if first is None:
        np.fill_diagonal(link, False)
    return left, right, link


def links_within(sets: list[np.ndarray], first: np.ndarray | None, num: int, den: int) -> np.ndarray:
    """Per set, its links with the others; where ``first`` marks the sets of one of two blocks, with those of the other block."""
    left, right, link = link_matrix(sets, first, num, den)
    out = np.zeros(len(sets), np.int64)
    out[right] = link.sum(0)
    out[left] = link.sum(1)
    return out


def forest_within(sets: list[np.ndarray], first: np.ndarray | None, num: int, den: int) -> np.ndarray:
    """Per set, the least set that its links within the block (or between the two) lead to, itself included."""
    left, right, link = link_matrix(sets, first, num, den)
    label = np.arange(len(sets))
    while link.any():
        before = label.copy()
        label[left] = np.minimum(label[left], np.where(link, label[right][None, :], len(sets)).min(1))
        label[right] = np.minimum(label[right], np.where(link, label[left][:, None], len(sets)).min(0))
        label = label[label]
        if (label == before).all():
            break
    return label


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, list[np.ndarray], np.ndarray | None]]:
    """Of rows (comp, i, j, b, node, s) sorted by the first three: each two blocks that meet, their sets, and which are of the first block."""
    key, held = None, []

    def block() -> tuple[pa.Table, list[np.ndarray], np.ndarray | None]:
        t = pa.Table.from_batches(held)
        return t, [np.frombuffer(x.as_buffer(), np.uint64) for x in t["s"]], None if key[1] == key[2] else t["b"].to_numpy() == key[1]

    for b in batches:
        if not b.num_rows:
            continue
        k = np.stack([b.column(c).to_numpy() for c in range(3)])
        cuts = [0, *(np.flatnonzero((k[:, 1:] != k[:, :-1]).any(0)) + 1).tolist(), b.num_rows]
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            now = tuple(k[:, lo].tolist())
            if held and now != key:
                yield block()
                held.clear()
            key = now
            held.append(b.slice(lo, hi - lo))
    if held:
        yield block()


def _batched(rows: Iterator[tuple[np.ndarray, np.ndarray]], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Two columns of whole numbers, gathered into batches of some thousand rows."""
    a, b, many = [], [], 0
    for x, y in rows:
        a.append(x)
        b.append(y)
        many += len(x)
        if many >= 4096:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names)
            a, b, many = [], [], 0
    if many:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names)


def _count_links(num: int, den: int):
    """Numbers of links of the sets of blocks i and j with each other."""
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        free_caches()
        for t, sets, first in _met(batches):
            n = links_within(sets, first, num, den)
            yield t["node"].to_numpy()[n > 0], n[n > 0]

    return lambda batches: _batched(counted(batches), ["node", "n_links"])


def _link_forest(num: int, den: int):
    """A forest of the links of the sets of blocks i and j with each other."""
    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        free_caches()
        for t, sets, first in _met(batches):
            root = forest_within(sets, first, num, den)
            node, some = t["node"].to_numpy(), np.flatnonzero(root != np.arange(len(sets)))
            yield node[some], node[root[some]]

    return lambda batches: _batched(linked(batches), ["u", "v"])
