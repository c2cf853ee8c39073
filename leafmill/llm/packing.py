"""Packing of token sequences by bin completion on a histogram of lengths (operator 2).

Each document's ids (and a closing id) are cut only where they exceed the capacity; then
pieces are packed. Only lengths matter for packing, so the corpus is reduced to at most
``capacity`` counts, which is all the driver sees at any corpus size. ``complete_bins``
packs the histogram: around the largest remaining length it enumerates the undominated
fillings one after the other, least waste first, prunes by the waste that a better solution
could still afford, and keeps the best-fit-decreasing packing as the first incumbent; a
filling is repeated as often as the counts allow (and less often on the way back), so the
work depends on the number of distinct lengths and not of documents. ``NODE_LIMIT`` and
``STEP_LIMIT`` bound it.
Pieces get their place by rank within their length, counted in salted groups.

Defined results: null or empty text is the closing id alone; a null ``doc_id`` is packed
like any other and keeps the null; repeated rows are packed each; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import sys
import zlib
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from leafmill.llm import _tokens
from leafmill.llm._common import map_batches, materialize, read_table

CAPACITY = 2048
END_ID = 0
#: Nodes of the search, steps of enumeration in all of them, and repeats of a filling that are tried one by one.
NODE_LIMIT, STEP_LIMIT, REPEATS = 10_000, 500_000, 8
#: Fillings of a node that the first rounds of the search try, and steps that a node's enumeration may take there.
WIDTHS = ((6, 1_000), (48, 5_000))
#: A length's pieces are ranked in groups of about so many.
ROWS_PER_SALT = 50_000

Bins = list[tuple[tuple[int, ...], int]]  # (lengths in one bin, number of such bins)


def best_fit_decreasing(counts: dict[int, int], capacity: int) -> Bins:
    """Best-fit decreasing on a histogram, for whole classes of equal bins at a time."""
    open_bins: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    free_sizes: list[int] = []

    def put(free: int, items: tuple[int, ...], n: int) -> None:
        if free not in open_bins:
            open_bins[free] = []
            insort(free_sizes, free)
        open_bins[free].append((items, n))

    for s in sorted(counts, reverse=True):
        c = counts[s]
        while c:
            at = bisect_left(free_sizes, s)
            if at == len(free_sizes):
                each = capacity // s
                full, rest = divmod(c, each)
                if full:
                    put(capacity - each * s, (s,) * each, full)
                if rest:
                    put(capacity - rest * s, (s,) * rest, 1)
                break
            free = free_sizes[at]
            items, n = open_bins[free].pop()
            if not open_bins[free]:
                del open_bins[free]
                free_sizes.pop(at)
            each = min(free // s, c)
            used = min(n, c // each)
            put(free - each * s, items + (s,) * each, used)
            if n > used:
                put(free, items, n - used)
            c -= each * used
    return [x for group in open_bins.values() for x in group]


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """The larger of the volume bound and Martello and Toth's bound for items above half a bin."""
    sizes = np.array(sorted(counts), np.int64)
    n = np.array([counts[s] for s in sizes], np.int64)
    if not len(sizes):
        return 0
    best = -(-int((sizes * n).sum()) // capacity)
    half = capacity / 2
    for k in {0, *(int(s) for s in sizes if s <= half)}:
        big = n[sizes > capacity - k].sum()
        mid = (sizes <= capacity - k) & (sizes > half)
        low = (sizes >= k) & (sizes <= half)
        room = int(n[mid].sum() * capacity - (sizes[mid] * n[mid]).sum())
        best = max(best, int(big + n[mid].sum()) + max(0, -(-(int((sizes[low] * n[low]).sum()) - room) // capacity)))
    return best


class _Steps:
    """How many steps a search may still take."""

    def __init__(self, left: int):
        self.left = left

    def take(self) -> bool:
        self.left -= 1
        return self.left >= 0


class _Room:
    """The undominated ways to fill ``room`` from ``left[size]`` counts, least waste first.

    A filling is dominated if an item that is left over could take the place of some of its
    items and of waste, so that the items which go fit into the one that comes. Items are chosen
    in descending order: an item that could replace some of them is larger than all that come
    later, so a choice that is dominated stays so, and the search goes no further there.
    Sums of chosen items are kept as bits of one integer. The enumeration ends early when
    ``steps`` are used up.
    """

    def __init__(self, left: np.ndarray, room: int, steps: _Steps | None = None):
        self.left, self.room, self.steps = left[: room + 1].tolist(), room, steps or _Steps(sys.maxsize)
        there = left[: room + 1] > 0
        self.sizes = np.flatnonzero(there)[::-1].tolist()
        bits = lambda x: int.from_bytes(np.packbits(x, bitorder="little").tobytes(), "little")
        self.there, self.mirror = bits(there), bits(there[::-1])  # bit s: size s, size room - s
        self.reach: list[int] = []

    def __iter__(self) -> Iterator[tuple[int, ...]]:
        if not self.sizes:
            yield ()
            return
        if sum(s * self.left[s] for s in self.sizes) <= self.room:
            yield tuple(s for s in self.sizes for _ in range(self.left[s]))
            return
        # An item is left over, and would be added if the waste had room for it.
        for waste in range(min(self.sizes[0], self.room)):
            if not self.steps.take():
                return
            total = self.room - waste
            yield from self._of_one_or_two(total, waste)
            yield from self._of_more(total, waste)

    def greedy(self) -> tuple[int, ...]:
        """Largest item first, each as often as it goes."""
        items, rest = [], self.room
        for s in self.sizes:
            each = min(self.left[s], rest // s)
            items += [s] * each
            rest -= s * each
        return tuple(items)

    def _with(self, chosen: tuple[int, int, int], s: int, waste: int, used: int) -> tuple[int, int, int] | None:
        """(sizes left over, chosen sizes, sums of two or more) once ``s`` is chosen for the ``used``-th time; None if dominated."""
        over, single, sums = chosen
        if used == self.left[s]:
            over &= ~(1 << s)
        sums |= (sums | single) << s
        single |= 1 << s
        if over >> (s + 1) & ((1 << waste) - 1):
            return None
        wide, more = sums, waste
        step = 1
        while more:  # every sum, and up to ``waste`` above it
            step = min(step, more)
            wide |= wide << step
            more, step = more - step, 2 * step
        return None if over & wide else (over, single, sums)

    @staticmethod
    def _fits_waste(over: int, waste: int) -> bool:
        return bool(over & ((2 << waste) - 1))

    def _undominated(self, filling: tuple[int, ...], waste: int) -> bool:
        chosen, used = (self.there, 0, 0), Counter()
        for s in filling:
            used[s] += 1
            chosen = chosen and self._with(chosen, s, waste, used[s])
        return chosen is not None and not self._fits_waste(chosen[0], waste)

    def _of_one_or_two(self, total: int, waste: int) -> Iterator[tuple[int, ...]]:
        if self.left[total] and self._undominated((total,), waste):
            yield (total,)
        # Bits b for which there are both b and total - b; the most even pair first.
        pairs = self.there & (self.mirror >> (self.room - total)) & ((2 << (total // 2)) - 1)
        while pairs and self.steps.take():
            b = pairs.bit_length() - 1
            pairs ^= 1 << b
            if b and (2 * b < total or self.left[b] > 1) and self._undominated((total - b, b), waste):
                yield total - b, b

    def _of_more(self, total: int, waste: int) -> Iterator[tuple[int, ...]]:
        """Fillings of three items or more that sum up to ``total``, by depth-first search among sums that can be reached."""
        if total < 3 * self.sizes[-1]:
            return
        if not self.reach:  # bit t of entry k: whether sizes from the k-th on can sum up to t
            mask = (1 << (self.room + 1)) - 1
            self.reach = [1]
            for s in reversed(self.sizes):
                sums, rest, step = self.reach[-1], min(self.left[s], self.room // s), 1
                while rest:
                    step = min(step, rest)
                    sums |= sums << (step * s) & mask
                    rest, step = rest - step, 2 * step
                self.reach.append(sums)
            self.reach.reverse()

        def search(k: int, rest: int, items: tuple[int, ...], chosen: tuple[int, int, int]) -> Iterator[tuple[int, ...]]:
            if not rest:
                if len(items) > 2 and not self._fits_waste(chosen[0], waste):
                    yield items
                return
            for at in range(bisect_left(self.sizes, -rest, lo=k, key=int.__neg__), len(self.sizes)):
                if not self.reach[at] >> rest & 1 or not self.steps.take():
                    return  # smaller ones cannot reach it either
                s, grown = self.sizes[at], [(items, chosen)]
                for used in range(1, min(self.left[s], rest // s) + 1):
                    more = self._with(grown[-1][1], s, waste, used)
                    if more is None:
                        break
                    grown.append((grown[-1][0] + (s,), more))
                for used in range(len(grown) - 1, 0, -1):
                    if self.reach[at + 1] >> (rest - used * s) & 1:
                        yield from search(at + 1, rest - used * s, *grown[used])

        yield from search(0, total, (), (self.there, 0, 0))


def complete_bins(
    counts: dict[int, int], capacity: int, node_limit: int = NODE_LIMIT, step_limit: int = STEP_LIMIT
) -> Bins:
    """Pack a histogram of lengths (1 to ``capacity``) into few bins.

    Depth-first branch and bound: at each node the largest length left is completed by each
    undominated filling, least waste first, as often as the counts allow. Rounds try the first
    fillings of a node (``WIDTHS``; the greedy one where none is found in their steps), and the
    last one all of them and each also less often (by one less up to ``REPEATS`` times, by half
    above), so that a search that no limit ends is exact where no filling repeats more often.
    The limits bound all rounds together; the incumbent is always a whole packing.
    """
    counts = {int(s): int(n) for s, n in counts.items() if n}
    best = best_fit_decreasing(counts, capacity)
    n_best, bound = sum(n for _, n in best), lower_bound(counts, capacity)
    volume = sum(s * n for s, n in counts.items())
    left = np.zeros(capacity + 1, np.int64)
    for s, n in counts.items():
        left[s] = n

    work = _Steps(step_limit)

    def fillings(rest: np.ndarray, room: int, width: int | None, steps: int | None) -> Iterator[tuple[int, ...]]:
        if width is None:
            yield from _Room(rest, room, work)
            return
        own = _Steps(steps)
        way = _Room(rest, room, own)
        found = 0
        for found, f in enumerate(islice(way, width), 1):
            yield f
        work.left -= steps - max(own.left, 0)
        if not found:
            yield way.greedy()

    def options(
        width: int | None, steps: int | None, without: tuple[int, ...] | None
    ) -> Iterator[tuple[tuple[int, ...], int]]:
        big = int(np.flatnonzero(left)[-1])
        rest = left.copy()
        rest[big] -= 1
        again = []
        for f in fillings(rest, capacity - big, width, steps):
            items = (big, *f)
            if items == without:  # taken less often at the node before
                continue
            n = min((int(rest[s]) + (s == big)) // k for s, k in Counter(items).items())
            yield items, n
            if width is None and n > 1:
                again.append((items, n))
        for items, n in again:
            while n > 1:
                n = n - 1 if n <= REPEATS else n // 2
                yield items, n

    nodes = 0
    for width, steps in (*WIDTHS, (None, None)):
        chosen: Bins = []
        stack = [options(width, steps, None)] if counts else []
        used = waste = 0
        while stack and nodes < node_limit and work.left > 0 and n_best > bound:
            if len(chosen) == len(stack):  # undo what the last option took
                items, n = chosen.pop()
                for s in items:
                    left[s] += n
                used -= n
                waste -= n * (capacity - sum(items))
            option = next(stack[-1], None)
            if option is None:
                stack.pop()
                continue
            items, n = option
            nodes += 1
            for s in items:
                left[s] -= n
            chosen.append((items, n))
            used += n
            waste += n * (capacity - sum(items))
            if waste > (n_best - 1) * capacity - volume:
                continue
            if not left.any():
                best, n_best = list(chosen), used
                continue
            stack.append(options(width, steps, items if width is None else None))
        for items, n in chosen:  # a round that a limit ended has bins open
            for s in items:
                left[s] += n
        if nodes >= node_limit or work.left <= 0 or n_best <= bound:
            break
    return best


def plan_of(bins: Bins) -> dict[str, np.ndarray]:
    """Where the piece of a given length and rank goes: intervals of ranks, sorted by length and rank."""
    rows, next_rank, sequence = [], Counter(), 0
    for items, n in bins:
        offset = 0
        for s, each in sorted(Counter(items).items(), reverse=True):
            rows.append((s, next_rank[s], each, sequence, offset))
            next_rank[s] += each * n
            offset += s * each
        sequence += n
    rows.sort()
    table = np.array(rows, np.int64).reshape(-1, 5)
    return {k: table[:, i].copy() for i, k in enumerate(("length", "rank", "each", "sequence", "offset"))}


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` ids: whole capacities, the first piece takes what is over."""
    first = n % capacity or min(n, capacity)
    return [(0, first), *((at, capacity) for at in range(first, n, capacity))]


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Encode every whole text and cut it; one row for each piece."""
    end = np.asarray([end_id], "<u4").tobytes()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _tokens.encoder(path)
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            texts = batch.column(1).to_pylist()
            for doc_id, ids in zip(batch.column(0).to_pylist(), enc.ids(texts), strict=True):
                ids += end
                for k, (start, length) in enumerate(cut(len(ids) // 4, capacity)):
                    crc = zlib.crc32(ids[4 * start : 4 * (start + length)])
                    for col, value in zip(out, (doc_id, k, start, length, crc), strict=True):
                        col.append(value)
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(out, types, strict=True)],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), encode, PIECES)


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row for each piece, with its sequence and its offset there."""
    spark = docs.sparkSession
    cuts = materialize(pieces(docs, path, capacity, end_id).withColumn("row", F.monotonically_increasing_id()), "pieces")
    histogram = {r["length"]: r["count"] for r in cuts.groupBy("length").count().collect()}
    plan = spark.sparkContext.broadcast(plan_of(complete_bins(histogram, capacity)))
    groups = F.lit([1 + histogram.get(n, 0) // ROWS_PER_SALT for n in range(capacity + 1)])
    own = F.get(groups, F.col("length").cast("int"))
    salted = cuts.withColumn("salt", F.pmod(F.xxhash64("row"), own))
    before = (
        salted.groupBy("length", "salt")
        .count()
        .select(
            "length",
            "salt",
            (F.sum("count").over(Window.partitionBy("length").orderBy("salt")) - F.col("count")).alias("before"),
        )
    )
    order = Window.partitionBy("length", "salt").orderBy("row")
    ranked = (
        salted.withColumn("place", F.row_number().over(order))
        .join(before, ["length", "salt"])
        .select(
            "doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("place") - 1).alias("rank")
        )
    )

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = plan.value
        key = (p["length"] << 44) | p["rank"]
        for batch in batches:
            length, rank = (batch.column(i).to_numpy(zero_copy_only=False) for i in (3, 5))
            at = np.searchsorted(key, (length << 44) | rank, side="right") - 1
            nth = rank - p["rank"][at]
            each = p["each"][at]
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[:5],
                    pa.array(p["sequence"][at] + nth // each, pa.int64()),
                    pa.array(p["offset"][at] + nth % each * length, pa.int64()),
                ],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    return map_batches(ranked, place, f"{PIECES}, sequence_id long, offset long")


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read_table(spark, sf_dir, "documents"), _tokens.tokenizer_path("byte_bpe_50k.json"))
