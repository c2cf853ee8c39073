"""Benchmark decontamination by greedy string tiling (operator 1).

Words are the lower-cased runs of letters, digits and underscores, told by 64 bits of hash.
Every document is searched for seeds, runs of ``MIN_TILE`` words that a benchmark item has
too, with a Karp-Rabin hash of each run against a table of the items' runs. The seeds that a
document shares are counted once each, however often they come up; items of which they cover
too little are out. For the others, tiling finds the length of the longest run that is free
on both sides by Karp-Rabin hashes of prefix sums and bisection, marks all matches of that
length (the earliest place in the item first, then in the document) and goes on until no
match of ``MIN_TILE`` words is left. Pairs of places are never listed, so a word that is
repeated a thousand times costs no more than others. A document is contaminated by an item
when tiles cover at least ``COVERAGE`` of the item's words, in any order and at any distance.

The benchmark is a stated query set: it is read in blocks of at most ``BLOCK_BYTES`` of
text, each broadcast once, and every block meets all documents where they are, without a
shuffle: one pass over the documents for each ``BLOCK_BYTES`` of benchmark. Documents are
never paired with each other.

Defined results: null or empty texts and items share nothing; items of fewer words than
a tile match as a whole; repeated rows (documents or items) give a pair each; empty tables
give an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm._common import map_batches, read_table, small_batches, tidy

MIN_TILE = 5
COVERAGE = 0.5
BLOCK_BYTES = 16 * 1024 * 1024
BASE = 0x9E3779B97F4A7C15
#: Bits of the filter of seeds for each seed, and at least.
FILTER_BITS_PER_SEED, MIN_FILTER_BITS = 16, 16

_WORD = re.compile(r"\w+")


class _WordHashes(dict):
    """Word to 64-bit hash; starts again empty beyond 300,000 words."""

    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) > 300_000:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def word_hashes(text: str | None, known: _WordHashes) -> np.ndarray:
    words = _WORD.findall((text or "").lower())
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def rolling(hashes: np.ndarray, n: int) -> np.ndarray:
    """Karp-Rabin hashes of all runs of ``n`` words, modulo 2^64."""
    size = len(hashes) - n + 1
    if size <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(size, np.uint64)
    for i in range(n):
        out = out * np.uint64(BASE) + hashes[i : i + size]
    return out


class Seeds:
    """The runs of ``n`` words of some items, sorted by hash, with a filter of their leading bits."""

    def __init__(self, runs: list[np.ndarray], items: list[int]):
        hashes = np.concatenate(runs)
        order = np.argsort(hashes, kind="stable")
        self.hashes = hashes[order]
        self.item = np.repeat(np.array(items), [len(r) for r in runs])[order]
        self.place = np.concatenate([np.arange(len(r)) for r in runs])[order]
        bits = max(MIN_FILTER_BITS, (FILTER_BITS_PER_SEED * len(hashes) - 1).bit_length())
        self.shift = np.uint64(64 - bits)
        marks = np.zeros(1 << bits, np.bool_)
        marks[hashes >> self.shift] = True
        self.marks = np.packbits(marks, bitorder="little")

    def shared(self, runs: np.ndarray) -> np.ndarray:
        """The numbers of all seeds that are among ``runs``."""
        slot = (runs >> self.shift).astype(np.int64)
        known = np.unique(runs[(self.marks[slot >> 3] >> (slot & 7).astype(np.uint8) & 1).astype(np.bool_)])
        low = np.searchsorted(self.hashes, known, "left")
        n = np.searchsorted(self.hashes, known, "right") - low
        return np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())


class Index:
    """The seeds of a block of items (item_id, text)."""

    def __init__(self, items: list[tuple[int | None, str | None]], min_tile: int = MIN_TILE):
        known = _WordHashes()
        self.ids = [i for i, _ in items]
        self.words = [word_hashes(t, known) for _, t in items]
        self.tile = [min(min_tile, len(w)) for w in self.words]
        self.by_length: dict[int, Seeds] = {}
        for n in sorted(set(self.tile) - {0}):
            of = [k for k, t in enumerate(self.tile) if t == n]
            self.by_length[n] = Seeds([rolling(self.words[k], n) for k in of], of)

    def reached(self, words: np.ndarray) -> dict[int, int]:
        """Item to how many of its words lie in runs that ``words`` has too."""
        found: dict[int, int] = {}
        for n, seeds in self.by_length.items():
            hits = seeds.shared(rolling(words, n))
            if len(hits):
                item, place = seeds.item[hits], seeds.place[hits]
                order = np.lexsort((place, item))
                item, place = item[order], place[order]
                first = np.flatnonzero(np.diff(item, prepend=-1))
                new = np.minimum(np.diff(place, append=0), n)
                new[np.append(first[1:], len(item)) - 1] = n
                found |= zip(item[first].tolist(), np.add.reduceat(new, first).tolist(), strict=True)
        return found


class _Side:
    """One side of a tiling: words, which of them are free, and hashes of free runs of any length."""

    def __init__(self, words: np.ndarray, free: np.ndarray, powers: np.ndarray):
        self.words, self.free, self.powers = words, free, powers
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * powers[: len(words)])])

    def runs(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and hashes of the free runs of ``length`` words, in order."""
        taken = np.concatenate([[0], np.cumsum(~self.free)])
        at = np.flatnonzero(taken[length:] == taken[:-length])
        return at, (self.sums[at + length] - self.sums[at]) * self.powers[len(self.powers) - 1 - at]

    def longest_free(self) -> int:
        edges = np.flatnonzero(np.diff(np.concatenate([[False], self.free, [False]])))
        return int((edges[1::2] - edges[::2]).max(initial=0))


def _longest_common(a: _Side, b: _Side, least: int, most: int) -> int:
    """The length of the longest free run of both, which is at most ``most``; 0 if none has ``least`` words.

    Looks from ``most`` down in growing steps, as the next length is often close to the last one.
    """
    most = min(most, a.longest_free(), b.longest_free())
    common = lambda n: bool(np.isin(a.runs(n)[1], b.runs(n)[1]).any())
    if most < least or not common(least):
        return 0
    low, above, step = most, most + 1, 1
    while low > least and not common(low):
        low, above, step = max(least, most - step), low, 2 * step
    while above - low > 1:
        mid = (low + above) // 2
        low, above = (mid, above) if common(mid) else (low, mid)
    return low


def tiles(doc: np.ndarray, item: np.ndarray, n: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (place in doc, place in item, length) of tiles of at least ``n`` words."""
    shared = np.zeros(len(doc) + 1, np.int64)
    at = np.flatnonzero(np.isin(rolling(doc, n), rolling(item, n)))
    np.add.at(shared, at, 1)
    np.add.at(shared, at + n, -1)
    inside = np.cumsum(shared)[:-1] > 0
    kept = np.flatnonzero(inside | np.concatenate([[False], inside[:-1]]))  # a word behind each stretch keeps them apart
    powers = np.full(max(len(kept), len(item)) + 1, BASE, np.uint64)
    powers[0] = 1
    powers = np.cumprod(powers, dtype=np.uint64)
    ours = _Side(doc[kept], inside[kept], powers)
    theirs = _Side(item, np.ones(len(item), np.bool_), powers)
    found: list[tuple[int, int, int]] = []
    length = min(len(kept), len(item))
    while length := _longest_common(ours, theirs, n, length):
        waiting: dict[int, list[int]] = {}
        places, hashes = ours.runs(length)
        same = np.isin(hashes, theirs.runs(length)[1])
        for d, h in zip(places[same][::-1].tolist(), hashes[same][::-1].tolist(), strict=True):
            waiting.setdefault(h, []).append(d)
        before = len(found)
        for i, h in zip(*(x.tolist() for x in theirs.runs(length)), strict=True):
            # Of equally long runs those that meet a marked one have a marked end.
            while theirs.free[i] and theirs.free[i + length - 1] and waiting.get(h):
                d = waiting[h].pop()
                if ours.free[d] and ours.free[d + length - 1] and np.array_equal(ours.words[d : d + length], item[i : i + length]):
                    ours.free[d : d + length] = theirs.free[i : i + length] = False
                    found.append((int(kept[d]), i, length))
        if len(found) == before:  # hashes of runs met, their words did not
            break
    return found


def matches(text: str | None, index: Index, known: _WordHashes, coverage: float) -> list[tuple[int, int, int, int]]:
    """(item's number, words of the item, words covered, tiles) of every item that covers enough."""
    words = word_hashes(text, known)
    out = []
    for k, reach in sorted(index.reached(words).items()):
        size = len(index.words[k])
        if reach < coverage * size:
            continue
        got = tiles(words, index.words[k], index.tile[k])
        covered = sum(t[2] for t in got)
        if covered >= coverage * size:
            out.append((k, size, covered, len(got)))
    return out


def blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[list[tuple[int | None, str | None]]]:
    """The items in blocks of bounded size, read one partition at a time."""
    block, size = [], 0
    for row in benchmark.select("item_id", "text").toLocalIterator():
        n = len((row["text"] or "").encode())
        if block and size + n > block_bytes:
            yield block
            block, size = [], 0
        block.append((row["item_id"], row["text"]))
        size += n
    if block:
        yield block


PAIRS = "doc_id long, item_id long, n_item_words long, n_covered_words long, n_tiles long, coverage double"


def contaminated_pairs(
    docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, min_tile: int = MIN_TILE
) -> DataFrame:
    """One row for each document and item that contaminates it."""
    spark = docs.sparkSession
    found = spark.createDataFrame([], PAIRS)
    for block in blocks(benchmark):
        shared = spark.sparkContext.broadcast(Index(block, min_tile))

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index, known = shared.value, _WordHashes()
            for batch in batches:
                out: list[list] = [[], [], [], [], [], []]
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    for k, size, covered, n in matches(text.as_py(), index, known, coverage):
                        row = (doc_id, index.ids[k], size, covered, n, round(covered / size, 6))
                        for col, value in zip(out, row, strict=True):
                            col.append(value)
                types = [pa.int64()] * 5 + [pa.float64()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(out, types, strict=True)],
                    ["doc_id", "item_id", "n_item_words", "n_covered_words", "n_tiles", "coverage"],
                )

        found = found.unionByName(map_batches(docs.select(F.col("doc_id").cast("long"), "text"), search, PAIRS))
    return found


def _clean(shared, coverage: float):
    @F.pandas_udf("boolean")
    def clean(texts: pd.Series) -> pd.Series:
        known = _WordHashes()
        got = pd.Series([not matches(t, shared.value, known, coverage) for t in texts], dtype=bool)
        tidy()
        return got

    return clean


def decontaminated(
    docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, min_tile: int = MIN_TILE
) -> DataFrame:
    """The rows of ``docs`` that no item contaminates."""
    spark, kept = docs.sparkSession, docs
    small_batches(spark)
    for block in blocks(benchmark):
        shared = spark.sparkContext.broadcast(Index(block, min_tile))

        kept = kept.where(_clean(shared, coverage)(F.col("text")))
    return kept


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated_pairs(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
