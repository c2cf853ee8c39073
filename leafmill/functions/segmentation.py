"""Word segmentation of text without blanks: a unigram lexicon learned from the text, and its best path.

A run of letters is a lattice: an edge for every piece that the lexicon has, and one for each single
character. ``learn`` starts from the frequent pieces of all texts, found length by length (a piece can
only be frequent if what is left without its first or last character is), and repeats two steps.
Expectation: every task sums, over its lattices, how often each word is expected to be used; Spark adds
the sums up. Maximisation: these are the new frequencies, and a word goes that does not pay for
itself, that is, whose best other reading costs less than spelling it out in the lexicon
(minimum description length). ``segmented`` takes the best path through each lattice.

The lexicon has at most ``MAX_WORDS`` words, which bounds what is sent to tasks and back. Lattices
of many runs are computed at once with numpy, in slabs of ``SLAB`` edges.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructType

from leafmill.functions.chunks import few_at_once
from leafmill.storage import cores, materialize

MAX_WORDS, MAX_LENGTH, MIN_COUNT = 60_000, 10, 8
ROUNDS, STEPS = 3, 2
SLAB = 1 << 21
BASE = 0x9E3779B97F4A7C15 | 1
#: Brings the last characters into the highest bits, by which hashes are looked up.
MIX = 0xD6E8FEB86659FD93
#: What a character that the lexicon does not have costs more than its rarest word, in nats.
UNKNOWN = 5.0
#: Nats that a product of probabilities may lose before it is divided; numbers have some 700.
RANGE = 600.0

_RUN = re.compile(r"[^\W\d_]+")


def runs_of(text: str | None) -> list[str]:
    """Runs of letters, in lower case."""
    return _RUN.findall((text or "").lower())


def spans(words: list[str]) -> set[tuple[int, int]]:
    """(begin, end) of each word among the characters of all."""
    out, at = set(), 0
    for w in words:
        out.add((at, at := at + len(w)))
    return out


def common_spans(some: np.ndarray, others: np.ndarray) -> int:
    """How many words two texts have in the same place, from the lengths of their words."""
    some, others = np.append(0, np.cumsum(some)), np.append(0, np.cumsum(others))
    _, at, at_other = np.intersect1d(some, others, assume_unique=True, return_indices=True)
    return int(np.count_nonzero((np.diff(at) == 1) & (np.diff(at_other) == 1)))


def _grid(runs: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of runs, one column each, 0 after their ends, and their lengths."""
    lengths = np.fromiter(map(len, runs), np.int64, len(runs))
    codes = np.zeros((len(runs), int(lengths.max(initial=0))), np.uint64)
    codes[np.arange(codes.shape[1]) < lengths[:, None]] = _codes(runs)
    return np.ascontiguousarray(codes.T), lengths


def _codes(runs: list[str]) -> np.ndarray:
    """Code points of all runs, one after another."""
    return np.frombuffer("".join(runs).encode("utf-32-le", "surrogatepass"), np.uint32)


def _hashes(codes: np.ndarray) -> Iterator[np.ndarray]:
    """Hashes of all pieces of 1, 2, ... characters, by the place on the first axis where they begin."""
    letters = codes.astype(np.uint64) + np.uint64(1)
    out = letters
    for size in range(1, len(codes) + 1):
        yield out * np.uint64(MIX)
        out = out[:-1] * np.uint64(BASE) + letters[size:]


def _beginnings(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(numbers of the words of at least 1, 2, ... characters, hashes of so many first ones)."""
    codes, lengths = _grid(words)
    for size, hashes in enumerate(_hashes(codes), 1):
        long = np.flatnonzero(lengths >= size)
        yield long, hashes[0][long]


def _word_hashes(words: list[str]) -> np.ndarray:
    out = np.empty(len(words), np.uint64)
    for long, hashes in _beginnings(words):
        out[long] = hashes
    return out


class Places:
    """Where each of some sorted hashes is: a table by their highest bits says where to begin."""

    def __init__(self, hashes: np.ndarray):
        bits = max(1, min(22, int(8 * len(hashes) + 1).bit_length()))
        self.size, self.shift = len(hashes), np.uint64(64 - bits)
        self.hashes = np.append(hashes, np.uint64(0xFFFFFFFFFFFFFFFF))
        self.first = np.searchsorted(hashes >> self.shift, np.arange(1 << bits, dtype=np.uint64)).astype(np.int32)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Places, -1 for what is not there."""
        flat = hashes.ravel()
        place = self.first.take((flat >> self.shift).view(np.int64))
        found = self.hashes.take(place)
        out = np.where(found == flat, place, -1)
        left = np.flatnonzero(found < flat)
        place, own = place[left], flat[left]
        while len(left):
            place = place + 1
            found = self.hashes[place]
            same = found == own
            out[left[same]] = place[same]
            more = found < own
            left, place, own = left[more], place[more], own[more]
        out[out == self.size] = -1
        return out.reshape(hashes.shape)


class Lexicon:
    """Words and their log probabilities."""

    def __init__(self, words: list[str], log_p: np.ndarray):
        hashes = _word_hashes(words)
        order = np.argsort(hashes, kind="stable")
        self.words, self.log_p = [words[i] for i in order], np.asarray(log_p, float)[order]
        self.longest = max(map(len, words), default=1)
        self.unknown = (float(self.log_p.min()) if words else 0.0) - UNKNOWN
        # A piece is looked up only where its first characters are those of a word.
        begun = np.unique(np.concatenate([np.empty(0, np.uint64), *(h for _, h in _beginnings(words))]))
        self.begun, self.word = Places(begun), np.full(len(begun), -1, np.int64)
        self.word[np.searchsorted(begun, hashes[order])] = np.arange(len(words))

    def lattices(self, runs: list[str]) -> Iterator[Lattice]:
        """Lattices of ``runs``, those of like length together."""
        order = sorted(range(len(runs)), key=lambda i: len(runs[i]))
        a = 0
        while a < len(order):
            b = a + 1
            while b < len(order) and (b - a + 1) * len(runs[order[b]]) * self.longest <= SLAB:
                b += 1
            yield Lattice(self, order[a:b], [runs[i] for i in order[a:b]])
            a = b


class Lattice:
    """The lattices of some runs: ``edges[l - 1]`` has the places of words of ``l`` characters, and the words.

    A place is a number in a table with a row for each character and a column for each run.
    """

    def __init__(self, lexicon: Lexicon, numbers: list[int], runs: list[str], whole: bool = True):
        self.lexicon, self.numbers, self.runs = lexicon, numbers, runs
        codes, self.lengths = _grid(runs)
        self.width, n = codes.shape
        self.inside = np.arange(self.width)[:, None] < self.lengths
        at, self.edges = np.flatnonzero(self.inside), []
        for size, hashes in enumerate(_hashes(codes), 1):
            at = at[: np.searchsorted(at, hashes.size)]
            place = lexicon.begun.find(hashes.ravel().take(at))
            begun = place >= 0
            at = at[begun]
            word = lexicon.word.take(place[begun])
            is_word = word >= 0
            if not whole:
                is_word &= (at >= n) | (self.lengths[at % n] > size)
            self.edges.append((at[is_word], word[is_word]))
            if size == lexicon.longest:
                break
        if not whole:
            self.inside &= self.lengths > 1

    def _filled(self, values: np.ndarray, unknown: float, none: float) -> np.ndarray:
        """By size, place and run: the values of the words that begin there, ``none`` where there is no word."""
        out = np.full((len(self.edges), *self.inside.shape), none)
        if len(out):
            out[0][self.inside] = unknown
        for by_place, (at, word) in zip(out, self.edges, strict=True):
            by_place.reshape(-1)[at] = values[word]
        return out

    def best(self) -> tuple[np.ndarray, np.ndarray]:
        """(log probability, length of the last word) of the best path to every place; the shorter last word on ties."""
        n, width, sizes = len(self.runs), self.width, len(self.edges)
        ways = np.full((width + 1, sizes, n), -np.inf)
        for size, cost in enumerate(self._filled(self.lexicon.log_p, self.lexicon.unknown, -np.inf), 1):
            ways[size:, size - 1] = cost[: width + 1 - size]
        score, back = np.full((width + 1 + sizes, n), -np.inf), np.zeros((width + 1, n), np.int64)
        score[sizes] = 0
        for t in range(1, width + 1):
            way = score[t : t + sizes][::-1] + ways[t]
            back[t] = best = way.argmax(axis=0)
            score[sizes + t] = way[best, np.arange(n)]
        back[1:] = np.where(np.isfinite(score[sizes + 1 :]), back[1:] + 1, 0)
        return np.ascontiguousarray(score[sizes:].T), np.ascontiguousarray(back.T)

    def ends(self) -> tuple[np.ndarray, np.ndarray]:
        """(run's place in ``runs``, place) of the ends of all words on the best paths."""
        _, back = self.best()
        run, at, out = np.arange(len(self.runs)), self.lengths, []
        while len(run):
            out.append((run, at))
            at = at - back[run, at]
            run, at = run[at > 0], at[at > 0]
        return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (run, at)

    def words(self) -> Iterator[tuple[int, list[str]]]:
        """(number of the run, its words on the best path)."""
        of, ends = self.ends()
        order = np.lexsort((ends, of))
        ends = np.split(ends[order], np.searchsorted(of[order], np.arange(1, len(self.runs))))
        for number, run, stops in zip(self.numbers, self.runs, ends, strict=True):
            yield number, [run[a:b] for a, b in zip([0, *stops.tolist()], stops.tolist(), strict=False)]

    def expected(self, times: np.ndarray) -> np.ndarray:
        """How often each word is expected in the runs, each of which stands there ``times``.

        Probabilities are summed as they are. Every ``step`` places those ahead are divided by what was reached, and so are, on
        the way back, those behind: between two divisions no path loses more than ``RANGE`` nats.
        """
        sizes, width = len(self.edges), self.width
        least = -min(self.lexicon.unknown, 0)
        step = int(RANGE / max(least, 1)) - sizes
        if step < 1:
            return self._expected_by_logarithms(times)
        runs = np.arange(len(self.runs))
        share = self._filled(np.exp(self.lexicon.log_p), math.exp(self.lexicon.unknown), 0.0)
        ahead, behind = np.zeros((2, width + 1 + sizes, len(runs)))
        ahead[0] = 1
        part, divided = np.empty((sizes, len(runs))), {}
        for t in range(width):
            if t and t % step == 0:
                divided[t] = np.where(ahead[t] > 0, ahead[t], 1)
                ahead[t : t + sizes] /= divided[t]
            np.multiply(share[:, t], ahead[t], out=part)
            ahead[t + 1 : t + 1 + sizes] += part
        behind[self.lengths, runs] = times / ahead[self.lengths, runs]
        for t in range(width - 1, -1, -1):
            np.multiply(share[:, t], behind[t + 1 : t + 1 + sizes], out=part)
            behind[t] += part.sum(axis=0)
            np.multiply(part, ahead[t], out=share[:, t])
            if t in divided:
                behind[t : t + sizes] /= divided[t]
        return self._by_word(share)

    def _by_word(self, share: np.ndarray) -> np.ndarray:
        out = np.zeros(len(self.lexicon.words))
        for by_place, (at, word) in zip(share, self.edges, strict=True):
            out += np.bincount(word, by_place.reshape(-1)[at], len(out))
        return out

    def _expected_by_logarithms(self, times: np.ndarray) -> np.ndarray:
        """``expected`` for probabilities so small, or words so long, that products leave the range of numbers."""
        sizes, width, runs = len(self.edges), self.width, np.arange(len(self.runs))
        cost = self._filled(self.lexicon.log_p, self.lexicon.unknown, -np.inf)
        ahead, behind = np.full((2, width + 1 + sizes, len(runs)), -np.inf)
        ahead[0] = 0
        for t in range(width):
            ahead[t + 1 : t + 1 + sizes] = np.logaddexp(ahead[t + 1 : t + 1 + sizes], cost[:, t] + ahead[t])
        with np.errstate(divide="ignore"):
            behind[self.lengths, runs] = np.log(times) - ahead[self.lengths, runs]
        for t in range(width - 1, -1, -1):
            part = cost[:, t] + behind[t + 1 : t + 1 + sizes]
            behind[t] = np.logaddexp(behind[t], np.logaddexp.reduce(part, axis=0))
            cost[:, t] = np.exp(part + ahead[t])
        return self._by_word(cost)


def _runs_table(texts: DataFrame, text: str) -> DataFrame:
    """(run, n): every distinct run of the texts and how often it stands there, written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = Counter(r for t in batch.column(0).to_pylist() for r in runs_of(t))
            yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], ["run", "n"])

    counted = texts.select(text).mapInArrow(run, "run string, n long")
    # Tasks by the cores too: every pass over the runs takes long, however few bytes they have.
    spark = texts.sparkSession
    parts = max(3 * (cores(spark) or 1), int(spark.conf.get("spark.sql.shuffle.partitions")))
    return materialize(counted.repartition(parts, "run").groupBy("run").agg(F.sum("n").alias("n")), "runs")


def _pieces(runs: DataFrame, size: int, shorter: np.ndarray | None) -> DataFrame:
    """(piece, n): occurrences of pieces of ``size`` characters whose two shorter pieces are in ``shorter``."""

    known_pieces = Places(shorter) if shorter is not None else None

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, times = batch.column(0).to_pylist(), batch.column(1).to_numpy()
            for a, b in _slabs(texts):
                flat = "\0".join(texts[a:b])
                codes = _codes([flat])
                own = np.repeat(times[a:b], np.fromiter(map(len, texts[a:b]), np.int64, b - a) + 1)
                hashes = _hashes(codes)
                if shorter is None:
                    found, at = next(hashes), np.flatnonzero(codes)
                else:
                    # What has a bound in it is no known piece.
                    known = known_pieces.find(next(islice(hashes, size - 2, None), codes[:0].astype(np.uint64))) >= 0
                    found, at = next(hashes, known), np.flatnonzero(known[:-1] & known[1:])
                found = found[at]
                order = np.argsort(found)
                first = np.flatnonzero(np.diff(found[order], prepend=~found[order[:1]]))
                n = np.add.reduceat(own[at[order]], first) if len(first) else own[:0]
                names = [flat[c : c + size] for c in at[order[first]].tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(n)], ["piece", "n"])

    return runs.mapInArrow(count, "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n"))


def _slabs(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Bounds of neighbours of at most ``SLAB`` characters, or one text."""
    a = total = 0
    for b, text in enumerate(texts):
        if b > a and total + len(text) > SLAB:
            yield a, b
            a, total = b, 0
        total += len(text)
    if a < len(texts):
        yield a, len(texts)


def frequent_pieces(runs: DataFrame, min_count: int = MIN_COUNT, longest: int = MAX_LENGTH, most: int = MAX_WORDS) -> dict[str, int]:
    """Every character, and the most frequent pieces of up to ``longest`` characters, ``most`` in all."""
    found: dict[str, int] = {}
    shorter = None
    for size in range(1, longest + 1):
        counted = _pieces(runs, size, shorter)
        if size > 1:
            counted = counted.where(F.col("n") >= min_count)
        rows = counted.orderBy(F.desc("n"), "piece").limit(most).toArrow()
        if not len(rows):
            break
        new = dict(zip(rows["piece"].to_pylist(), rows["n"].to_pylist(), strict=True))
        found |= new
        shorter = np.sort(_word_hashes([w for w, n in new.items() if n >= min_count]))
    kept = sorted(found, key=lambda w: (len(w) > 1, -found[w] * len(w), w))[:most]
    return {w: found[w] for w in kept}


def expected_counts(runs: DataFrame, lexicon: Lexicon) -> np.ndarray:
    """How often each word of the lexicon is expected in all runs."""
    shared = runs.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(shared.value.words))
        for batch in batches:
            texts, times = batch.column(0).to_pylist(), batch.column(1).to_numpy()
            for lattice in shared.value.lattices(texts):
                total += lattice.expected(times[lattice.numbers])
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["word", "n"])

    out = np.zeros(len(lexicon.words))
    summed = runs.mapInArrow(run, "word long, n double").groupBy("word").agg(F.sum("n").alias("n")).toArrow()
    out[summed["word"].to_numpy()] = summed["n"].to_numpy()
    shared.destroy()
    return out


def paying(lexicon: Lexicon, counts: np.ndarray) -> np.ndarray:
    """Which words save more than they cost: single characters, and words whose uses would cost more otherwise."""
    keep = np.array([len(w) == 1 for w in lexicon.words], bool)
    letters = sum(keep.tolist()) or 1
    long = np.flatnonzero(~keep)
    other = np.empty(len(long))
    for a in range(0, len(long), 4096):
        names = [lexicon.words[i] for i in long[a : a + 4096]]
        lattice = Lattice(lexicon, list(range(len(names))), names, whole=False)
        other[a : a + 4096] = lattice.best()[0][np.arange(len(names)), lattice.lengths]
    saved = counts[long] * (lexicon.log_p[long] - other)
    spelled = np.array([(len(lexicon.words[i]) + 1) * math.log(letters + 1) for i in long])
    keep[long] = saved > spelled
    return keep


def _estimated(words: list[str], counts: np.ndarray) -> Lexicon:
    used = np.maximum(counts, 1e-3)
    return Lexicon(words, np.log(used / used.sum()))


def learn(texts: DataFrame, text: str = "text", min_count: int = MIN_COUNT, longest: int = MAX_LENGTH, rounds: int = ROUNDS) -> Lexicon:
    """A lexicon of the words of ``texts``, whose blanks, if any, are taken as bounds of runs only."""
    runs = _runs_table(texts, text)
    pieces = frequent_pieces(runs, min_count, longest)
    lexicon = _estimated(list(pieces), np.array(list(pieces.values()), float))
    for _ in range(rounds):
        for _ in range(STEPS):
            counts = expected_counts(runs, lexicon)
            lexicon = _estimated(lexicon.words, counts)
        counts = expected_counts(runs, lexicon)
        keep = paying(lexicon, counts)
        lexicon = _estimated([w for w, k in zip(lexicon.words, keep, strict=True) if k], counts[keep])
    return lexicon


def _split(lexicon: Lexicon, texts: list[list[str]]) -> pa.ListArray:
    """The words of each text, given as its runs."""
    runs = [r for text in texts for r in text]
    stop = np.append(0, np.cumsum(np.fromiter(map(len, runs), np.int64, len(runs))))
    is_end = np.zeros(int(stop[-1]) + 1, bool)
    for lattice in lexicon.lattices(runs):
        of, end = lattice.ends()
        is_end[stop[np.array(lattice.numbers)[of]] + end] = True
    ends = np.append(0, np.flatnonzero(is_end))
    width = sum((_codes(runs) >= least).astype(np.int64) for least in (0, 1 << 7, 1 << 11, 1 << 16))
    letters = np.append(0, np.cumsum(width))[ends].astype(np.int32)
    data = pa.py_buffer("".join(runs).encode())
    words = pa.Array.from_buffers(pa.string(), len(ends) - 1, [None, pa.py_buffer(letters), data])
    texts_end = stop[np.cumsum([0, *map(len, texts)])]
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(ends, texts_end), pa.int32()), words)


def segmented(texts: DataFrame, lexicon: Lexicon, text: str = "text", as_col: str = "words") -> DataFrame:
    """``texts`` with the words of every whole text in order, in lower case; null and empty texts have none."""
    shared = texts.sparkSession.sparkContext.broadcast(lexicon)
    at = texts.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a = 0
            for part in few_at_once(batch.column(at).to_pandas()):
                column = _split(shared.value, [runs_of(t) for t in part])
                yield pa.RecordBatch.from_arrays([*batch.slice(a, len(part)).columns, column], [*batch.schema.names, as_col])
                a += len(part)

    return texts.mapInArrow(run, StructType(list(texts.schema)).add(as_col, ArrayType(StringType())))
