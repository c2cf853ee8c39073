"""Extractive summaries and keyphrases by ranks on graphs inside each document.

Summaries: sentences are alike by the cosine of their words' counts, weighed by how few sentences of the
document have them; the ranks are those of a walk that goes to a sentence as often as it is alike. The matrix of
likenesses is never made: a step of the walk goes from sentences to words and back over the
document's postings, so a step costs what the document has words.

Keyphrases: words within ``WINDOW`` of each other in a run are linked as often as they are; the walk starts again at words
the more often, the earlier they stand. All documents of a part of a batch are ranked at once, as one graph whose parts
do not touch. A phrase is a run of words that are no stop words, its score the sum of its words' ranks. ``runs_of``,
``word_ranks`` and ``best_phrases`` tell what is found, text by text; ``keyphrases`` finds the same in arrays of characters
and of words' numbers, and makes strings of the best phrases only.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import cache, partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

DAMPING, STEPS = 0.85, 30
WINDOW, PHRASE_WORDS, COMMON_SHARE = 4, 3, 0.5
ROUND = 9
#: Texts are split into words in parts of a batch of about so many bytes; a longer text is a part of its own.
PART_BYTES = 1 << 19

_SENTENCE = re.compile(r"[^.!?。！？\n]*[.!?。！？]+|[^.!?。！？\n]+")
_WORD = re.compile(r"[一-鿿]|[^\W\d_]+")


def sentences_of(text: str) -> list[str]:
    """Sentences without the blanks around them; one ends at a full stop, '!', '?' or the end of a line."""
    return [s for s in (m.strip() for m in _SENTENCE.findall(text)) if _WORD.search(s)]


def sentence_ranks(sentences: list[str]) -> np.ndarray:
    """The rank of each sentence; equal ones where no two have a word in common."""
    n = len(sentences)
    if n < 2:
        return np.ones(n)
    numbers: dict[str, int] = {}
    words = [[numbers.setdefault(w, len(numbers)) for w in _WORD.findall(s.lower())] for s in sentences]
    row = np.repeat(np.arange(n), [len(w) for w in words])
    pair, count = np.unique(row * len(numbers) + np.concatenate(words), return_counts=True)
    row, word = np.divmod(pair, len(numbers))
    in_sentences = np.bincount(word, minlength=len(numbers))
    value = count * np.log(n / in_sentences)[word]
    length = np.sqrt(np.bincount(row, value * value, n))
    value = value / np.where(length > 0, length, 1)[row]

    def alike(x: np.ndarray) -> np.ndarray:
        """Sums over the other sentences of their likeness times ``x``."""
        by_word = np.bincount(word, value * x[row], len(numbers))
        return np.bincount(row, value * by_word[word], n) - (length > 0) * x

    total = alike(np.ones(n))
    linked = total > 1e-12
    rank = np.full(n, 1 / n)
    for _ in range(STEPS):
        out = np.where(linked, rank / np.where(linked, total, 1), 0)
        lost = rank[~linked].sum()
        rank = (1 - DAMPING) / n + DAMPING * (alike(out) + lost / n)
    return rank


def summary(text: str, most: int = 3) -> str:
    """The ``most`` sentences of greatest rank in the order of the text, the earlier of equal ones."""
    sentences = sentences_of(text or "")
    rank = np.round(sentence_ranks(sentences), ROUND)
    best = sorted(np.argsort(-rank, kind="stable")[:most].tolist())
    return " ".join(sentences[i] for i in best)


def by_ranks(most: int = 3) -> Callable[[str], str]:
    """``summary`` as a call for ``models.model_call``: a default that needs no model."""
    return partial(summary, most=most)


def summarised(df: DataFrame, text: str, most: int = 3, name: str = "summary") -> DataFrame:
    """``df`` with the summary of each text, null texts have none. Texts are not dealt out: each is summed up where it is read."""
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(a, 200) for a in range(0, len(batch), 200)):
                texts = part.column(at).to_pylist()
                told = {t: summary(t, most) for t in set(texts) if t is not None}
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([told.get(t) for t in texts], pa.string())], [*part.schema.names, name])

    return df.mapInArrow(run, StructType(list(df.schema)).add(name, "string"))


def runs_of(text: str) -> list[list[str]]:
    """Words in lower case, in runs that sentence marks and other signs but blanks and hyphens end."""
    return [words for part in re.split(r"[^\w\s-]|[\d_]|\n", text.lower()) if (words := _WORD.findall(part))]


def word_ranks(texts: list[list[list[str]]], stop: frozenset[str]) -> list[dict[str, float]]:
    """For each text, given as runs of words, the rank of its words that are no stop words."""
    names: list[tuple[int, str]] = []
    known: dict[tuple[int, str], int] = {}
    nodes, runs, places = [], [], []
    number = 0
    for t, of in enumerate(texts):
        at = 0
        for run in of:
            number += 1
            for w in run:
                at += 1
                if w in stop:
                    continue
                k = known.setdefault((t, w), len(names))
                if k == len(names):
                    names.append((t, w))
                nodes.append(k)
                runs.append(number)
                places.append(at)
    out: list[dict[str, float]] = [{} for _ in texts]
    if not names:
        return out
    rank = _node_ranks(np.array(nodes), np.array(runs), np.array(places), np.array([t for t, _ in names]))
    for (t, w), r in zip(names, rank.tolist(), strict=True):
        out[t][w] = r
    return out


def _node_ranks(node: np.ndarray, run: np.ndarray, at: np.ndarray, text: np.ndarray) -> np.ndarray:
    """The rank of each node: ``node``, ``run`` and place ``at`` of each word that is no stop word, the ``text`` of each node."""
    size, texts = len(text), text[-1] + 1
    a, b = [], []
    for step in range(1, WINDOW):
        same = (run[step:] == run[:-step]) & (node[step:] != node[:-step])
        a.append(node[:-step][same])
        b.append(node[step:][same])
    start, end = np.concatenate([*a, *b]), np.concatenate([*b, *a])
    back = np.bincount(node, 1 / at, size)
    back = back / np.bincount(text, back, texts)[text]
    degree = np.bincount(start, minlength=size)
    alone = np.flatnonzero(degree == 0)
    out, restart = np.maximum(degree, 1), (1 - DAMPING) * back
    rank = back.copy()
    for _ in range(STEPS):
        lost = np.bincount(text[alone], rank[alone], texts)[text]
        rank = restart + DAMPING * (np.bincount(end, (rank / out)[start], size) + lost * back)
    return rank


def phrases_of(runs: list[list[str]], stop: frozenset[str]) -> Iterator[tuple[str, ...]]:
    """Stretches of a run between stop words, in pieces of at most ``PHRASE_WORDS``."""
    for run in runs:
        now: list[str] = []
        for w in [*run, None]:
            if w is None or w in stop or len(now) == PHRASE_WORDS:
                if now:
                    yield tuple(now)
                now = []
            if w is not None and w not in stop:
                now.append(w)


def best_phrases(runs: list[list[str]], ranks: dict[str, float], stop: frozenset[str], most: int) -> list[tuple[str, float]]:
    scored = {p: round(sum(ranks[w] for w in p), ROUND) for p in phrases_of(runs, stop)}
    return [(" ".join(p), s) for p, s in sorted(scored.items(), key=lambda x: (-x[1], x[0]))[:most]]


_BLANK, _MARK, _LETTER, _OWN = range(4)


@cache
def _ranked_sign(c: str) -> int:
    """What a character is to ``runs_of``: a blank or hyphen, the end of a run, a letter, or one that can be a word of its own."""
    if "一" <= c <= "鿿":
        return _OWN
    if _WORD.match(c):
        return _LETTER
    return _BLANK if c != "\n" and re.match(r"[\s-]", c) else _MARK


@cache
def _counted_sign(c: str) -> int:
    """The same for ``common_words``, whose words are of letters and combining marks."""
    if "一" <= c <= "鿿":
        return _OWN
    return _LETTER if unicodedata.category(c)[0] in "LM" else _MARK


class _Words(NamedTuple):
    """The words of some texts in their order."""

    kinds: pa.Array  # each different word
    kind: np.ndarray
    run: np.ndarray
    per_text: np.ndarray  # how many words each text has


def _words_of(texts: pa.Array, sign_of: Callable[[str], int]) -> _Words:
    """The words in lower case. Each different character is asked for once; no Python string is made for a word."""
    lower = [(t or "").lower() for t in texts.to_pylist()]
    codes = np.frombuffer("".join(f"{t}\n" for t in lower).encode("utf-32-le"), np.uint32)
    signs = np.zeros(codes.max() + 1, np.uint8)
    signs[codes] = 1
    occurring = np.flatnonzero(signs)
    signs[occurring] = [sign_of(chr(c)) for c in occurring.tolist()]
    sign = signs.take(codes)
    inside = sign >= _LETTER
    edges = np.flatnonzero(np.diff(inside, prepend=False))
    starts, ends = edges[::2], edges[1::2]
    if (sign == _OWN).any():  # before a stretch's first letter, each is a word
        letters = np.append(np.flatnonzero(sign == _LETTER), len(sign))
        last = np.minimum(letters[np.searchsorted(letters, starts)], ends - 1)
        begins = np.zeros(len(sign) + 1, np.int8)
        begins[starts] += 1
        begins[last + 1] -= 1
        stretch_ends, starts = ends, np.flatnonzero(np.cumsum(begins, dtype=np.int8))
        ends = np.minimum(np.append(starts[1:], len(sign)), stretch_ends[np.searchsorted(stretch_ends, starts, "right")])
    kept = codes[inside]
    width = 1 + (kept >= 0x80).view(np.uint8) + (kept >= 0x800) + (kept >= 0x10000)
    offsets = np.append(0, np.cumsum(width, dtype=np.int64))[np.append(0, np.cumsum(ends - starts))]
    utf8 = kept.tobytes().decode("utf-32-le").encode()
    words = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(utf8)]).dictionary_encode()
    per_text = np.diff(np.searchsorted(starts, np.cumsum([len(t) + 1 for t in lower])), prepend=0)
    return _Words(words.dictionary, words.indices.to_numpy(), np.cumsum(sign == _MARK)[starts], per_text)


def _numbered(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each value's number, from 0 in the order in which they first appear, and the value of each number."""
    told = pa.array(values).dictionary_encode()
    return told.indices.to_numpy().astype(np.intp), told.dictionary.to_numpy()


def _parts(batch: pa.RecordBatch, at: int) -> Iterator[pa.RecordBatch]:
    """Neighbours in a batch whose texts, in column ``at``, have about ``PART_BYTES`` together."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(), dtype=np.int64)
    cuts = [0, *(np.flatnonzero(np.diff(size // PART_BYTES)) + 1).tolist(), len(batch)]
    return (batch.slice(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False) if b > a)


def _all_best_phrases(texts: pa.Array, stop: frozenset[str], most: int) -> list[tuple[int, str, float, int]]:
    """(place of the text, phrase, score, rank) as ``best_phrases`` tells them of each text."""
    words = _words_of(texts, _ranked_sign)
    kinds = len(words.kinds)
    of_stop = pc.is_in(words.kinds, pa.array(list(stop), pa.large_string())).to_numpy(zero_copy_only=False)
    kept = np.flatnonzero(~of_stop[words.kind])
    if not len(kept):
        return []
    text = np.repeat(np.arange(len(texts)), words.per_text)
    at = np.arange(1, len(text) + 1) - np.repeat(np.cumsum(words.per_text) - words.per_text, words.per_text)
    node, named = _numbered(text[kept] * kinds + words.kind[kept])
    run = words.run[kept]
    rank = _node_ranks(node, run, at[kept], named // kinds)

    place = np.arange(len(kept))
    begins = np.append(True, (np.diff(kept) > 1) | (np.diff(run) > 0))
    place -= np.maximum.accumulate(np.where(begins, place, 0))
    head = np.flatnonzero(place % PHRASE_WORDS == 0)
    size = np.diff(head, append=len(kept))
    phrase, score = node[head], rank[node[head]]
    for i in range(1, PHRASE_WORDS):
        word = np.where(size > i, node[np.minimum(head + i, len(kept) - 1)], -1)
        phrase, _ = _numbered(phrase * (len(rank) + 1) + word + 1)
        score = score + np.where(word >= 0, rank[word], 0)
    new = np.flatnonzero(np.diff(np.maximum.accumulate(phrase), prepend=-1))
    head, size, score = head[new], size[new], score[new]

    owner = text[kept[head]]
    order = np.lexsort((-score, owner))
    number = np.bincount(owner, minlength=len(texts))
    least = score[order[np.cumsum(number) - number + np.minimum(number, most) - 1]]
    near = order[score[order] >= least[owner[order]] - 2 * 10.0**-ROUND]  # all that rounding can bring among the best
    cells = node[np.minimum(head[near, None] + np.arange(PHRASE_WORDS), len(kept) - 1)]
    names = words.kinds.take(pa.array((named[cells] % kinds).ravel())).to_pylist()
    found: dict[int, list[tuple[float, tuple[str, ...]]]] = {}
    for i, (t, n, ranks) in enumerate(zip(owner[near].tolist(), size[near].tolist(), rank[cells].tolist(), strict=True)):
        found.setdefault(t, []).append((-round(sum(ranks[:n]), ROUND), tuple(names[PHRASE_WORDS * i : PHRASE_WORDS * i + n])))
    return [(t, " ".join(p), -s, k) for t, of in found.items() for k, (s, p) in enumerate(sorted(of)[:most], 1)]


def common_words(docs: DataFrame, text: str = "text", share: float = COMMON_SHARE) -> frozenset[str]:
    """Words of more than ``share`` of all documents, at most 1 / ``share`` times as many as a document has on average."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for part in _parts(batch, 0):
                words = _words_of(part.column(0), _counted_sign)
                kinds = len(words.kinds)
                _, once = _numbered(np.repeat(np.arange(len(part)), words.per_text) * kinds + words.kind)
                found.append(pa.table({"w": words.kinds, "n": np.bincount(once % max(kinds, 1), minlength=kinds)}))
            if found:
                told = pa.concat_tables(found).group_by("w", use_threads=False).aggregate([("n", "sum")])
                yield from told.rename_columns(["w", "n"]).cast(pa.schema({"w": pa.string(), "n": pa.int64()})).to_batches()

    words = docs.select(text).mapInArrow(run, "w string, n long")
    n = docs.count()
    return frozenset(r["w"] for r in words.groupBy("w").agg(F.sum("n").alias("n")).where(F.col("n") > share * n).collect())


def keyphrases(docs: DataFrame, most: int = 5, id_col: str = "doc_id", text: str = "text", stop: frozenset[str] | None = None) -> DataFrame:
    """(id, phrase, score, rank) of each row's ``most`` best phrases; ``stop`` are the ``common_words`` where none are given."""
    shared = docs.sparkSession.sparkContext.broadcast(common_words(docs, text) if stop is None else stop)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _parts(batch, 1):
                found = _all_best_phrases(part.column(1), shared.value, most)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(pa.array([t for t, _, _, _ in found], pa.int64())),
                        pa.array([p for _, p, _, _ in found], pa.string()),
                        pa.array([s for _, _, s, _ in found], pa.float64()),
                        pa.array([k for _, _, _, k in found], pa.int32()),
                    ],
                    [id_col, "phrase", "score", "rank"],
                )

    schema = StructType([docs.schema[id_col]]).add("phrase", "string").add("score", "double").add("rank", "integer")
    return docs.select(id_col, text).mapInArrow(run, schema)
