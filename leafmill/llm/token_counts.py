"""Token counts by a broadcast table of frequent pre-tokens and worker caches (operator 4).

A compact hash table of the lengths in tokens of frequent pre-tokens (two 64-bit hashes and
a length for each of at most ``TABLE_ENTRIES``) is broadcast to the executors. Every whole
text is split where it is; pre-tokens that the table has are summed from it, the others come
from the worker's cache, and what that does not have is encoded with the library. No
pre-token is shuffled, and only the counts leave a task.

The table is fitted on a bounded sample: about ``SAMPLE_ROWS`` rows drawn at random from all
of the table (all rows where it has no more). It only decides which tier answers, never a
count, so it need not see every document. The sampled texts go to ``SAMPLE_TASKS`` tasks,
each of which returns its ``TABLE_ENTRIES`` most frequent pre-tokens of at most
``MAX_ENTRY_CHARS`` characters, which the driver adds up.

Defined results: null or empty text has 0 bytes and 0 tokens; repeated rows are each
counted; an empty table gives an empty result; other columns are ignored. Sentencepiece
models and tokenizers that are no byte-level BPE encode every text with their library.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm import _tokens
from leafmill.llm._common import map_batches, read_table

TABLE_ENTRIES = 65_536
MAX_ENTRY_CHARS = 64
SAMPLE_ROWS = 10_000
SAMPLE_TASKS = 8
LIMIT = 512


def frequent_pretokens(docs: DataFrame, path: str, entries: int = TABLE_ENTRIES, rows: int = SAMPLE_ROWS) -> list[str]:
    """The most frequent pre-tokens of a sample of about ``rows`` rows."""

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _tokens.encoder(path)
        seen: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text and enc.plain(text):
                    for part in _tokens.parts(text):
                        found = _tokens.PreTokens([part])
                        seen.update(found.words(np.arange(len(found.start))))
                if len(seen) > 8 * entries:
                    seen = Counter(dict(seen.most_common(4 * entries)))
        top = [(w, n) for w, n in seen.most_common(entries) if len(w) <= MAX_ENTRY_CHARS]
        yield pa.RecordBatch.from_arrays(
            [pa.array([[w for w, _ in top]], pa.list_(pa.string())), pa.array([[n for _, n in top]], pa.list_(pa.int64()))],
            ["words", "counts"],
        )

    total = docs.count()
    sample = docs.select("text")
    if total > rows:
        sample = sample.where(F.rand(7) < rows / total)
    summed: Counter = Counter()
    for row in map_batches(sample.repartition(SAMPLE_TASKS), summarise, "words array<string>, counts array<long>").toLocalIterator():
        summed.update(dict(zip(row["words"], row["counts"], strict=True)))
    return sorted(summed, key=lambda w: (-summed[w], w))[:entries]


class LengthTable:
    """Lengths of pre-tokens by their hashes, in an open-addressed table."""

    def __init__(self, key: np.ndarray, check: np.ndarray, length: np.ndarray):
        table = _tokens.WordTable(len(key))
        table.insert(key, check, np.zeros(len(key), np.int64), length)
        self.bits, self.key, self.check, self.length = table.bits, table.key, table.check, table.length

    find = _tokens.WordTable.find


def length_table(words: list[str], path: str) -> LengthTable:
    """The compact table of ``words``, whose lengths the library tells."""
    found = _tokens.PreTokens(words)
    assert len(found.start) == len(words)  # each is one pre-token
    at, length = _tokens.encoder(path).encoded(words, _tokens.WordTable(0))
    first = np.unique(found.key, return_index=True)[1]
    return LengthTable(found.key[first], found.check[first], length[first])


class TwoTierCounter:
    """Counts tokens: first by the shared table of frequent pre-tokens, then by the worker's cache."""

    def __init__(self, path: str, shared: LengthTable):
        self.encoder, self.shared = _tokens.encoder(path), shared

    def _plain(self, texts: list[str]) -> list[int]:
        enc, table = self.encoder, self.encoder.cache
        found = _tokens.PreTokens(texts)
        slot = self.shared.find(found.key, found.check)
        length = self.shared.length[slot].astype(np.int64)
        rare = np.flatnonzero(slot < 0)
        length[rare] = table.length[enc.slots(found, table, rare)]
        return np.diff(np.concatenate([[0], np.cumsum(length)])[found.first]).tolist()

    def counts(self, texts: list[str]) -> Iterator[int]:
        enc = self.encoder
        for a, b in _tokens.slices(texts):
            plain = [enc.plain(t) for t in texts[a:b]]
            if b - a == 1 and plain[0]:
                yield sum(n for part in _tokens.parts(texts[a]) for n in self._plain([part]))
                continue
            known = iter(self._plain([t for t, p in zip(texts[a:b], plain, strict=True) if p]))
            for text, p in zip(texts[a:b], plain, strict=True):
                yield next(known) if p else len(enc.whole(text))


def library_counter(path: str):
    """A function from whole texts to their numbers of tokens by the library alone."""
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: (len(model.encode(t, num_threads=1)) for t in texts)
    library = _tokens.load(path)
    return lambda texts: (len(library.encode(t, add_special_tokens=False)) for t in texts)


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row."""
    shared = None
    if not path.endswith(".model") and _tokens.encoder(path).by_words:
        words = frequent_pretokens(docs, path)
        shared = docs.sparkSession.sparkContext.broadcast(length_table(words, path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = library_counter(path) if shared is None else TwoTierCounter(path, shared.value).counts
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            n_bytes, n_tokens = [len(t.encode()) for t in texts], list(counts(texts))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(n_bytes, pa.int64()),
                    pa.array(n_tokens, pa.int64()),
                    pa.array([n > limit for n in n_tokens], pa.bool_()),
                ],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return map_batches(
        docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
    )


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(read_table(spark, sf_dir, "documents"), _tokens.tokenizer_path("byte_bpe_50k.json"))
