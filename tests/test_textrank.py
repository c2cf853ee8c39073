"""Summaries and keyphrases against plain matrices."""

import math
import random
import time

import numpy as np
import pyarrow as pa
import pytest
from checking import SMALL
from pyspark.sql import functions as F

from leafmill.functions import textrank as tr
from leafmill.storage import read_table


def plain_sentence_ranks(sentences):
    n = len(sentences)
    words = [tr._WORD.findall(s.lower()) for s in sentences]
    vocabulary = sorted({w for ws in words for w in ws})
    x = np.array([[ws.count(w) * math.log(n / sum(w in other for other in words)) for w in vocabulary] for ws in words])
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    x = x / np.where(norm > 0, norm, 1)
    alike = x @ x.T
    np.fill_diagonal(alike, 0)
    walk = np.array([row / row.sum() if row.sum() > 1e-12 else np.full(n, 1 / n) for row in alike])
    rank = np.full(n, 1 / n)
    for _ in range(tr.STEPS):
        rank = (1 - tr.DAMPING) / n + tr.DAMPING * rank @ walk
    return rank


def words_at_random(rng, n):
    return ["abcdefghij"[min(int(rng.expovariate(0.4)), 9)] * 3 for _ in range(n)]


@pytest.mark.parametrize("seed", range(4))
def test_sentence_ranks_like_a_matrix(seed):
    rng = random.Random(seed)
    sentences = [" ".join(words_at_random(rng, rng.randint(1, 7))) for _ in range(rng.randint(2, 25))] + ["lone words only", "lone words only"][: seed % 3]
    assert np.allclose(tr.sentence_ranks(sentences), plain_sentence_ranks(sentences), atol=1e-9)


def plain_word_ranks(runs, stop):
    names = list(dict.fromkeys(w for run in runs for w in run if w not in stop))
    at, places = 0, {w: 0.0 for w in names}
    links = np.zeros((len(names), len(names)))
    for run in runs:
        for w in run:
            at += 1
            if w in places:
                places[w] += 1 / at
        kept = [w for w in run if w not in stop]
        for i, w in enumerate(kept):
            for v in kept[i + 1 : i + tr.WINDOW]:
                if v != w:
                    links[names.index(w), names.index(v)] += 1
                    links[names.index(v), names.index(w)] += 1
    back = np.array([places[w] for w in names])
    back = back / back.sum() if len(names) else back
    walk = np.array([row / row.sum() if row.sum() else back for row in links])
    rank = back
    for _ in range(tr.STEPS):
        rank = (1 - tr.DAMPING) * back + tr.DAMPING * rank @ walk if len(names) else rank
    return dict(zip(names, rank.tolist(), strict=True))


def test_word_ranks_of_many_texts_at_once():
    rng = random.Random(8)
    texts = [[words_at_random(rng, rng.randint(1, 9)) for _ in range(rng.randint(0, 5))] for _ in range(20)] + [[["aaa"]], [["alone"]], []]
    stop = frozenset(["aaa"])
    for runs, ranks in zip(texts, tr.word_ranks(texts, stop), strict=True):
        want = plain_word_ranks(runs, stop)
        assert set(ranks) == set(want) and all(abs(ranks[w] - want[w]) < 1e-9 for w in want)


def test_sentences_and_phrases():
    assert tr.sentences_of("One two. Three!\n4 5\nsix? Seven") == ["One two.", "Three!", "six?", "Seven"]
    assert tr.summary("") == tr.summary(None) == "" and tr.summary("Only one.") == "Only one."
    runs = tr.runs_of("The quick-brown fox, and 3 dogs\nof The town")
    assert runs == [["the", "quick", "brown", "fox"], ["and"], ["dogs"], ["of", "the", "town"]]
    assert list(tr.phrases_of([["a", "b", "c", "d", "the", "e"]], frozenset(["the"]))) == [("a", "b", "c"), ("d",), ("e",)]


def test_queries_on_documents(spark):
    docs = read_table(spark, SMALL, "documents").select("doc_id", "text")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    odd = spark.createDataFrame([(-1, None), (-2, ""), (-3, "... 12"), (-4, "word " * 9000)], "doc_id long, text string")
    stop = tr.common_words(docs)
    both = docs.unionByName(odd)
    summaries = {r["doc_id"]: r["summary"] for r in tr.summarised(both, "text").collect()}
    assert summaries[-1] is None and summaries[-2] == summaries[-3] == "" and len(summaries) == len(texts) + 4
    phrases = {}
    for r in tr.keyphrases(both, stop=stop).collect():
        phrases.setdefault(r["doc_id"], {})[r["rank"]] = r["phrase"], r["score"]
    assert not {-1, -2, -3} & set(phrases) and phrases[-4] == {1: ("word word word", 3.0)}
    for i in list(texts)[:40]:
        sentences = tr.sentences_of(texts[i])
        if 1 < len(sentences) <= 60:
            rank = np.round(plain_sentence_ranks(sentences), 6)
            told = set(summaries[i].split(" "))
            best = np.argsort(-rank, kind="stable")[0]
            if rank[best] > np.sort(rank)[-2:][0] + 1e-6:
                assert set(sentences[best].split(" ")) <= told
        runs = tr.runs_of(texts[i])
        if sum(map(len, runs)) < 400:
            ranks = plain_word_ranks(runs, stop)
            want = tr.best_phrases(runs, ranks, stop, 5)
            got = [phrases[i][k] for k in sorted(phrases.get(i, {}))]
            assert np.allclose([s for _, s in got], [s for _, s in want], atol=1e-7)


def test_summaries_are_made_where_texts_are_read(spark):
    rows = [(1, "One cat. Two cats ran. A cat ran far. Dogs sat."), (2, None), (3, ""), (4, "One cat. Two cats ran. A cat ran far. Dogs sat.")]
    made = tr.summarised(spark.createDataFrame(rows, "i long, t string"), "t", 2)
    assert {r["i"]: r["summary"] for r in made.collect()} == {i: None if t is None else tr.summary(t, 2) for i, t in rows}
    assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()


def plain_best(texts, stop, most=5):
    split = [tr.runs_of(t or "") for t in texts]
    ranks = tr.word_ranks(split, stop)
    return [(i, p, s, k) for i, runs in enumerate(split) for k, (p, s) in enumerate(tr.best_phrases(runs, ranks[i], stop, most), 1)]


def odd_texts(seed, n=60):
    rng = random.Random(seed)
    pieces = ["the", "aa", "Bb", "ccc", "İi", "ΟΔΟΣ", "ß", "e\u0301te\u0301", "中文", "中", "x中文y", "\u3400字", "m²", "Ⅷ", "७", "😀", "\U0001d400z", "4", "_", "\u00a0", "\x1c", "\u2028"]
    ends = [" ", " ", " ", "-", "", ", ", ".", "\n", "\t", "—", "\r\n"]
    return ["".join(rng.choice(pieces) + rng.choice(ends) for _ in range(rng.randint(0, 120))) for _ in range(n)] + [None, "", "the the", "...", "b c b c b c"]


@pytest.mark.parametrize("seed", range(4))
def test_phrases_from_arrays_like_those_of_each_text(seed):
    texts = odd_texts(seed)
    for stop in (frozenset(), frozenset(["the", "中", "aa"])):
        for most in (1, 5, 1000):
            assert tr._all_best_phrases(pa.array(texts, pa.string()), stop, most) == plain_best(texts, stop, most)
    assert tr._all_best_phrases(pa.array([None, "", "the"], pa.string()), frozenset(["the"]), 5) == []


def test_characters_are_told_as_the_patterns_tell_them():
    texts = [f"A{c}b {c}c" for c in map(chr, [*range(0xD800), *range(0xE000, 0x11000), *range(0x1D400, 0x1D800), *range(0x20000, 0x20100)])]
    found = tr._words_of(pa.array(texts), tr._ranked_sign)
    words = [[w for run in tr.runs_of(t) for w in run] for t in texts]
    runs = [(i, j) for i, t in enumerate(texts) for j, run in enumerate(tr.runs_of(t)) for _ in run]
    assert found.per_text.tolist() == [len(w) for w in words]
    assert found.kinds.take(pa.array(found.kind)).to_pylist() == [w for of in words for w in of]
    assert (np.diff(found.run) > 0).tolist() == [a != b for a, b in zip(runs, runs[1:], strict=False)]


def test_common_words_like_patterns_of_the_engine(spark):
    docs = spark.createDataFrame(list(enumerate(odd_texts(9))), "doc_id long, text string").unionByName(read_table(spark, SMALL, "documents").select("doc_id", "text"))
    kinds = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(r"[一-鿿]|[\p{L}\p{M}]+"), F.lit(0))
    counts = {r["w"]: r["count"] for r in docs.select(F.explode(F.array_distinct(kinds)).alias("w")).groupBy("w").count().collect()}
    n = docs.count()
    for share in (0, 0.01, 0.5):
        assert tr.common_words(docs, share=share) == {w for w, c in counts.items() if c > share * n}
    assert tr.common_words(docs.limit(0)) == frozenset()


def test_parts_are_bounded_by_their_texts(monkeypatch):
    monkeypatch.setattr(tr, "PART_BYTES", 100)
    texts = ["é" * n for n in (10, 30, 500, 0, 7)] + [None] * 3 + ["ab" * 40] * 4
    parts = list(tr._parts(pa.RecordBatch.from_arrays([pa.array(texts)], ["t"]), 0))
    assert [t for p in parts for t in p.column(0).to_pylist()] == texts
    assert all(len(p) == 1 or sum(len((t or "").encode()) for t in p.column(0).to_pylist()[1:]) < 100 for p in parts)
    assert not list(tr._parts(pa.RecordBatch.from_arrays([pa.array([], pa.string())], ["t"]), 0))


def test_phrases_from_arrays_take_less_time(spark):
    texts = [r["text"] for r in read_table(spark, SMALL, "documents").select("text").collect()]
    stop = frozenset(["the", "of", "and"])

    def seconds(run):
        before = time.process_time()
        assert len(run())
        return time.process_time() - before

    arrays = min(seconds(lambda: tr._all_best_phrases(pa.array(texts), stop, 5)) for _ in range(3))
    assert arrays < 0.5 * min(seconds(lambda: plain_best(texts, stop)) for _ in range(2))
