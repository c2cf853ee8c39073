"""Word segmentation against plain enumeration of all readings."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from leafmill.functions import segmentation as seg
from leafmill.plans import indexed


def readings(run, longest):
    """All ways to cut a run."""
    if not run:
        yield []
    for n in range(1, min(longest, len(run)) + 1):
        for rest in readings(run[n:], longest):
            yield [run[:n], *rest]


def scored(lexicon, run):
    p = dict(zip(lexicon.words, lexicon.log_p.tolist(), strict=True))
    for words in readings(run, lexicon.longest):
        if all(w in p or len(w) == 1 for w in words):
            yield sum(p.get(w, lexicon.unknown) for w in words), words


def lexicon_of(rng, letters, n):
    words = sorted({"".join(rng.choice(letters) for _ in range(rng.randint(1, 4))) for _ in range(n)})
    p = np.array([rng.random() + 0.01 for _ in words])
    return seg.Lexicon(words, np.log(p / p.sum()))


@pytest.mark.parametrize("seed", range(4))
def test_paths_and_expectations_like_all_readings(seed):
    rng = random.Random(seed)
    lexicon = lexicon_of(rng, "ab中é", 25)
    runs = ["".join(rng.choice("ab中éx") for _ in range(rng.randint(1, 9))) for _ in range(40)]
    times = np.array([rng.randint(1, 5) for _ in runs])
    counts, best = np.zeros(len(lexicon.words)), {}
    for lattice in lexicon.lattices(runs):
        counts += lattice.expected(times[lattice.numbers])
        best |= dict(lattice.words())
    want: Counter = Counter()
    for i, run in enumerate(runs):
        ways = list(scored(lexicon, run))
        assert "".join(best[i]) == run
        assert abs(max(s for s, _ in ways) - next(s for s, w in ways if w == best[i])) < 1e-9
        total = sum(math.exp(s) for s, _ in ways)
        for s, words in ways:
            for w in words:
                want[w] += times[i] * math.exp(s) / total
    assert np.allclose(counts, [want[w] for w in lexicon.words])


def test_frequent_pieces_like_plain_counts(spark):
    rng = random.Random(2)
    texts = [" ".join("".join(rng.choice("abcü") for _ in range(rng.randint(1, 12))) for _ in range(6)) for _ in range(30)] + [None, ""]
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    found = seg.frequent_pieces(seg._runs_table(df, "text"), min_count=4, longest=5)
    plain = Counter(r[i : i + n] for t in texts for r in seg.runs_of(t) for n in range(1, 6) for i in range(len(r) - n + 1))
    assert found == {p: n for p, n in plain.items() if n >= 4 or len(p) == 1}


def test_expectation_is_the_same_for_any_partitions(spark):
    rng = random.Random(6)
    lexicon = lexicon_of(rng, "abc", 20)
    df = spark.createDataFrame([("".join(rng.choice("abc") for _ in range(9)), rng.randint(1, 3)) for _ in range(50)], "run string, n long")
    assert np.allclose(seg.expected_counts(df.repartition(5), lexicon), seg.expected_counts(df.coalesce(1), lexicon))


def test_words_of_a_language_with_few_words_are_found(spark):
    """Words drawn from a vocabulary, written without blanks, come back."""
    rng = random.Random(11)
    vocabulary = ["".join(rng.choice("abcdefghijklmnoprstu") for _ in range(rng.randint(3, 8))) for _ in range(60)]
    gold = [[vocabulary[min(int(rng.expovariate(0.08)), 59)] for _ in range(rng.randint(5, 30))] for _ in range(300)]
    df = spark.createDataFrame([(i, "".join(w)) for i, w in enumerate(gold)], "doc_id long, text string")
    rows = {r["doc_id"]: r["words"] for r in seg.segmented(df, seg.learn(df, longest=8)).collect()}
    right = sum(len(seg.spans(g) & seg.spans(rows[i])) for i, g in enumerate(gold))
    f1 = 2 * right / (sum(map(len, gold)) + sum(map(len, rows.values())))
    assert f1 > 0.95


def test_recovery_on_documents(spark):
    """Words of the given documents are drawn syllable by syllable, so few can be told from their parts."""
    rows = indexed.word_recovery(spark, "/root/testdata/sf0.001").collect()
    n, found, right = (sum(r[c] for r in rows) for c in ("n_words", "n_found", "n_right"))
    assert len(rows) == 200 and 2 * right / (n + found) > 0.15


def test_texts_without_letters(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "12 -- 3"), (4, "Q" * 3000)], "doc_id long, text string")
    rows = {r["doc_id"]: r["words"] for r in seg.segmented(df, seg.Lexicon(["qq"], np.zeros(1))).collect()}
    assert rows[1] == rows[2] == rows[3] == [] and rows[4] == ["qq"] * 1500
    assert seg.learn(df.where("doc_id < 4")).words == []


def test_places_of_hashes():
    """Looked up among hashes that crowd in one part of the range, the greatest ones included."""
    rng = np.random.default_rng(3)
    some = np.unique(np.concatenate([rng.integers(0, 1 << 64, 500, np.uint64), rng.integers(0, 900, 300, np.uint64), np.array([2**64 - 2], np.uint64)]))
    asked = np.concatenate([some[::2], rng.integers(0, 1200, 500, np.uint64), np.array([2**64 - 1, 2**64 - 2, 0], np.uint64)])
    known = {int(h): i for i, h in enumerate(some)}
    assert seg.Places(some).find(asked.reshape(1, -1)).tolist() == [[known.get(int(h), -1) for h in asked]]
    assert seg.Places(some[:0]).find(asked[:3]).tolist() == [-1] * 3


def test_hashes_of_like_words_do_not_crowd():
    """Pieces that differ in their last characters only lie in different parts of the table; else each is found after all others."""
    letters = [chr(c) for c in range(0x4E00, 0x4E00 + 60)]
    places = seg.Places(np.sort(seg._word_hashes([a + b for a in letters for b in letters])))
    slots = np.unique(places.hashes[:-1] >> places.shift, return_counts=True)[1]
    assert slots.max() < 8


def test_runs_are_dealt_to_all_cores(spark):
    df = spark.createDataFrame([(w,) for w in ("ab", "cd ef", "gh")], "text string")
    rows = seg._runs_table(df.coalesce(1), "text")
    assert len(rows.inputFiles()) > 1 and sorted(map(tuple, rows.collect())) == [("ab", 1), ("cd", 1), ("ef", 1), ("gh", 1)]


@pytest.mark.parametrize("least", [-3.0, -40.0, -300.0])
def test_expectations_of_long_runs(least):
    """Products of thousands of probabilities, within and beyond the range of numbers, like sums of logarithms."""
    rng = random.Random(7)
    lexicon = seg.Lexicon(["a", "b", "ab", "bba"], np.array([-0.5, least, -1.0, -2.0]))
    runs = ["".join(rng.choice("abé") for _ in range(n)) for n in (1, 9, 700, 1500, 1501)]
    times = np.array([1, 2, 3, 1, 5])
    for lattice in lexicon.lattices(runs):
        own = times[lattice.numbers]
        found, want = lattice.expected(own), lattice._expected_by_logarithms(own)
        assert np.isfinite(found).all() and np.allclose(found, want, rtol=1e-9)


def test_common_spans_like_sets():
    rng = random.Random(8)
    for _ in range(50):
        text = "".join(rng.choice("ab") for _ in range(rng.randint(0, 30)))

        def cut(t):
            places = [0, *sorted(rng.sample(range(1, len(t)), len(t) // 3)), len(t)] if t else []
            return [t[a:b] for a, b in zip(places, places[1:], strict=False)]

        some, others = cut(text), cut(text + "b" * rng.randint(0, 2))
        lengths = (np.array([len(w) for w in words], np.int64) for words in (some, others))
        assert seg.common_spans(*lengths) == len(seg.spans(some) & seg.spans(others))


def test_words_of_texts_in_any_letters():
    """Texts without runs between others, letters of one to four bytes."""
    lexicon = seg.Lexicon(["ab", "é中", "𐐨"], np.log(np.array([0.5, 0.3, 0.2])))
    words = seg._split(lexicon, [[], ["abé中", "𐐨ab"], [], ["中"], []]).to_pylist()
    assert words == [[], ["ab", "é中", "𐐨", "ab"], [], ["中"], []]
    assert seg._split(lexicon, [[], []]).to_pylist() == [[], []]
