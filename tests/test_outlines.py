"""Outlines: the same for any partitioning, unions like Ward's, every document placed."""

import random
from collections import Counter

import numpy as np
from checking import SMALL
from pyspark.sql import functions as F

from leafmill.operators import outlines
from leafmill.storage import read_table


def scatter(vectors):
    x = np.array(vectors, float)
    return float(((x - x.mean(axis=0)) ** 2).sum())


def test_features_tell_scatter_and_unions():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 50, (7, outlines.SIZE)), rng.integers(0, 90, (4, outlines.SIZE))
    of = lambda x: outlines.Feature(len(x), x.sum(axis=0), int((x * x).sum()))
    assert abs(of(a).scatter() - scatter(a)) < 1e-6
    assert abs(of(a).cost_of(of(b)) - (scatter(np.vstack([a, b])) - scatter(a) - scatter(b))) < 1e-6
    whole = of(a) + of(b)
    assert whole.n == 11 and abs(whole.scatter() - scatter(np.vstack([a, b]))) < 1e-6


def test_unions_like_trying_all_pairs():
    rng = np.random.default_rng(3)
    parts = [rng.integers(0, 40, (int(rng.integers(1, 5)), outlines.SIZE)) + 30 * (i % 3) for i in range(9)]
    leaves = [([i], outlines.Feature(len(x), x.sum(axis=0), int((x * x).sum()))) for i, x in enumerate(parts)]
    groups = {(i,): x for i, x in enumerate(parts)}
    while len(groups) > 3:
        a, b = min(((a, b) for a in groups for b in groups if a < b), key=lambda p: scatter(np.vstack([groups[p[0]], groups[p[1]]])) - scatter(groups[p[0]]) - scatter(groups[p[1]]))
        groups[tuple(sorted(a + b))] = np.vstack([groups.pop(a), groups.pop(b)])
    found = outlines.agglomerated(leaves, 3)
    assert {tuple(sorted(p)) for p, _ in found} == set(groups)
    assert [g.n for _, g in found] == sorted((g.n for _, g in found), reverse=True)


def test_nearest_means():
    rng = np.random.default_rng(6)
    groups = [outlines.Feature(n, rng.integers(0, 90, outlines.SIZE) * n, 0) for n in (1, 4, 7)]
    x = rng.integers(0, 90, (50, outlines.SIZE))
    far = [[float(((v - g.total / g.n) ** 2).sum()) for g in groups] for v in x]
    assert outlines.nearest(x, groups).tolist() == [int(np.argmin(f)) for f in far]


def test_branches_have_enough_documents():
    rng = np.random.default_rng(4)
    features = {int(p): outlines.Feature(int(rng.integers(1, 9)), rng.integers(0, 9, outlines.SIZE), 50) for p in rng.choice(1 << outlines.DEPTH, 60, replace=False)}
    for least in (1, 10, 40, 10_000):
        leaves = outlines.leaves_of(features, least)
        assert sorted(p for paths, _ in leaves for p in paths) == sorted(features)
        assert all(f.n >= least for _, f in leaves) or len(leaves) == 1
    assert len(outlines.leaves_of(features, 1)) == 60


def test_topics_become_sections(spark):
    rng = random.Random(2)
    topics = [[f"{t}{a}{b}" for a in "abc" for b in "xyz"] for t in ("tea", "sea", "sun")]
    rows = [(i, " ".join(rng.choice(topics[i % 3]) if rng.random() < 0.9 else rng.choice(["the", "of"]) for _ in range(40))) for i in range(240)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sections, placed = outlines.outline(df.repartition(1), 3)
    again, placed_again = outlines.outline(df.repartition(6), 3)
    told = lambda x: sorted(map(str, x.collect()))
    assert told(sections) == told(again) and told(placed) == told(placed_again)
    of = {r["doc_id"]: r["section_index"] for r in placed.collect()}
    assert len(of) == 240
    pure = sum(Counter(of[i] for i in range(t, 240, 3)).most_common(1)[0][1] for t in range(3))
    assert pure > 0.9 * 240
    for r in sections.collect():
        main = Counter(i % 3 for i in of if of[i] == r["section_index"]).most_common(1)[0][0]
        assert all(w in topics[main] for w in r["title"].split()) and len(r["points"]) == 3 and r["n_docs"] == sum(s == r["section_index"] for s in of.values())


def test_every_document_is_placed(spark):
    docs = read_table(spark, SMALL, "documents").select("doc_id", "text")
    odd = spark.createDataFrame([(-1, None), (-2, ""), (None, "a b"), (-2, "12")], "doc_id long, text string")
    sections, placed = outlines.outline(docs.unionByName(odd), 5)
    assert placed.count() == docs.count() + 4 and 1 <= sections.count() <= 5
    assert placed.agg(F.count_if(F.col("section_index").isNull())).first()[0] == 0
    empty, none = outlines.outline(docs.limit(0), 5)
    assert empty.count() == none.count() == 0
