"""The persisted text index and what is built on it, against plain versions."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from leafmill.operators import text_index, vector_index
from leafmill.plans import indexed
from leafmill.storage import new_dir


@pytest.mark.parametrize("seed", range(5))
def test_packed_integers_come_back(seed):
    rng = np.random.default_rng(seed)
    values = np.concatenate([rng.integers(0, 2 ** int(rng.integers(1, 50)), 40), [0, 127, 128, 2**14 - 1, 2**14, 2**35]])
    assert text_index.unpacked(text_index.packed(values)).tolist() == values.tolist()
    assert text_index.unpacked(text_index.packed(np.array([], np.int64))).tolist() == []


def plain_bm25(docs, queries, limit, exclude=()):
    words = {i: t.split() for i, t in docs}
    n, avg = len(words), sum(map(len, words.values())) / len(words)
    df = Counter(w for ws in words.values() for w in set(ws))
    out = []
    for q, text in queries:
        scored = []
        for i, ws in words.items():
            tf = Counter(ws)
            hit = [w for w in text.split() if tf[w]]
            if hit and (q, i) not in exclude:
                s = sum(
                    math.log((n - df[w] + 0.5) / (df[w] + 0.5) + 1) * tf[w] * 2.5 / (tf[w] + 1.5 * (0.25 + 0.75 * len(ws) / avg)) for w in hit
                )
                scored.append((-round(s, 6), i))
        out += [(q, i, -s, r) for r, (s, i) in enumerate(sorted(scored)[:limit], 1)]
    return sorted(out)


def test_index_like_exhaustive_scores(spark):
    rng = random.Random(4)
    letters = "abcdefghijklmnopqrst"
    word = lambda: letters[min(int(rng.expovariate(0.35)), 19)] * rng.randint(1, 3)
    topic = lambda i: letters[i // 50] * 4
    docs = [(i, " ".join(rng.choice([word(), word(), topic(i)]) for _ in range(rng.randint(0, 60)))) for i in range(700)]
    docs[10:20] = [(i, docs[10][1]) for i in range(10, 20)]  # ties
    queries = [(k, " ".join([topic(k * 28), *(word() for _ in range(rng.randint(1, 5)))])) for k in range(25)] + [(90, "zzzzz"), (91, "ttt ttt ttt"), (92, docs[10][1])]
    exclude = [(k, i) for k in range(10) for i in range(0, 700, 3)]
    df = spark.createDataFrame(docs, "doc_id long, text string").coalesce(3)
    path = new_dir(spark, "test_index")
    built = text_index.build(df, path, window=16, buckets=4)
    asked = spark.createDataFrame(queries, "query_id long, query string")
    out = spark.createDataFrame(exclude, "query_id long, doc_id long")
    rows = lambda hits: sorted((r["query_id"], r["doc_id"], round(r["score"], 6), r["rank"]) for r in hits.collect())
    hits, blocks = built.search(asked, 7)
    assert rows(hits) == plain_bm25(docs, queries, 7)
    read = {r["query_id"]: (r["blocks"], r["read"]) for r in blocks.collect()}
    assert all(r <= b for b, r in read.values()) and sum(r for _, r in read.values()) < 0.7 * sum(b for b, _ in read.values())
    again = text_index.TextIndex(spark, path, 4)  # opened from its files
    assert rows(again.search(asked, 7, exclude=out)[0]) == plain_bm25(docs, queries, 7, set(exclude))


def test_index_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "a b"), (2, None)], "query_id long, query string")
    assert text_index.build(empty, new_dir(spark, "test_index")).search(asked, 3)[0].collect() == []
    blank = spark.createDataFrame([(1, None), (2, ""), (3, "a")], "doc_id long, text string")
    assert [r["doc_id"] for r in text_index.build(blank, new_dir(spark, "test_index")).search(asked, 3)[0].collect()] == [3]


def plain_nearest(vectors, queries, limit):
    out = []
    for q, v in queries:
        cos = lambda a, b: float(np.dot(a, b) / np.sqrt(np.dot(a, a) * np.dot(b, b))) if np.any(a) and np.any(b) else 0.0
        scored = sorted((-round(cos(np.array(v), np.array(w)), 6), i) for i, w in vectors)
        out += [(q, i, -s + 0.0, r) for r, (s, i) in enumerate(scored[:limit], 1)]
    return sorted(out)


def test_vector_index_like_all_vectors(spark, monkeypatch):
    """Clusters, equal vectors, a zero vector, a query that is no vector; chunks of a hot list."""
    monkeypatch.setattr(vector_index, "CHUNK", 60)
    rng = np.random.default_rng(8)
    homes = rng.normal(size=(12, 10)) * 3
    data = [(i, (homes[i % 12 if i % 3 else 0] + rng.normal(size=10)).astype("float32").tolist()) for i in range(500)]
    data += [(600 + i, data[3][1]) for i in range(5)] + [(700, [0.0] * 10)]
    queries = [(i, v) for i, v in data[::25]] + [(-1, rng.normal(size=10).astype("float32").tolist()), (-2, [0.0] * 10)]
    df = spark.createDataFrame([*data, (999, None)], "vec_id long, embedding array<float>").repartition(3)
    path = new_dir(spark, "test_vectors")
    built = vector_index.build(df, path)
    asked = spark.createDataFrame(queries, "query_id long, embedding array<float>")
    rows = lambda hits: sorted((r["query_id"], r["vec_id"], round(r["score"], 6), r["rank"]) for r in hits.collect())
    want = plain_nearest(data, queries, 6)
    assert rows(built.exact(asked, 6)) == want
    found = rows(vector_index.VectorIndex(spark, path).probe(asked, 6))
    recall = len({r[:2] for r in found} & {r[:2] for r in want if r[0] != -2}) / len([r for r in want if r[0] != -2])
    assert recall >= 0.95
    assert built.exact(spark.createDataFrame([(1, [1.0] * 10)], "query_id long, embedding array<float>"), 1000).count() == len(data)


def test_recall_of_probes(spark):
    """The registered query against its exact twin, on all vectors."""
    folder = "/root/testdata/sf0.1"
    pairs = lambda df: {(r["query_id"], r["vec_id"]) for r in df.collect()}
    exact = pairs(indexed.vector_index_topk(spark, folder))
    assert len(pairs(indexed.vector_probe_topk(spark, folder)) & exact) >= 0.95 * len(exact)


def test_codes_of_vectors():
    """A coded vector is no farther from the vector than ``err`` tells."""
    rng = np.random.default_rng(1)
    vectors = vector_index.unit(rng.normal(size=(300, 20)))
    model = vector_index.Model.fit(vectors[:200], 9)
    of, codes, err, far = model.encoded(vectors.copy())
    for i in range(300):
        coded = model.centres[of[i]] + np.concatenate([w[c] for w, c in zip(model.words, codes[i], strict=True)])
        assert abs(np.linalg.norm(vectors[i] - coded) - err[i]) < 1e-5
        assert abs(np.linalg.norm(vectors[i] - model.centres[of[i]]) - far[i]) < 1e-5
        assert abs(model.products(vectors[:1], of[i], codes[i : i + 1])[0, 0] - vectors[0] @ coded) < 1e-5


def written_rows(monkeypatch):
    """Rows of each table that searches write."""
    seen, write = [], text_index.materialize

    def counted(df, tag, *rest):
        table = write(df, tag, *rest)
        seen.append(table.count())
        return table

    monkeypatch.setattr(text_index, "materialize", counted)
    return seen


def test_nothing_is_written_for_a_query_and_a_window(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"a b{i % 7} c{i % 3}") for i in range(700)], "doc_id long, text string").coalesce(2)
    built = text_index.build(docs, new_dir(spark, "test_index"), window=4)
    seen = written_rows(monkeypatch)
    asked = spark.createDataFrame([(k, f"a b{k % 7} c{k % 3}") for k in range(25)], "query_id long, query string")
    assert built.search(asked, 3)[0].count() == 75
    assert built.windows.count() == 176 and max(seen) <= 25 * 8


def test_queries_share_sets_of_excluded_documents(spark):
    docs = [(i, f"a {'bcdefgh'[i % 7]} {'xyz'[i % 3]}") for i in range(300)]
    queries = [(k, f"a {'bcdefgh'[k % 7]} {'xyz'[k % 3]}") for k in range(25)]
    built = text_index.build(spark.createDataFrame(docs, "doc_id long, text string"), new_dir(spark, "test_index"), window=16)
    asked = spark.createDataFrame([(k, t, k % 5) for k, t in queries], "query_id long, query string, k long")
    sets = spark.createDataFrame([(i % 5, i) for i in range(300)], "k long, doc_id long")
    got = sorted((r["query_id"], r["doc_id"], round(r["score"], 6), r["rank"]) for r in built.search(asked, 4, sets, by="k")[0].collect())
    assert got == plain_bm25(docs, queries, 4, {(k, i) for k, _ in queries for i in range(300) if i % 5 == k % 5})


def test_few_vectors_leave_the_tasks_of_an_exact_search(spark, monkeypatch):
    """Vectors without clusters: what is scored again stays near the limit, and lists share shelves."""
    seen, scored = [], vector_index.VectorIndex._scored

    def counted(self, found, queries):
        seen.append(found.count())
        return scored(self, found, queries)

    monkeypatch.setattr(vector_index.VectorIndex, "_scored", counted)
    rng = np.random.default_rng(2)
    data = [(i, rng.normal(size=32).astype("float32").tolist()) for i in range(3000)]
    built = vector_index.build(spark.createDataFrame(data, "vec_id long, embedding array<float>"), new_dir(spark, "test_vectors"))
    asked = spark.createDataFrame(data[::100], "query_id long, embedding array<float>")
    got = sorted((r["query_id"], r["rank"], r["vec_id"]) for r in built.exact(asked, 5).collect())
    assert got == sorted((q, r, i) for q, i, _, r in plain_nearest(data, data[::100], 5)) and max(seen) <= 30 * 25


def test_search_in_turns(spark, monkeypatch):
    """Few pairs of a query and a group at a time: as many tables as turns, the same documents, blocks and exclusions."""
    rng = random.Random(9)
    docs = [(i, " ".join(rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(rng.randint(0, 20)))) for i in range(200)]
    asked = spark.createDataFrame([(q, " ".join(rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(4))) for q in range(12)], "query_id long, query string")
    out = spark.createDataFrame([(q, i) for q in range(12) for i in range(q, 200, 7)], "query_id long, doc_id long")
    index = text_index.build(spark.createDataFrame(docs, "doc_id long, text string").coalesce(2), new_dir(spark, "test_turns"), window=16, buckets=4)
    want = [sorted(map(tuple, x.collect())) for x in index.search(asked, 3, out)]
    tags, plain = [], text_index.materialize
    monkeypatch.setattr(text_index, "materialize", lambda df, tag, *a: tags.append(tag) or plain(df, tag, *a))
    monkeypatch.setattr(text_index, "DEALT", 24)
    found = [sorted(map(tuple, x.collect())) for x in index.search(asked, 3, out)]
    assert found[0] == want[0] and [x[:2] for x in found[1]] == [x[:2] for x in want[1]]
    assert tags.count("found") >= 4


def test_lists_are_unpacked_where_they_lie():
    lists = [[5, 300], [7], [1 << 20, 0, 2]]
    column = text_index.packed_lists(np.concatenate([np.array(x) for x in lists]), np.array([0, 2, 3]))
    assert text_index.unpacked_lists(column.slice(1)).tolist() == [7, 1 << 20, 0, 2]
    import pyarrow as pa

    assert text_index.unpacked_lists(pa.chunked_array([column.slice(0, 1), column.slice(2)])).tolist() == [5, 300, 1 << 20, 0, 2]
    assert text_index.unpacked_lists(column.slice(0, 0)).tolist() == text_index.unpacked_lists(pa.chunked_array([], pa.binary())).tolist() == []
