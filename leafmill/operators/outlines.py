"""Outlines from documents: clusters of a clustering-feature tree become sections, their terms titles.

A document is a vector of whole numbers: its words' counts in ``SIZE`` hashed places, scaled to length ``SCALE``.
A clustering feature is (documents, sum of vectors, sum of squares); features of parts add up exactly, in any
order. The tree's branches are the signs of ``DEPTH`` fixed projections of a vector less the mean of all, in whole
numbers too, so that the tree is the same however the documents are partitioned. Tasks sum features by path, Spark
adds them up, and at most 2 ** ``DEPTH`` of them are seen by the driver, which joins branches with too few
documents and then, pair by pair, those leaves whose union raises the sum of squared distances least
(Ward), until there are as many as sections are wanted. Every document then goes to the section whose mean is
nearest, the first of equally near ones.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructType
from pyspark.sql.window import Window

from leafmill.functions.text import tokens
from leafmill.storage import materialize

SIZE, SCALE, DEPTH, SEED = 64, 1000, 10, 17
TITLE_WORDS, POINTS = 3, 3


def vector_of(words: list[str]) -> np.ndarray:
    """The scaled counts of hashed words; zeros where there are none."""
    out = np.zeros(SIZE, np.int64)
    for word, n in Counter(words).items():
        out[zlib.crc32(word.encode()) % SIZE] += n
    length = float(np.sqrt(float((out * out).sum())))
    return np.floor(SCALE * out / length + 0.5).astype(np.int64) if length else out


def directions() -> np.ndarray:
    """``DEPTH`` projections of 1 and -1."""
    return np.random.default_rng(SEED).integers(0, 2, (SIZE, DEPTH)) * 2 - 1


def paths_of(vectors: np.ndarray, total: np.ndarray, n: int) -> np.ndarray:
    """The leaf of each vector, a bit for each projection of n times the vector less the sum of all."""
    above = (n * vectors - total) @ directions() > 0
    return above @ (1 << np.arange(DEPTH - 1, -1, -1))


@dataclass
class Feature:
    """Documents, sum of vectors, sum of squares."""

    n: int
    total: np.ndarray
    squares: int

    def __add__(self, other: Feature) -> Feature:
        return Feature(self.n + other.n, self.total + other.total, self.squares + other.squares)

    def scatter(self) -> float:
        """The sum of squared distances from the mean."""
        return self.squares - sum(int(x) ** 2 for x in self.total) / self.n

    def cost_of(self, other: Feature) -> float:
        """How much their union raises the scatter."""
        apart = self.total / self.n - other.total / other.n
        return float(apart @ apart) * self.n * other.n / (self.n + other.n)


def leaves_of(features: dict[int, Feature], least: int) -> list[tuple[list[int], Feature]]:
    """(paths, feature) of branches, split as long as both sides have ``least`` documents."""

    def grow(paths: list[int], bit: int) -> Iterator[tuple[list[int], Feature]]:
        sides = [[p for p in paths if (p >> bit & 1) == side] for side in (0, 1)] if bit >= 0 else []
        if all(sum(features[p].n for p in side) >= least for side in sides) and bit >= 0:
            for side in sides:
                yield from grow(side, bit - 1)
        elif bit > 0:
            yield from grow(paths, bit - 1)
        else:
            whole = features[paths[0]]
            for p in paths[1:]:
                whole = whole + features[p]
            yield paths, whole

    return list(grow(sorted(features), DEPTH - 1)) if features else []


def agglomerated(leaves: list[tuple[list[int], Feature]], sections: int) -> list[tuple[list[int], Feature]]:
    """Leaves joined until there are ``sections``; of equal costs the pair that comes first is joined."""
    groups = list(leaves)
    n = len(groups)
    cost = np.full((n, n), np.inf)
    for i in range(n):
        for j in range(i + 1, n):
            cost[i, j] = groups[i][1].cost_of(groups[j][1])
    alive = list(range(n))
    while len(alive) > max(1, sections):
        i, j = divmod(int(cost.argmin()), n)
        groups[i] = groups[i][0] + groups[j][0], groups[i][1] + groups[j][1]
        alive.remove(j)
        cost[j, :] = cost[:, j] = np.inf
        for k in alive:
            if k != i:
                cost[min(i, k), max(i, k)] = groups[i][1].cost_of(groups[k][1])
    return sorted((groups[i] for i in alive), key=lambda g: (-g[1].n, min(g[0])))


def nearest(vectors: np.ndarray, groups: list[Feature]) -> np.ndarray:
    """The group of the nearest mean for each vector; products are whole numbers, so batches change nothing."""
    totals, n = np.array([g.total for g in groups]), np.array([g.n for g in groups])
    lengths = np.array([sum(int(x) ** 2 for x in g.total) / g.n**2 for g in groups])
    return ((vectors @ totals.T) / n - lengths / 2).argmax(axis=1)


def _vectors(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [vector_of(words).tolist() for words in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.int32()))], [id_col, "vector"])

    schema = StructType([docs.schema[id_col]]).add("vector", ArrayType(IntegerType()))
    return materialize(docs.select(id_col, tokens(F.col(text))).mapInArrow(run, schema), "vectors")


def _rows(batch: pa.RecordBatch) -> np.ndarray:
    return batch["vector"].flatten().to_numpy().astype(np.int64).reshape(-1, SIZE)


def _features(vectors: DataFrame, total: np.ndarray | None = None, n: int = 0) -> dict[int, Feature]:
    """Features by path; by no path at all, as path 0, where the sum of all is not known yet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, np.ndarray] = {}
        for batch in batches:
            rows = _rows(batch)
            path = np.zeros(len(rows), np.int64) if total is None else paths_of(rows, total, n)
            told = np.column_stack([np.ones(len(rows), np.int64), rows, (rows * rows).sum(axis=1)])
            for p in np.unique(path).tolist():
                kept[p] = kept.get(p, 0) + told[path == p].sum(axis=0)
        width = SIZE + 2
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.repeat(list(kept), width), pa.int64()),
                pa.array(np.tile(np.arange(width), len(kept)), pa.int64()),
                pa.array(np.concatenate(list(kept.values())) if kept else [], pa.int64()),
            ],
            ["path", "at", "value"],
        )

    summed = vectors.select("vector").mapInArrow(run, "path long, at long, value long").groupBy("path", "at").agg(F.sum("value").alias("value"))
    out: dict[int, np.ndarray] = {}
    for r in summed.collect():
        out.setdefault(r["path"], np.zeros(SIZE + 2, np.int64))[r["at"]] = r["value"]
    return {p: Feature(int(v[0]), v[1:-1], int(v[-1])) for p, v in sorted(out.items())}


def outline(docs: DataFrame, sections: int, id_col: str = "doc_id", text: str = "text", least: int | None = None) -> tuple[DataFrame, DataFrame]:
    """((section_index, title, points, n_docs) of at most ``sections`` sections, (id, section_index) of every row).

    A title is made of the ``TITLE_WORDS`` words that a section has in more of its documents than
    others do, points are the next ones; a branch of fewer than ``least`` documents (an eighth of a section's share unless
    given) is not split off. Texts without words are together.
    """
    vectors = _vectors(docs, id_col, text)
    spark = docs.sparkSession
    schema = StructType([docs.schema[id_col]]).add("section_index", "integer")
    whole = _features(vectors).get(0)
    if whole is None:
        return spark.createDataFrame([], "section_index int, title string, points array<string>, n_docs long"), spark.createDataFrame([], schema)
    features = _features(vectors, whole.total, whole.n)
    least = least or max(1, whole.n // (8 * sections))
    groups = agglomerated(leaves_of(features, least), sections)
    means = [g for _, g in groups]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = nearest(_rows(batch), means)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int32())], [id_col, "section_index"])

    placed = materialize(vectors.mapInArrow(place, schema), "placed")
    return _titled(docs, placed, id_col, text, whole.n), placed


def _titled(docs: DataFrame, placed: DataFrame, id_col: str, text: str, n: int) -> DataFrame:
    """Sections with the words that tell them apart."""
    of = materialize(placed.groupBy("section_index").agg(F.count("*").alias("n_docs")), "sections")
    one = placed.dropDuplicates([id_col])
    words = docs.select(id_col, F.explode(F.array_distinct(tokens(F.col(text)))).alias("word")).join(one, id_col)
    counted = materialize(words.groupBy("section_index", "word").agg(F.count("*").alias("n")), "section_words")
    everywhere = counted.groupBy("word").agg(F.sum("n").alias("all"))
    inside, outside = F.col("n") / F.col("n_docs"), (F.col("all") - F.col("n")) / F.greatest(F.lit(n) - F.col("n_docs"), F.lit(1))
    scored = counted.join(everywhere, "word").join(F.broadcast(of), "section_index")
    scored = scored.withColumn("score", F.round(F.col("n") * (inside - outside), 9))
    best = F.row_number().over(Window.partitionBy("section_index").orderBy(F.desc("score"), "word"))
    top = scored.withColumn("at", best).where(F.col("at") <= TITLE_WORDS + POINTS)
    listed = top.groupBy("section_index").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]).alias("words"))
    words = F.coalesce("words", F.array().cast("array<string>"))
    return of.join(listed, "section_index", "left").select(
        "section_index",
        F.array_join(F.slice(words, 1, TITLE_WORDS), " ").alias("title"),
        F.slice(words, TITLE_WORDS + 1, POINTS).alias("points"),
        "n_docs",
    )
