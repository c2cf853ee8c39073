"""A persisted vector index for tables of queries: inverted lists of residual product codes.

Vectors are compared by cosine, so they are scaled to length 1 first. Lists are around centroids;
what a vector differs from its list's centroid is coded in ``PARTS`` bytes, each the number of
the nearest codeword in some of the dimensions, and ``err``, the length that the code
leaves out. A search reads codes, adds up a query's products with the codewords and scores the
``REFINE`` most promising vectors again from their own numbers.

``probe`` looks into each query's nearest lists only, and may miss some. ``exact`` misses none: the last
of the best products in the nearest lists is a threshold, and a list may hold better ones only if its centroid's
product plus its radius reaches it. There a query meets the vectors themselves, as a product of matrices, and
only those that reach the threshold leave the task. Small lists share a shelf, so that a query is sent once for
about ``CHUNK`` vectors and not to each list.

Centroids and codewords are fitted on about ``SAMPLE`` vectors drawn from the whole table; every
vector is indexed. Lists are cut into chunks of about ``CHUNK`` vectors: a task meets one chunk and the queries that look into it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from leafmill.operators.retrieval import ROUND, cosine
from leafmill.storage import materialize, write_table

SAMPLE, MAX_LISTS, PARTS, CODEWORDS = 20_000, 4096, 16, 256
CHUNK, PROBES, REFINE = 8192, 8, 20
#: Products that are held at once.
SLAB = 1 << 22
#: What sums of single-precision products may differ by.
SLACK = 1e-4


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1; zero rows stay."""
    length = np.linalg.norm(vectors, axis=1, keepdims=True)
    return (vectors / np.where(length > 0, length, 1)).astype(np.float32)


def nearest(vectors: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The number of the nearest centre of each row."""
    out = np.empty(len(vectors), np.int64)
    step = max(1, SLAB // max(1, len(centres)))
    half = (centres * centres).sum(axis=1) / 2
    for a in range(0, len(vectors), step):
        out[a : a + step] = (vectors[a : a + step] @ centres.T - half).argmax(axis=1)
    return out


def centres_of(vectors: np.ndarray, k: int, rounds: int = 12, seed: int = 3) -> np.ndarray:
    """At most ``k`` centres by Lloyd's rounds from vectors drawn at random."""
    distinct = np.unique(vectors, axis=0)
    rng = np.random.default_rng(seed)
    centres = distinct[np.sort(rng.choice(len(distinct), min(k, len(distinct)), replace=False))].copy()
    for _ in range(rounds if len(distinct) > k else 0):
        of = nearest(vectors, centres)
        n = np.bincount(of, minlength=len(centres))
        for d in range(vectors.shape[1]):
            sums = np.bincount(of, vectors[:, d], len(centres))
            centres[n > 0, d] = (sums[n > 0] / n[n > 0]).astype(np.float32)
    return centres


class Model:
    """Centroids of lists, and codewords for each part of the dimensions."""

    def __init__(self, centres: np.ndarray, words: list[np.ndarray]):
        self.centres, self.words = centres, words
        self.cuts = np.cumsum([0] + [w.shape[1] for w in words])

    @classmethod
    def fit(cls, sample: np.ndarray, lists: int) -> Model:
        centres = centres_of(sample, lists)
        rest = sample - centres[nearest(sample, centres)]
        parts = np.array_split(rest, min(PARTS, sample.shape[1]), axis=1)
        return cls(centres, [centres_of(p, CODEWORDS) for p in parts])

    def encoded(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(list, codes, err, distance from the centroid) of unit vectors."""
        of = nearest(vectors, self.centres)
        rest = vectors - self.centres[of]
        far = np.linalg.norm(rest, axis=1)
        codes = np.empty((len(vectors), len(self.words)), np.uint8)
        for m, words in enumerate(self.words):
            part = rest[:, self.cuts[m] : self.cuts[m + 1]]
            codes[:, m] = nearest(part, words)
            part -= words[codes[:, m]]
        return of, codes, np.linalg.norm(rest, axis=1), far

    def products(self, queries: np.ndarray, of: int, codes: np.ndarray) -> np.ndarray:
        """Products of queries with the coded vectors of a list, one row a query."""
        out = np.repeat((queries @ self.centres[of])[:, None], len(codes), axis=1)
        for m, words in enumerate(self.words):
            out += (queries[:, self.cuts[m] : self.cuts[m + 1]] @ words.T)[:, codes[:, m]]
        return out


def _matrix(column: pa.Array) -> np.ndarray:
    """A column of vectors of one length as rows."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.float64).reshape(len(column), -1) if len(column) else np.empty((0, 1))


def build(vectors: DataFrame, path: str, id_col: str = "vec_id", vector: str = "embedding", lists: int | None = None) -> VectorIndex:
    """Write the index of ``vectors``, all of one length, below ``path``: tables ``codes``, ``lists`` and ``model``.

    ``lists`` is the root of the number of vectors where it is not given. Null vectors are left out.
    """
    spark = vectors.sparkSession
    rows = vectors.where(F.col(vector).isNotNull()).select(F.col(id_col).alias("id"), F.col(vector).cast("array<float>").alias("vector"))
    n = rows.count()
    sample = rows if n <= SAMPLE else rows.where(F.rand(5) < SAMPLE / n)
    learned = unit(_matrix(sample.select("vector").toArrow()["vector"].combine_chunks())) if n else np.empty((0, 1), np.float32)
    model = Model.fit(learned, min(MAX_LISTS, lists or max(1, round(n**0.5)))) if n else Model(learned, [])
    shared = spark.sparkContext.broadcast(model)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            of, codes, err, far = shared.value.encoded(unit(_matrix(batch["vector"])))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(of, pa.int32()), pa.array([c.tobytes() for c in codes]), pa.array(err, pa.float32()), pa.array(far, pa.float32())],
                ["id", "vector", "list", "code", "err", "far"],
            )

    schema = StructType(list(rows.schema)).add("list", "integer").add("code", "binary").add("err", "float").add("far", "float")
    coded = materialize(rows.mapInArrow(encode, schema), "coded").withColumn("row", F.monotonically_increasing_id())
    sizes = coded.groupBy("list").agg(F.count("*").alias("n"), F.max("far").alias("radius"))
    write_table(sizes.withColumn("chunks", F.ceil(F.col("n") / CHUNK).cast("int")), f"{path}/lists")
    chunks = spark.read.parquet(f"{path}/lists").select("list", "chunks")
    placed = coded.join(F.broadcast(chunks), "list").withColumn("chunk", F.expr("cast(pmod(xxhash64(row), chunks) as int)"))
    placed = placed.drop("row", "chunks", "far").repartitionByRange("list", "chunk").sortWithinPartitions("list", "chunk")
    write_table(placed, f"{path}/codes")
    parts = [("centre", 0, c.tolist()) for c in model.centres] + [("word", m, w.tolist()) for m, ws in enumerate(model.words) for w in ws]
    told = [(i, *p) for i, p in enumerate(parts)]
    write_table(spark.createDataFrame(told, "no int, kind string, part int, numbers array<float>"), f"{path}/model")
    return VectorIndex(spark, path)


class VectorIndex:
    """An index that ``build`` wrote, opened for searches."""

    def __init__(self, spark: SparkSession, path: str):
        self.codes, self.lists = spark.read.parquet(f"{path}/codes"), spark.read.parquet(f"{path}/lists")
        told = spark.read.parquet(f"{path}/model").orderBy("no").collect()
        rows = lambda kind, part: np.array([r["numbers"] for r in told if (r["kind"], r["part"]) == (kind, part)], np.float32)
        parts = sorted({r["part"] for r in told if r["kind"] == "word"})
        self.model = Model(rows("centre", 0), [rows("word", m) for m in parts])
        self._shared = spark.sparkContext.broadcast(self.model)

    def _pairs(self, queries: DataFrame, probes: int | None) -> DataFrame:
        """(query, vector, list, product): each query with its ``probes`` nearest lists, or with all."""
        shared = self._shared

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not len(batch):
                    continue
                products = unit(_matrix(batch["vector"])) @ shared.value.centres.T
                k = products.shape[1] if probes is None else min(probes, products.shape[1])
                best = np.argsort(-products, axis=1, kind="stable")[:, :k]
                row = np.repeat(np.arange(len(batch)), k)
                yield pa.RecordBatch.from_arrays(
                    [*(c.take(pa.array(row)) for c in batch.columns), pa.array(best.ravel(), pa.int32()), pa.array(products[row, best.ravel()], pa.float32())],
                    [*batch.schema.names, "list", "product"],
                )

        return queries.mapInArrow(run, StructType(list(queries.schema)).add("list", "integer").add("product", "float"))

    def _scanned(self, pairs: DataFrame, keep: int) -> DataFrame:
        """(query, list, id, product) of coded vectors: the ``keep`` greatest of a chunk."""
        shared = self._shared

        def scan(key: tuple, coded: pa.Table, asked: pa.Table) -> pa.Table:
            of, out = key[0].as_py(), []
            codes = np.frombuffer(b"".join(coded["code"].to_pylist()), np.uint8).reshape(len(coded), -1)
            step = max(1, SLAB // max(1, len(coded)))
            for a in range(0, len(asked) if len(coded) else 0, step):
                part = asked.slice(a, step)
                products = shared.value.products(unit(_matrix(part["vector"].combine_chunks())), of, codes)
                k = min(keep, len(coded))
                col = np.argpartition(-products, k - 1, axis=1)[:, :k].ravel()
                row = np.repeat(np.arange(len(part)), k)
                out.append((part["query"].take(pa.array(row)), coded["id"].take(pa.array(col)), products[row, col]))
            return pa.table(
                {
                    "query": pa.chunked_array([x for q, _, _ in out for x in q.chunks], asked["query"].type),
                    "list": pa.array([of] * sum(len(p) for _, _, p in out), pa.int32()),
                    "id": pa.chunked_array([x for _, i, _ in out for x in i.chunks], coded["id"].type),
                    "product": pa.array(np.concatenate([p for _, _, p in out]) if out else [], pa.float32()),
                }
            )

        asked = pairs.join(F.broadcast(self.lists.select("list", "chunks")), "list").withColumn(
            "chunk", F.explode(F.expr("sequence(0, chunks - 1)"))
        )
        key = ["list", "chunk"]
        asked = asked.select(*key, "query", "vector")
        schema = StructType([pairs.schema["query"]]).add("list", "integer").add(self.codes.schema["id"]).add("product", "float")
        return self.codes.select(*key, "id", "code").groupBy(*key).cogroup(asked.groupBy(*key)).applyInArrow(scan, schema)

    def _scored(self, found: DataFrame, queries: DataFrame) -> DataFrame:
        """(query, id, score) of found vectors by their own numbers."""
        own = self.codes.select("list", "id", F.col("vector").alias("own"))
        both = found.select("query", "list", "id").join(queries, "query").join(own, ["list", "id"])
        return both.select("query", "id", F.round(cosine(F.col("vector"), F.col("own")), ROUND).alias("score"))

    def probe(
        self, queries: DataFrame, limit: int, probes: int = PROBES, refine: int = REFINE, query_col: str = "query_id", vector: str = "embedding", id_col: str = "vec_id"
    ) -> DataFrame:
        """(query, id, score, rank) from each query's ``probes`` nearest lists, ``refine`` x ``limit`` of them scored again."""
        asked = materialize(queries.select(F.col(query_col).alias("query"), F.col(vector).cast("array<float>").alias("vector")), "asked")
        return _named(_ranked(self._probed(asked, limit, probes, refine), limit), query_col, id_col)

    def _probed(self, asked: DataFrame, limit: int, probes: int, refine: int) -> DataFrame:
        found = self._scanned(self._pairs(asked, probes), refine * limit)
        best = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("product"), "id"))
        return self._scored(found.withColumn("at", best).where(F.col("at") <= refine * limit), asked)

    def exact(
        self, queries: DataFrame, limit: int, probes: int = PROBES, query_col: str = "query_id", vector: str = "embedding", id_col: str = "vec_id"
    ) -> DataFrame:
        """(query, id, score, rank) of the nearest of all vectors; lists that cannot hold any of them are passed over."""
        asked = materialize(queries.select(F.col(query_col).alias("query"), F.col(vector).cast("array<float>").alias("vector")), "asked")
        near = self._met(self._pairs(asked, probes).withColumn("least", F.lit(-2.0).cast("float")), limit)
        at = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("product")))
        last = near.select("query", "product").withColumn("at", at).where(F.col("at") == limit)
        least = materialize(last.select("query", (F.col("product") - 2 * SLACK).cast("float").alias("least")), "least")
        pairs = self._pairs(asked, None).join(F.broadcast(self.lists.select("list", "radius")), "list").join(least, "query", "left")
        pairs = pairs.na.fill(-2.0, ["least"]).where(F.col("product") + F.col("radius") + SLACK >= F.col("least"))
        return _named(_ranked(self._scored(self._met(pairs, None), asked), limit), query_col, id_col)

    def _met(self, pairs: DataFrame, keep: int | None) -> DataFrame:
        """(query, list, id, product) of the vectors in each query's lists: the ``keep`` greatest of a shelf, or all that reach ``least``."""

        def meet(key: tuple, own: pa.Table, asked: pa.Table) -> pa.Table:
            out = []
            if len(own) and len(asked):
                vectors, lists = unit(_matrix(own["vector"].combine_chunks())), own["list"].to_numpy()
                wanted = asked["lists"].combine_chunks()
                width = max(int(lists.max()), int(pc.max(wanted.flatten()).as_py())) + 1
                step = max(1, SLAB // max(len(own), width))
                for a in range(0, len(asked), step):
                    part, of = asked.slice(a, step), wanted.slice(a, step)
                    may = np.zeros((len(part), width), bool)
                    may[np.repeat(np.arange(len(part)), of.value_lengths().to_numpy()), of.flatten().to_numpy()] = True
                    products = np.where(may[:, lists], unit(_matrix(part["vector"].combine_chunks())) @ vectors.T, -np.inf)
                    low = part["least"].to_numpy()
                    if keep is not None and keep < len(own):
                        low = np.maximum(low, np.partition(products, len(own) - keep, axis=1)[:, len(own) - keep])
                    row, col = np.nonzero(products >= low[:, None])
                    if keep is not None:  # any of those that tie for the last place
                        order = np.lexsort((-products[row, col], row))
                        row, col = row[order], col[order]
                        few = np.arange(len(row)) - np.searchsorted(row, row) < keep
                        row, col = row[few], col[few]
                    out.append((part["query"].take(pa.array(row)), own.select(["list", "id"]).take(pa.array(col)), products[row, col]))
            return pa.table(
                {
                    "query": pa.chunked_array([x for q, _, _ in out for x in q.chunks], asked["query"].type),
                    "list": pa.chunked_array([x for _, t, _ in out for x in t["list"].chunks], pa.int32()),
                    "id": pa.chunked_array([x for _, t, _ in out for x in t["id"].chunks], own["id"].type),
                    "product": pa.array(np.concatenate([p for _, _, p in out]) if out else [], pa.float32()),
                }
            )

        # A shelf is as many lists in a row as have about CHUNK vectors; a list of several chunks is one of its own.
        told = self.lists.select("list", "n", "chunks").orderBy("list").toPandas()
        shelf = np.where(told["chunks"] > 1, -1 - told["list"], told["n"].cumsum() // CHUNK)
        rows = list(zip(told["list"].tolist(), shelf.tolist(), told["chunks"].tolist(), strict=True))
        shelves = lambda: F.broadcast(pairs.sparkSession.createDataFrame(rows, "list int, shelf long, chunks int"))
        key = ["shelf", "chunk"]
        asked = pairs.join(shelves(), "list").groupBy("query", "shelf", "chunks").agg(F.first("vector").alias("vector"), F.first("least").alias("least"), F.collect_list("list").alias("lists"))
        asked = asked.withColumn("chunk", F.explode(F.expr("sequence(0, chunks - 1)"))).select(*key, "query", "vector", "least", "lists")
        own = self.codes.join(shelves().drop("chunks"), "list").select(*key, "list", "id", "vector")
        schema = StructType([pairs.schema["query"]]).add("list", "integer").add(self.codes.schema["id"]).add("product", "float")
        return own.groupBy(*key).cogroup(asked.groupBy(*key)).applyInArrow(meet, schema)


def _ranked(scored: DataFrame, limit: int) -> DataFrame:
    best = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id")).cast("long")
    return scored.withColumn("rank", best).where(F.col("rank") <= limit)


def _named(ranked: DataFrame, query_col: str, id_col: str) -> DataFrame:
    return ranked.select(F.col("query").alias(query_col), F.col("id").alias(id_col), "score", "rank")
