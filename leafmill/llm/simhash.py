"""Near-duplicate groups by 64-bit SimHash and pivot distance tables (operator 5).

A text's fingerprint takes the majority of every bit over the XXH64 hashes of its word
shingles. Fingerprints link when at most ``MAX_BITS`` = 2 bits differ.

Pivots are reference fingerprints whose set bits lie inside one of four 16-bit blocks.
The distances to the pivots of a block, minus the distance to the first of them, depend on
that block's bits alone. Of four blocks, two differing bits leave two unchanged, so any
linked pair agrees on all such coordinates of at least one pair of blocks: the coordinates
of the six pairs of blocks are bucket keys. Inside a bucket a pair is discarded when any
two pivot distances differ by more than ``MAX_BITS`` (the triangle inequality), and
survivors are verified bit by bit. A bucket returns a spanning forest of its links, never
all pairs. Members of buckets of more than ``BUCKET_LIMIT`` distinct fingerprints are
linked exactly another way: two fingerprints are linked if and only if they share one of
their 65 variants with at most one bit flipped, and at most 65 fingerprints share one.

Equal fingerprints are merged before anything is compared, so exact copies cost one row.

Defined results: null or empty text has fingerprint zero and is linked like any other; a
null ``doc_id`` links its text but is only a ``component_id`` where no row of the component
has an id; repeated rows are returned each; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from leafmill.llm._common import FEW_FILES, map_batches, materialize, read_table
from leafmill.llm._graph import connected_components

SHINGLE_WORDS = 3
MAX_BITS = 2
BUCKET_LIMIT = 1024
BLOCKS = 4
PIVOTS_PER_BLOCK = 12
SEED = 42


def shingle_hashes(text: str | None, size: int = SHINGLE_WORDS) -> np.ndarray:
    """XXH64 of the shingles of ``size`` words, repeats included; A-Z are lower-cased."""
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    if len(words) <= size:
        shingles = [b" ".join(words)]
    else:
        shingles = [b" ".join(t) for t in zip(*(words[i:] for i in range(size)), strict=False)]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(s, SEED) for s in shingles), np.uint64, len(shingles))


def fingerprint(text: str | None, size: int = SHINGLE_WORDS) -> int:
    """The SimHash of a text as an unsigned integer; 0 without words."""
    return majority(shingle_hashes(text, size))


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half the hashes."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 15):
        part = np.ascontiguousarray(hashes[at : at + (1 << 15)], "<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the signed 64-bit fingerprint in ``_lm_fp``."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
            got = np.fromiter((fingerprint(x) for x in texts), np.uint64, len(texts)).view(np.int64)
            yield batch.append_column("_lm_fp", pa.array(got))

    return map_batches(docs, add, StructType([*docs.schema.fields, StructField("_lm_fp", LongType())]))


def pivots() -> np.ndarray:
    """(BLOCKS, PIVOTS_PER_BLOCK) reference fingerprints, each with bits in one block."""
    rng = np.random.default_rng(64)
    width = 64 // BLOCKS
    rows = rng.integers(1, 1 << width, (BLOCKS, PIVOTS_PER_BLOCK), dtype=np.uint64)
    rows[:, 0] = 0
    return rows << (np.arange(BLOCKS, dtype=np.uint64) * np.uint64(width))[:, None]


def distances(fps: np.ndarray) -> np.ndarray:
    """(n, BLOCKS, PIVOTS_PER_BLOCK) Hamming distances of unsigned fingerprints to the pivots."""
    return np.bitwise_count(fps[:, None, None] ^ pivots()[None]).astype(np.int8)


def coordinates(fps: np.ndarray) -> np.ndarray:
    """(n, BLOCKS) codes of the pivot coordinates of each block."""
    own = distances(fps)
    local = (own - own[:, :, :1]).astype(np.int64).view(np.uint64)
    rng = np.random.default_rng(65)
    mix = rng.integers(1, 1 << 63, (BLOCKS, PIVOTS_PER_BLOCK), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return (local * mix).sum(axis=2, dtype=np.uint64)


def bucket_keys(fps: np.ndarray) -> np.ndarray:
    """(n, 6) keys; two fingerprints of at most two differing bits share at least one."""
    code = coordinates(fps)
    keys = [
        (code[:, a] ^ (code[:, b] * np.uint64(0x9E3779B97F4A7C15))) + np.uint64((a * BLOCKS + b) * 0xBF58476D1CE4E5B9 % (1 << 64))
        for a in range(BLOCKS)
        for b in range(a + 1, BLOCKS)
    ]
    return np.stack(keys, axis=1)


def spanning_links(members: np.ndarray) -> list[tuple[int, int]]:
    """A forest of links that joins what the links among ``members`` join; pairs of places."""
    table = distances(members).reshape(len(members), -1)
    root = np.arange(len(members))
    found = []
    for i in range(len(members) - 1):
        near = np.flatnonzero(np.abs(table[i + 1 :] - table[i]).max(axis=1) <= MAX_BITS) + i + 1
        for j in near[np.bitwise_count(members[near] ^ members[i]) <= MAX_BITS]:
            a, b = root[i], root[j]
            if a != b:
                root[root == max(a, b)] = min(a, b)
                found.append((i, int(j)))
    return found


def nearest_links(members: np.ndarray, bits: int) -> list[tuple[int, int]]:
    """Each member with the nearest one before it, where at most ``bits`` bits differ; pairs of places."""
    table = distances(members).reshape(len(members), -1)
    found = []
    for i in range(1, len(members)):
        near = np.flatnonzero(np.abs(table[:i] - table[i]).max(axis=1) <= bits)
        if len(near):
            far = np.bitwise_count(members[near] ^ members[i])
            if far.min() <= bits:
                found.append((i, int(near[far.argmin()])))
    return found


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fps = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        keys = bucket_keys(fps)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(keys.reshape(-1).view(np.int64)),
                pa.array(np.repeat(fps, keys.shape[1]).view(np.int64)),
            ],
            ["key", "fp"],
        )


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = [], []
        for members in batch.column(0):
            fps = np.array(members.values.to_numpy(zero_copy_only=False)).view(np.uint64)
            for i, j in spanning_links(fps):
                a.append(int(fps[i].view(np.int64)))
                b.append(int(fps[j].view(np.int64)))
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def links(fps: DataFrame, bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """(a, b): links between distinct fingerprints (column ``fp``) that connect what all links connect."""
    keyed = materialize(map_batches(fps.select("fp"), _keyed, "key long, fp long"), "keyed", FEW_FILES)
    sizes = materialize(keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "sizes", FEW_FILES)
    shared = materialize(keyed.join(sizes, "key"), "shared", FEW_FILES)
    buckets = (
        shared.where(F.col("n") <= bucket_limit).groupBy("key").agg(F.collect_list("fp").alias("members")).select("members")
    )
    small = map_batches(buckets, _linked, "a long, b long")
    flips = F.array(F.lit(0).cast("long"), *(F.lit(1 << i if i < 63 else -(1 << 63)).cast("long") for i in range(64)))
    variants = (
        shared.where(F.col("n") > bucket_limit)
        .select("fp")
        .distinct()
        .select("fp", F.explode(F.transform(flips, lambda x: F.col("fp").bitwiseXOR(x))).alias("variant"))
    )
    large = (
        variants.groupBy("variant")
        .agg(F.collect_list("fp").alias("members"))
        .where(F.size("members") > 1)
        .select(F.array_min("members").alias("a"), F.explode("members").alias("b"))
        .where("a <> b")
    )
    return small.unionByName(large).distinct()


def components(prints: DataFrame, bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """From (doc_id, fp): one row for each distinct fp with its component's least doc_id.

    Columns fp, component_id, and keeper_fp: the fingerprint of the row that stands for the component.
    """
    merged = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct", FEW_FILES)
    joined = connected_components(links(merged, bucket_limit)).select(F.col("node").alias("fp"), "label")
    labelled = materialize(
        merged.join(joined, "fp", "left").withColumn("label", F.coalesce("label", "fp")), "labelled", FEW_FILES
    )
    best = materialize(
        labelled.groupBy("label")
        .agg(F.min(F.struct(F.col("first_id").isNull().alias("none"), "first_id", "fp")).alias("best"))
        .select("label", F.col("best.first_id").alias("component_id"), F.col("best.fp").alias("keeper_fp")),
        "best",
        FEW_FILES,
    )
    return labelled.join(best, "label").select("fp", "component_id", "keeper_fp")


def near_duplicates(docs: DataFrame, bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs``."""
    prints = materialize(
        fingerprints(docs.select("doc_id", "text")).select("doc_id", F.col("_lm_fp").alias("fp")), "prints"
    )
    groups = materialize(components(prints, bucket_limit), "groups", FEW_FILES)
    return prints.join(groups, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` without near duplicates: of each component the row of the least doc_id.

    Rows that repeat both doc_id and fingerprint count as one document.
    """
    prints = materialize(
        fingerprints(docs.select("doc_id", "text")).select("doc_id", F.col("_lm_fp").alias("fp")), "prints"
    )
    keepers = materialize(
        components(prints)
        .where("fp = keeper_fp")
        .select(F.col("component_id").alias("_lm_id"), F.col("fp").alias("_lm_keep")),
        "keepers",
        FEW_FILES,
    )
    full = fingerprints(docs)
    kept = full.join(
        keepers, F.col("doc_id").eqNullSafe(F.col("_lm_id")) & (F.col("_lm_fp") == F.col("_lm_keep")), "left_semi"
    )
    return kept.dropDuplicates(["doc_id", "_lm_fp"]).select(*docs.columns)


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"))
