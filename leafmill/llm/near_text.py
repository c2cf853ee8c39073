"""One document of each group of similar texts (pipeline's near-duplicate stage): SimHash and pivot tables, then an exact join.

Two texts are linked when the Jaccard similarity of their sets of five-word shingles is at
least 0.8. First SimHash fingerprints of the sets propose pairs: sets with equal pivot coordinates
in one block are a bucket, in it each is paired with the nearest one before it (``simhash``'s
pivot distances discard, bits verify) within ``PRINT_BITS``. What is similar of these, by the sets themselves, is linked.
Fingerprints miss pairs (at 0.8 they are expected to differ in 9.7 bits, and buckets of more than
``BUCKET_LIMIT`` sets are compared in parts), so an exact join finds the rest, and no linked pair is missed.

The exact join: shingle sets are ordered by hash; of a set of n shingles
the first n // 5 + 1 are its keys, and two sets of similarity 0.8 share at least one key (the
prefix filter). Pairs that the fingerprints have joined already are left out.

Pairs that share a key are compared in two steps, so that a group of m near copies does not
make m * m pairs. First each member of a key is paired with two members drawn by hash, and
the links found are joined to components. Then only pairs of different components are left.
Before a pair is verified it must pass a bound that loses nothing: the parities of a set's
hashes modulo a power of two differ in no more places than the sets have differing elements.

Equal shingle sets are merged before anything is compared.

Defined results: null and empty texts are equal; texts of one to four words have one
shingle; of each component the row of the least ``doc_id`` stays, rows without one only
where no row of the component has an id; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from leafmill.llm._common import FEW_FILES, discard, map_batches, materialize
from leafmill.llm._graph import connected_components
from leafmill.llm.simhash import BLOCKS, BUCKET_LIMIT, SEED, coordinates, majority, nearest_links, shingle_hashes

SHINGLE_WORDS = 5
#: Bits in which fingerprints of a proposed pair may differ: 9.7 are expected at a similarity of 0.8, and 1.5 standard deviations more.
PRINT_BITS = 14
#: Members of a key that one task compares; more are compared by pairs of blocks.
BLOCK = 4096
#: 64-bit words of the parities that are compared first, and up to how many members a key's sets go with these only.
BRIEF_WORDS = 16
BRIEF_MEMBERS = 64
#: Bits of the filter of sets that need verifying; more sets than it can tell apart only cost time.
FILTER_BITS = 1 << 25


def shingle_set(text: str | None) -> np.ndarray:
    """The distinct shingle hashes in order."""
    return np.unique(shingle_hashes(text, SHINGLE_WORDS))


def set_id(hashes: np.ndarray) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(np.ascontiguousarray(hashes, "<u8").tobytes(), SEED)


def parities(hashes: np.ndarray) -> np.ndarray:
    """Whether each value modulo a power of two (at least 256 and twice the set) occurs an odd number of times; as 64-bit words."""
    width = max(256, 1 << (2 * len(hashes)).bit_length())
    counts = np.bincount((hashes & np.uint64(width - 1)).astype(np.int64), minlength=width)
    return np.packbits((counts & 1).astype(np.uint8), bitorder="little").view("<u8")


def folded(words: np.ndarray, size: int) -> np.ndarray:
    return np.bitwise_xor.reduce(words.reshape(-1, size), axis=0)


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Jaccard similarity of at least 4/5 of two sorted sets; two empty sets are equal."""
    return 9 * len(np.intersect1d(a, b, assume_unique=True)) >= 4 * (len(a) + len(b))


def may_be_similar(n: int, words: np.ndarray, m: int, others: np.ndarray) -> bool:
    if 5 * min(n, m) < 4 * max(n, m):
        return False
    size = min(len(words), len(others))
    return 9 * int(np.bitwise_count(folded(words, size) ^ folded(others, size)).sum()) <= n + m


def _ids(docs: DataFrame) -> DataFrame:
    """``docs`` with the signed id of the shingle set in ``_lm_set``."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            got = np.fromiter((set_id(shingle_set(x)) for x in texts), np.uint64, len(texts)).view(np.int64)
            yield batch.append_column("_lm_set", pa.array(got))

    return map_batches(docs, add, StructType([*docs.schema.fields, StructField("_lm_set", LongType())]))


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [shingle_set(x) for x in batch.column(1).to_pylist()]
        bits = [parities(s) for s in sets]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0).cast(pa.int64()),
                pa.array(np.fromiter(map(set_id, sets), np.uint64, len(sets)).view(np.int64)),
                pa.array([len(s) for s in sets], pa.int32()),
                pa.array([p.tobytes() for p in bits], pa.binary()),
                pa.array([folded(p, min(len(p), BRIEF_WORDS)).tobytes() for p in bits], pa.binary()),
                pa.array([s[: len(s) // 5 + 1].view(np.int64) for s in sets], pa.list_(pa.int64())),
                pa.array(np.fromiter(map(majority, sets), np.uint64, len(sets)).view(np.int64)),
            ],
            ["doc_id", "fp", "n", "bits", "brief", "keys", "print"],
        )


def _by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (fp, print): a bucket key for the pivot coordinates of each block."""
    for batch in batches:
        fp, own = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        keys = coordinates(own.view(np.uint64)) * np.uint64(BLOCKS) + np.arange(BLOCKS, dtype=np.uint64)
        arrays = keys.reshape(-1).view(np.int64), np.repeat(fp, BLOCKS), np.repeat(own, BLOCKS)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], ["key", "fp", "print"])


def _proposed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = [], []
        for members in batch.column(0):
            fp, own = (members.values.field(c).to_numpy() for c in ("fp", "print"))
            for i, j in nearest_links(own.view(np.uint64), PRINT_BITS):
                a.append(min(fp[i], fp[j]))
                b.append(max(fp[i], fp[j]))
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def proposed_pairs(merged: DataFrame, bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """(a, b): pairs of sets whose fingerprints are near each other, by pivot tables."""
    keyed = materialize(map_batches(merged.select("fp", "print"), _by_block, "key long, fp long, print long"), "keyed", FEW_FILES)
    sizes = materialize(keyed.groupBy("key").agg(F.count("*").alias("m")).where("m > 1"), "sizes", FEW_FILES)
    part = F.expr(f"pmod(xxhash64(fp, 7), ceil(m / {bucket_limit}))").alias("part")
    buckets = keyed.join(sizes, "key").groupBy("key", part).agg(F.array_sort(F.collect_list(F.struct("fp", "print"))).alias("members"))
    pairs = materialize(map_batches(buckets.select("members"), _proposed, "a long, b long").distinct(), "proposed", FEW_FILES)
    discard(keyed, sizes)
    return pairs


def _starred(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From sorted (key, fp): each key's members with the first and the member before; keys of one member go."""
    last = head = prior = None
    for batch in batches:
        key = batch.column(0).to_numpy()
        fp = batch.column(1).to_numpy()
        if not len(key):
            continue
        before_key = np.r_[key[:1] if last is None else [last], key[:-1]]
        before_fp = np.r_[fp[:1] if last is None else [prior], fp[:-1]]
        new = key != before_key
        if last is None:
            new[0] = True
        place = np.maximum.accumulate(np.where(new, np.arange(len(key)), -1))
        heads = np.where(place >= 0, fp[np.maximum(place, 0)], 0 if head is None else head)
        keep = ~new & (fp != before_fp)
        last, head, prior = key[-1], heads[-1], fp[-1]
        yield pa.RecordBatch.from_arrays(
            [pa.array(x[keep]) for x in (key, fp, heads, before_fp)], ["key", "fp", "head", "prior"]
        )


def _filtered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, m = batch.column(2).to_numpy(), batch.column(4).to_numpy()
        x, y = batch.column(3).to_pylist(), batch.column(5).to_pylist()
        keep = [may_be_similar(int(n[i]), np.frombuffer(x[i], "<u8"), int(m[i]), np.frombuffer(y[i], "<u8")) for i in range(len(n))]
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _crossed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of different components in a key's members that pass the bounds."""
    for batch in batches:
        a, b = [], []
        for members in batch.column(0):
            rows = members.values
            n = rows.field("n").to_numpy()
            order = np.argsort(n, kind="stable")
            n, fp, label = n[order], rows.field("fp").to_numpy()[order], rows.field("label").to_numpy()[order]
            raw = rows.field("bits")
            words = [np.frombuffer(raw[int(i)].as_py(), "<u8") for i in order]
            size = np.array([len(w) for w in words])
            tables = {}
            for s in np.unique(size):
                # Sets of this width with those of the next one, folded: no other sizes can be similar.
                at = np.flatnonzero((size == s) | (size == 2 * s))
                tables[int(s)] = at, np.stack([folded(words[i], s) for i in at])
            for i in range(len(n)):
                at, table = tables[int(size[i])]
                lo, hi = np.searchsorted(at, i, "right"), np.searchsorted(n[at], 5 * int(n[i]) // 4, "right")
                own = table[lo - 1]
                found = at[lo:hi][label[at[lo:hi]] != label[i]]
                if len(found):
                    where = np.searchsorted(at, found)
                    far = np.bitwise_count(table[where] ^ own).sum(axis=1, dtype=np.int64)
                    found = found[9 * far <= n[found].astype(np.int64) + int(n[i])]
                    a.extend(np.minimum(fp[found], fp[i]).tolist())
                    b.extend(np.maximum(fp[found], fp[i]).tolist())
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _slots(fps: np.ndarray) -> np.ndarray:
    return (fps.view(np.uint64) & np.uint64(FILTER_BITS - 1)).astype(np.int64)


def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    marks = np.zeros(FILTER_BITS, np.uint8)
    for batch in batches:
        marks[_slots(batch.column(0).to_numpy())] = 1
    yield pa.RecordBatch.from_arrays([pa.array([np.packbits(marks).tobytes()], pa.binary())], ["marks"])


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x, y = batch.column(2), batch.column(3)
        keep = [
            similar(x[i].values.to_numpy().view(np.uint64), y[i].values.to_numpy().view(np.uint64)) for i in range(len(x))
        ]
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def passing(pairs: DataFrame, merged: DataFrame, bits: str) -> DataFrame:
    """The rows of ``pairs`` (a, b) of different ``print_label`` that sizes and the parities in column ``bits`` do not rule out."""
    names = {"n": "n", "bits": bits, "label": "print_label"}
    end = lambda c: merged.select(F.col("fp").alias(c), *(F.col(x).alias(f"{k}_{c}") for k, x in names.items()))
    both = pairs.join(end("a"), "a").join(end("b"), "b").where("label_a <> label_b").select("a", "b", "n_a", "bits_a", "n_b", "bits_b")
    return materialize(map_batches(both, _filtered, "a long, b long"), "passing", FEW_FILES)


def similar_pairs(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The rows of ``pairs`` (a, b), a written table, whose shingle sets are similar, by the sets themselves."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("fp")).distinct()
    marks = np.zeros(FILTER_BITS // 8, np.uint8)
    for row in map_batches(wanted.coalesce(4), _marked, "marks binary").toLocalIterator():
        marks |= np.frombuffer(row["marks"], np.uint8)
    shared = docs.sparkSession.sparkContext.broadcast(marks)

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.unpackbits(shared.value)
        for batch in batches:
            sets = [shingle_set(x) for x in batch.column(0).to_pylist()]
            fps = np.fromiter(map(set_id, sets), np.uint64, len(sets)).view(np.int64)
            at = np.flatnonzero(known[_slots(fps)])
            yield pa.RecordBatch.from_arrays(
                [pa.array(fps[at]), pa.array([sets[i].view(np.int64) for i in at], pa.list_(pa.int64()))], ["fp", "hashes"]
            )

    sets = map_batches(docs.select("text"), sets_of, "fp long, hashes array<long>").join(wanted, "fp", "left_semi")
    sets = materialize(sets.groupBy("fp").agg(F.first("hashes").alias("hashes")), "sets")
    both = pairs.join(sets.select(F.col("fp").alias("a"), F.col("hashes").alias("x")), "a").join(
        sets.select(F.col("fp").alias("b"), F.col("hashes").alias("y")), "b"
    )
    links = materialize(map_batches(both.select("a", "b", "x", "y"), _verified, "a long, b long"), "links", FEW_FILES)
    discard(sets, pairs)
    return links


def labelled(merged: DataFrame, links: DataFrame) -> DataFrame:
    """``merged`` with the ``label`` of each set's component."""
    joined = connected_components(links).select(F.col("node").alias("fp"), "label")
    return merged.join(joined, "fp", "left").withColumn("label", F.coalesce("label", "fp"))


def components(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """(fp, first_id, label): the shingle sets of ``docs``, their least ids and their components."""
    prints = materialize(
        map_batches(
            docs.select("doc_id", "text"),
            _described,
            "doc_id long, fp long, n int, bits binary, brief binary, keys array<long>, print long",
        ),
        "prints",
    )
    merged = materialize(
        prints.groupBy("fp").agg(F.min("doc_id").alias("first_id"), *(F.first(c).alias(c) for c in ("n", "bits", "brief", "print"))),
        "distinct",
        FEW_FILES,
    )
    distinct, proposed = merged, proposed_pairs(merged)
    by_print = similar_pairs(passing(proposed, merged.withColumn("print_label", F.col("fp")), "bits"), docs)
    merged = materialize(labelled(merged.drop("print"), by_print).withColumnRenamed("label", "print_label"), "joined", FEW_FILES)
    discard(distinct, proposed)
    keyed = prints.select(F.explode("keys").alias("key"), "fp").repartition("key")
    ordered = keyed.sortWithinPartitions("key", F.xxhash64("key", "fp"), "fp")
    stars = materialize(map_batches(ordered, _starred, "key long, fp long, head long, prior long"), "stars", FEW_FILES)
    discard(prints)
    tried = stars.select("fp", F.explode(F.array_distinct(F.array("head", "prior"))).alias("other"))
    tried = materialize(
        tried.select(F.least("fp", "other").alias("a"), F.greatest("fp", "other").alias("b")).distinct(), "tried", FEW_FILES
    )
    brief = passing(tried, merged, "brief")
    near = passing(brief, merged, "bits")
    discard(brief)
    links = by_print.unionByName(similar_pairs(near, docs))

    groups = materialize(labelled(merged, links), "groups", FEW_FILES)
    # A key's first member has no row of its own in ``stars``. Of up to three members all pairs have been tried.
    members = stars.select("key", "fp").unionByName(stars.select("key", F.col("head").alias("fp")).distinct())
    members = materialize(members.join(groups.select("fp", "label"), "fp"), "members", FEW_FILES)
    discard(stars, groups)
    mixed = materialize(
        members.groupBy("key")
        .agg(F.count("*").alias("m"), F.min("label").alias("low"), F.max("label").alias("high"))
        .where("m > 3 and low <> high")
        .select("key", "m", F.ceil(F.col("m") / block).cast("int").alias("blocks")),
        "mixed",
        FEW_FILES,
    )
    own = F.expr("cast(pmod(xxhash64(fp, 7), blocks) as int)")
    blocks = (
        members.join(mixed, "key")
        .withColumn("own", own)
        .select("key", "fp", "label", "m", "own", F.explode(F.expr("sequence(0, blocks - 1)")).alias("other"))
        .select("key", "fp", "label", "m", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
        .join(merged.select("fp", "n", "bits", "brief"), "fp")
        .withColumn("bits", F.when(F.col("m") <= BRIEF_MEMBERS, F.col("brief")).otherwise(F.col("bits")))
        .groupBy("key", "i", "j")
        .agg(F.collect_list(F.struct("fp", "label", "n", "bits")).alias("members"))
        .select("members")
    )
    cross = map_batches(blocks, _crossed, "a long, b long").distinct().join(tried, ["a", "b"], "left_anti")
    cross = materialize(cross, "cross", FEW_FILES)
    discard(tried, members, mixed)
    far = passing(cross, merged, "bits")
    discard(cross)
    links = links.unionByName(similar_pairs(far, docs))
    return labelled(merged.select("fp", "first_id"), links)


def keep_one_of_similar(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """The rows of ``docs`` without near duplicates: of each component the row of the least doc_id.

    Rows that repeat both doc_id and shingle set count as one document.
    """
    best = F.min(F.struct(F.col("first_id").isNull().alias("none"), "first_id", "fp")).alias("best")
    keepers = materialize(
        components(docs, block)
        .groupBy("label")
        .agg(best)
        .select(F.col("best.first_id").alias("_lm_id"), F.col("best.fp").alias("_lm_keep")),
        "keepers",
        FEW_FILES,
    )
    kept = _ids(docs).join(
        keepers, F.col("doc_id").eqNullSafe(F.col("_lm_id")) & (F.col("_lm_set") == F.col("_lm_keep")), "left_semi"
    )
    return kept.dropDuplicates(["doc_id", "_lm_set"]).select(*docs.columns)
