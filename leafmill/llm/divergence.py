"""Divergence of sources by dense term blocks (operator 13).

Each language's terms that are in enough of its documents are dealt into blocks by hash. For a
block, the counts of all sources are laid out as a dense int64 matrix of sources by terms, turned
into shares, and all pairs of its rows are compared at once by numpy broadcasting, a slab of rows
at a time; zeros count like any other value. A block gives one partial matrix of pairs, which are
summed, and for each source the ``TOP_TERMS`` terms that stand out most in it, of which the
greatest of all blocks are kept. Sources beyond ``TILE`` are cut into tiles: a block then meets
every pair of tiles. So a task holds one block of one pair of tiles, whatever the corpus.

Occurrences are counted inside each task before any shuffle, so that a frequent term or a large
source is a few rows a task. Shares are integers, and are computed exactly at any count
below 9e15 without wider numbers.

Defined results: null text, lang and source are ''; repeated rows are documents each; a document
without terms still makes its group; a language without kept terms has pairs of value 0; a source
alone in its language has no pairs; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafmill.llm._common import FEW_FILES, map_batches, materialize, read_table

MIN_DOCS = 3
TOP_TERMS = 200
SCALE_STEPS = 3  # a share is in units of 1000 ** -SCALE_STEPS
#: Sources in a tile and terms in a block.
TILE, BLOCK = 256, 2048
#: Cells that are compared at once.
SLAB = 1 << 21
#: Distinct (group, term) entries that a task holds before it hands them on.
HELD = 400_000

_TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def terms_of(text: str) -> list[str]:
    """Runs of letters, A-Z in lower case, of which nothing else is changed."""
    return _TERM.findall(text.encode().lower().decode())


def term_counts(docs: DataFrame, held: int = HELD) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents, with one row of term null for each group."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def taken() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, in_docs) in groups.items():
                terms = [None, *n]
                rows = len(terms)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([lang] * rows, pa.string()),
                        pa.array([source] * rows, pa.string()),
                        pa.array(terms, pa.string()),
                        pa.array([0, *n.values()], pa.int64()),
                        pa.array([0, *(in_docs[t] for t in n)], pa.int64()),
                    ],
                    ["lang", "source", "term", "n", "docs"],
                )
            groups.clear()

        entries = 0
        for batch in batches:
            for lang, source, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                n, in_docs = groups.setdefault((lang, source), (Counter(), Counter()))
                here = Counter(terms_of(text))
                entries -= len(n)
                n.update(here)
                in_docs.update(here.keys())
                entries += len(n)
                if entries > held:
                    yield from taken()
                    entries = 0
        yield from taken()

    rows = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    counted = map_batches(rows, count, "lang string, source string, term string, n long, docs long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def shares(counts: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(1000 ** SCALE_STEPS * (counts + 1) / total), exact, by long division in base 1000."""
    rest, share = counts + 1, np.zeros(np.broadcast(counts, total).shape, np.int64)
    for _ in range(SCALE_STEPS):
        rest = rest * 1000
        digit = rest // total
        rest = rest - digit * total
        share = share * 1000 + digit
    return share + 1


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def pair_sums(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The divergence of every row of ``p`` from every row of ``q``, summed over their columns."""
    out = np.empty((len(p), len(q)), np.int64)
    step = max(1, SLAB // max(1, q.size))
    for a in range(0, len(p), step):
        out[a : a + step] = divergence(p[a : a + step, None, :], q[None, :, :]).sum(axis=2)
    return out


def greatest(values: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` greatest values, the earlier of equal ones first."""
    if len(values) > k:
        least = np.partition(values, len(values) - k)[len(values) - k]
        above = np.flatnonzero(values > least)
        chosen = np.sort(np.concatenate([above, np.flatnonzero(values == least)[: k - len(above)]]))
    else:
        chosen = np.arange(len(values))
    return chosen[np.argsort(-values[chosen], kind="stable")]


_PART = "lang string, place int, other int, term string, value long"


def block_parts(terms: pa.Table, groups: pa.Table, i: int, j: int) -> Iterator[tuple[int, int | None, str | None, int]]:
    """(source's place, other's place, term, value) of one block and one pair of tiles.

    ``terms`` has term, total (in the language), places and counts; ``groups`` has place, n, kept, lang_n.
    """
    order = np.argsort(np.array([t.encode() for t in terms["term"].to_pylist()], object), kind="stable")
    terms = terms.take(pa.array(order))
    lists = terms["places"].combine_chunks()
    column = np.repeat(np.arange(len(terms)), np.diff(lists.offsets.to_numpy()))
    row, n = lists.flatten().to_numpy(), terms["counts"].combine_chunks().flatten().to_numpy()
    of = {name: groups[name].to_numpy() for name in ("place", "n", "kept", "lang_n")}

    def dense(tile: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of a tile's sources, their counts and their shares."""
        mine = np.flatnonzero(of["place"] // TILE == tile)
        mine = mine[np.argsort(of["place"][mine])]
        counts = np.zeros((len(mine), len(terms)), np.int64)
        here = row // TILE == tile
        counts[row[here] % TILE, column[here]] = n[here]
        return of["place"][mine], counts, shares(counts, (of["n"] + of["kept"])[mine, None])

    places, counts, p = dense(i)
    others, _, q = (places, counts, p) if i == j else dense(j)
    sums = pair_sums(p, q)
    for a, place in enumerate(places.tolist()):
        for b, other in enumerate(others.tolist()):
            if place != other:
                yield place, other, None, int(sums[a, b])
    if j == 0 and len(places):
        common = shares(terms["total"].to_numpy(), of["lang_n"][:1] + of["kept"][:1])
        names = terms["term"].to_pylist()
        for a, place in enumerate(places.tolist()):
            able = np.flatnonzero((counts[a] > 0) & (p[a] > common))
            values = divergence(p[a, able], common[able])
            for x in greatest(values, TOP_TERMS).tolist():
                yield place, None, names[able[x]], int(values[x])


def _compare(key: tuple, terms: pa.Table, groups: pa.Table) -> pa.Table:
    lang, _, i, j = (k.as_py() for k in key)
    found = list(block_parts(terms, groups, i, j)) if len(terms) and len(groups) else []
    place, other, term, value = zip(*found, strict=True) if found else ((), (), (), ())
    return pa.Table.from_arrays(
        [
            pa.array([lang] * len(found), pa.string()),
            pa.array(place, pa.int32()),
            pa.array(other, pa.int32()),
            pa.array(term, pa.string()),
            pa.array(value, pa.int64()),
        ],
        ["lang", "place", "other", "term", "value"],
    )


def source_divergence(docs: DataFrame) -> DataFrame:
    """(lang, source, part, item, value, rank): how far sources are from each other, and which terms set them apart."""
    counts = materialize(term_counts(docs), "term_counts")
    of_lang = Window.partitionBy("lang")
    groups = counts.where("term is null").select(
        "lang",
        "source",
        (F.row_number().over(of_lang.orderBy("source")) - 1).alias("place"),
        F.count("*").over(of_lang).alias("sources"),
    )
    groups = materialize(groups, "groups", FEW_FILES)
    kept = (
        counts.where("term is not null")
        .join(groups, ["lang", "source"])
        .groupBy("lang", "term")
        .agg(F.sum("docs").alias("docs"), F.sum("n").alias("total"), F.collect_list(F.struct("place", "n")).alias("of"))
        .where(F.col("docs") >= MIN_DOCS)
        .select("lang", "term", "total", F.col("of.place").alias("places"), F.col("of.n").alias("counts"))
    )
    kept = materialize(kept, "kept_terms")
    langs = kept.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("total").alias("lang_n"))
    sizes = (
        kept.select("lang", F.explode(F.arrays_zip("places", "counts")).alias("x"))
        .groupBy("lang", F.col("x.places").alias("place"))
        .agg(F.sum("x.counts").alias("n"))
    )
    groups = materialize(
        groups.join(sizes, ["lang", "place"], "left")
        .join(langs, "lang", "left")
        .na.fill(0, ["n", "kept", "lang_n"])
        .withColumn("blocks", F.ceil(F.col("kept") / BLOCK).cast("int")),
        "sized_groups",
        FEW_FILES,
    )

    def tiles(df: DataFrame) -> DataFrame:
        """Every pair of tiles (i, j) for each row."""
        each = F.sequence(F.lit(0), F.expr(f"cast((sources - 1) div {TILE} as int)"))
        return df.withColumn("i", F.explode(each)).withColumn("j", F.explode(each))

    by_lang = groups.where("kept > 0").groupBy("lang").agg(F.max("blocks").alias("blocks"), F.max("sources").alias("sources"))
    left = tiles(kept.join(by_lang, "lang").withColumn("block", F.expr("cast(pmod(xxhash64(term), blocks) as int)")))
    right = tiles(groups.where("kept > 0").withColumn("block", F.explode(F.expr("sequence(0, blocks - 1)"))))
    right = right.where(f"place div {TILE} in (i, j)")
    key = ["lang", "block", "i", "j"]
    parts = (
        left.select(*key, "term", "total", "places", "counts")
        .groupBy(*key)
        .cogroup(right.select(*key, "place", "n", "kept", "lang_n").groupBy(*key))
        .applyInArrow(_compare, _PART)
    )
    parts = materialize(parts, "parts")
    name = groups.select("lang", "place", "source")
    pairs = (
        parts.where("other is not null")
        .groupBy("lang", "place", "other")
        .agg(F.sum("value").alias("value"))
        .join(name, ["lang", "place"])
        .join(name.toDF("lang", "other", "item"), ["lang", "other"])
        .select("lang", "source", "item", "value")
    )
    bare = groups.where("kept = 0").select("lang", "source")
    bare = bare.join(bare.toDF("lang", "item"), "lang").where("source <> item").withColumn("value", F.lit(0).cast("long"))
    terms = parts.where("term is not null").join(name, ["lang", "place"]).select("lang", "source", F.col("term").alias("item"), "value")

    def ranked(df: DataFrame, part: str) -> DataFrame:
        best_first = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
        return df.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(best_first).alias("rank"))

    return ranked(pairs.unionByName(bare), "pair").unionByName(ranked(terms, "term").where(F.col("rank") <= TOP_TERMS))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(read_table(spark, sf_dir, "documents"))
