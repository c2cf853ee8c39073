"""Removal of repeated line runs by a suffix array over line ids (operator 8).

The corpus is one sequence of non-blank lines, in order of doc_id, that no run crosses a
document's border in. Only lines that occur at least twice can be part of a repeated run;
they get consecutive ordinals and the id of their text, and stretches of them are the
strings whose suffixes are sorted.

A run counts when its lines have at least ``MIN_CHARS`` characters together. Every line of
a repeated run lies in a shortest block that counts, extended from its first or from its
last line, and every such block inside a repeated run is repeated too: the union of those
blocks is the maximal repeated run. So prefixes longer than the longest such block (at
most ``MIN_CHARS`` lines) decide nothing, and the suffixes are sorted up to that depth.

Prefix doubling ranks the first 2^k lines of each suffix: the rank of 2^(k+1) lines is the
place of the pair (rank, rank 2^k lines on) among the sorted distinct pairs; the end of a
stretch comes first. Sorting by rank gives the suffix array. The longest common prefix of
neighbours is found downwards through the levels: it grows by 2^k where both go on with
equal ranks. A block of m lines belongs to the interval of the array that a common prefix
below m opens and the next one below m closes. In each interval the first place in
the corpus stays and the lines of all later ones are deleted. Lines in no block of several
lines need their first id only, and only the others are doubled.

Defined results: null text stays null and has no lines; blank lines stay, but a text that
keeps no other line becomes empty; rows that repeat both doc_id and text count as one
document and get the same result; a null doc_id sorts first; an empty table gives an
empty result; other columns pass through. Only DataFrame operations are used. Copies of
one line, or pair of ranks, are combined before the shuffle. The combined table is written
before it is joined back: both sides of that join are then plain exchanges, whose hot
partitions Spark splits, so a hot line is never gathered in one task. Places in the array are
all distinct, so its ranges are even whatever the lines are; what passes from one range to the
next is one row a range.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from leafmill.llm._common import BLANKS, FEW_FILES, discard, let, materialize, read_table

MIN_CHARS = 40


def _not_blank(x):
    return F.btrim(x, F.lit(BLANKS)) != ""


def _lines(docs: DataFrame) -> DataFrame:
    """One row for each non-blank line: its document, place, and 128 bits of hash."""
    numbered = let(
        F.split("text", "\n"),
        lambda x: F.filter(
            F.transform(x, lambda line, i: F.struct(i.alias("no"), line.alias("line"))), lambda s: _not_blank(s["line"])
        ),
    )
    return (
        docs.where("text is not null")
        .select("doc_id", F.xxhash64("text").alias("h"), F.posexplode(numbered).alias("k", "s"))
        .select(
            "doc_id",
            "h",
            "k",
            "s.no",
            F.length("s.line").alias("chars"),
            F.xxhash64("s.line").alias("x"),
            F.xxhash64(F.lit(7), "s.line").alias("y"),
        )
    )


def _repeated(docs: DataFrame) -> DataFrame:
    """Lines that occur at least twice: doc_id, h, k, no, chars, id (of the line), ord (ascending in the corpus)."""
    lines = materialize(_lines(docs), "lines")
    often = lines.groupBy("x", "y").agg(F.count("*").alias("n")).where("n > 1").select("x", "y")
    often = materialize(often.withColumn("id", F.monotonically_increasing_id()), "often", FEW_FILES)
    live = lines.join(often, ["x", "y"]).drop("x", "y").dropDuplicates(["doc_id", "h", "k"])
    placed = (
        live.repartitionByRange("doc_id", "h")
        .sortWithinPartitions("doc_id", "h", "k")
        .withColumn("ord", F.monotonically_increasing_id())
    )
    placed = materialize(placed, "placed", FEW_FILES)
    discard(lines, often)
    return placed


def _shaped(rows: DataFrame, min_chars: int) -> DataFrame:
    """``rows`` with ``left``, the lines from each to the end of its stretch, and the lengths of the
    shortest blocks that count from it on (``ahead``) and back from it (``behind``), or null."""
    stretch = Window.partitionBy("doc_id", "h", F.col("ord") - F.col("k")).orderBy("ord")

    def shortest(chars):
        """Entries of ``chars`` until their sum is enough; null where it never is."""
        done = F.aggregate(
            chars,
            F.struct(F.lit(0).alias("sum"), F.lit(0).alias("m")),
            lambda a, c: F.when(a["sum"] >= min_chars, a).otherwise(
                F.struct((a["sum"] + c).alias("sum"), (a["m"] + 1).alias("m"))
            ),
        )
        return F.when(done["sum"] >= min_chars, done["m"])

    whole = stretch.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return rows.select(
        *("doc_id", "h", "no", "ord", "id"),
        (F.max("ord").over(whole) - F.col("ord") + 1).alias("left"),
        F.collect_list("chars").over(stretch.rowsBetween(0, min_chars - 1)).alias("ahead"),
        F.collect_list("chars").over(stretch.rowsBetween(1 - min_chars, 0)).alias("behind"),
    ).withColumns({"ahead": shortest(F.col("ahead")), "behind": shortest(F.reverse("behind"))})


def _in_order(df: DataFrame, keys: list[str], place: str) -> DataFrame:
    """``df`` sorted by ``keys`` over ranges, with ascending numbers ``place`` and the number ``part`` of the range."""
    placed = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    return placed.withColumn(place, F.monotonically_increasing_id()).withColumn("part", F.spark_partition_id())


def _doubled(level: DataFrame, k: int) -> DataFrame:
    """(ord, rank, left) with ranks of 2^(k+1) lines, from those of 2^k lines."""
    half = 1 << k
    ahead = level.select((F.col("ord") - half).alias("ord"), F.col("rank").alias("next"))
    follows = F.when(F.col("left") > half, F.coalesce("next", F.lit(-1))).otherwise(F.lit(-1))
    pairs = materialize(level.join(ahead, "ord", "left").withColumn("next", follows), f"pairs{k}", FEW_FILES)
    ranks = _in_order(pairs.select("rank", "next").distinct(), ["rank", "next"], "place").drop("part")
    ranks = materialize(ranks, f"ranks{k}", FEW_FILES)
    done = pairs.join(ranks, ["rank", "next"]).select("ord", F.col("place").alias("rank"), "left")
    done = materialize(done, f"level{k + 1}", FEW_FILES)
    discard(pairs, ranks)
    return done


def _with_previous(array: DataFrame) -> DataFrame:
    """``array`` with ``prev``: (ord, id, left) of the suffix before, across ranges too."""
    entry = F.struct("ord", "id", "left")
    ends = array.join(F.broadcast(array.groupBy("part").agg(F.max("pos").alias("pos"))), ["part", "pos"], "left_semi")
    carried = ends.select("part", F.lag(entry).over(Window.orderBy("part")).alias("carried"))
    before = F.lag(entry).over(Window.partitionBy("part").orderBy("pos"))
    return (
        array.withColumn("prev", before)
        .join(F.broadcast(carried), "part")
        .select("pos", "ord", "id", F.coalesce("prev", "carried").alias("prev"))
    )


def _common_prefixes(array: DataFrame, levels: list[DataFrame], deep: DataFrame) -> DataFrame:
    """(ord, lcp): lines that a suffix and the one before it share, exact up to ``deep`` lines.

    Only for suffixes in ``deep`` (ord, deep) that share their first line with the one before.
    """
    found = array.where("id = prev.id").join(deep, "ord").select("ord", "prev", "deep", F.lit(1).alias("lcp"))
    for k in reversed(range(len(levels))):
        here, there = (
            levels[k].select(F.col("ord").alias(f"{x}_at"), F.col("rank").alias(f"{x}_rank")) for x in ("here", "there")
        )
        goes_on = (F.col("here_rank") == F.col("there_rank")) & (F.col("lcp") < F.least("deep", "prev.left"))
        found = (
            found.join(here, F.col("here_at") == F.col("ord") + F.col("lcp"), "left")
            .join(there, F.col("there_at") == F.col("prev.ord") + F.col("lcp"), "left")
            .select("ord", "prev", "deep", F.when(goes_on, F.col("lcp") + (1 << k)).otherwise(F.col("lcp")).alias("lcp"))
        )
    return found.select("ord", "lcp")


def _intervals(blocks: DataFrame) -> DataFrame:
    """(ord, m, interval) of blocks (ord, m, pos, lcp): equal numbers for blocks with equal lines."""
    sorted_ = _in_order(blocks.withColumn("opens", F.col("lcp") < F.col("m")), ["m", "pos"], "at")
    sorted_ = materialize(sorted_.select("ord", "m", "opens", "at", "part"), "sorted", FEW_FILES)
    opened = F.when(F.col("opens"), F.col("at"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        sorted_.groupBy("part").agg(F.max(opened).alias("last")).select("part", F.max("last").over(earlier).alias("carried"))
    )
    so_far = Window.partitionBy("part").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    done = (
        sorted_.withColumn("open", F.max(opened).over(so_far))
        .join(F.broadcast(carried), "part")
        .select("ord", "m", F.coalesce("open", "carried").alias("interval"))
    )
    done = materialize(done, "intervals", FEW_FILES)
    discard(sorted_)
    return done


def deleted_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, h, dead): line numbers that are later copies, by document (h: hash of its text)."""
    placed = _repeated(docs)
    rows = materialize(_shaped(placed, min_chars), "shaped", FEW_FILES)
    discard(placed)
    blocks = rows.where("ahead is not null").select("ord", F.col("ahead").alias("m"))
    back = rows.where("behind > 1").select((F.col("ord") - F.col("behind") + 1).alias("ord"), F.col("behind").alias("m"))
    blocks = blocks.unionByName(back)
    longer = blocks.where("m > 1")
    longest = longer.agg(F.max("m")).first()[0] or 1

    covered = longer.select(F.explode(F.expr("sequence(ord, ord + m - 1)")).alias("ord")).distinct()
    first = rows.select("ord", F.col("id").alias("rank"), "left").join(covered, "ord", "left_semi")
    levels = [materialize(first, "level0", FEW_FILES)]
    for k in range((longest - 1).bit_length()):
        levels.append(_doubled(levels[k], k))
    ranks = levels[-1].select("ord", "rank")
    array = _in_order(rows.select("ord", "id", "left").join(ranks, "ord", "left"), ["id", "rank", "ord"], "pos")
    array = materialize(array.drop("rank"), "array", FEW_FILES)
    linked = materialize(_with_previous(array), "linked", FEW_FILES)

    deep = longer.groupBy("ord").agg(F.max("m").alias("deep"))
    prefixes = materialize(_common_prefixes(linked, levels[:-1], deep), "prefixes", FEW_FILES)
    lcp = F.coalesce("lcp", F.when(F.col("id") == F.col("prev.id"), 1).otherwise(0))
    known = linked.join(prefixes, "ord", "left").select("ord", "pos", lcp.alias("lcp"))
    found = _intervals(blocks.join(known, "ord"))
    discard(*levels, array, linked, prefixes)

    kept = found.groupBy("interval").agg(F.min("ord").alias("kept"), F.count("*").alias("n")).where("n > 1").drop("n")
    kept = materialize(kept, "kept", FEW_FILES)
    later = found.join(kept, "interval").where("ord > kept")
    dead = later.select(F.explode(F.expr("sequence(ord, ord + m - 1)")).alias("ord")).distinct()
    dead = rows.join(dead, "ord", "left_semi").groupBy("doc_id", "h").agg(F.collect_list("no").alias("dead"))
    dead = materialize(dead, "dead", FEW_FILES)
    discard(rows, found, kept)
    return dead


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """``docs`` with later copies of repeated line runs deleted from ``text``.

    Adds ``_lm_lines`` (non-blank lines before) and ``_lm_deleted`` (of those).
    """
    dead = deleted_lines(docs, min_chars).select(
        F.col("doc_id").alias("_lm_id"), F.col("h").alias("_lm_h"), F.col("dead").alias("_lm_dead")
    )
    joined = docs.join(
        dead,
        F.col("doc_id").eqNullSafe(F.col("_lm_id")) & (F.xxhash64("text") == F.col("_lm_h")),
        "left",
    )
    rest = let(
        F.split("text", "\n"),
        lambda x: F.transform(
            F.array_except(F.sequence(F.lit(0), F.size(x) - 1), F.col("_lm_dead")), lambda i: F.get(x, i)
        ),
    )
    text = let(rest, lambda x: F.when(F.exists(x, _not_blank), F.array_join(x, "\n")).otherwise(""))
    n_lines = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), _not_blank))
    return (
        joined.withColumn("_lm_lines", n_lines.cast("long"))
        .withColumn("_lm_deleted", F.coalesce(F.size("_lm_dead"), F.lit(0)).cast("long"))
        .withColumn("text", F.when(F.col("_lm_dead").isNull(), F.col("text")).otherwise(text))
        .drop("_lm_id", "_lm_h", "_lm_dead")
    )


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(read_table(spark, sf_dir, "documents")).select(
        "doc_id", "text", F.col("_lm_lines").alias("n_lines"), F.col("_lm_deleted").alias("n_deleted")
    )
