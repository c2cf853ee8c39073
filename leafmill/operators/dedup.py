"""First-wins, hash and linked-key removal of duplicates."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from leafmill.operators.graph import connected_components
from leafmill.storage import discard, materialize


def first_wins(df: DataFrame, key: Column | list[Column], ord_col: str) -> DataFrame:
    """Of rows with equal keys the one with the least ``ord_col``.

    One scan; rows are combined in each task before the shuffle, which has one for each key and task.
    """
    keys = key if isinstance(key, list) else [key]
    row = F.struct(*df.columns)
    best = df.groupBy(*(k.alias(f"_k{i}") for i, k in enumerate(keys))).agg(F.min_by(row, ord_col).alias("_row"))
    return best.select("_row.*")


def array_key(ids: Column) -> Column:
    """The key of a combination of ids: sorted, repeats kept."""
    return F.array_sort(ids)


def content_representatives(df: DataFrame, text: str, ord_col: str) -> DataFrame:
    """(content_key, ord, copies): one representative for each distinct content."""
    return (
        df.select(F.md5(F.coalesce(F.col(text), F.lit(""))).alias("content_key"), ord_col)
        .groupBy("content_key")
        .agg(F.min(ord_col).alias(ord_col), F.count("*").alias("copies"))
    )


def fan_back(df: DataFrame, results: DataFrame, text: str) -> DataFrame:
    """Join what was computed once for each distinct content back to every row that has it."""
    return df.withColumn("content_key", F.md5(F.coalesce(F.col(text), F.lit("")))).join(results, "content_key", "left")


#: Rounds of minima before what is left is parted into components, and the rows of a component that one task takes.
ROUNDS, LOCAL_ROWS = 8, 200_000


def url_or_content(df: DataFrame, url: str, content: str, ord_col: str, local_rows: int = LOCAL_ROWS) -> DataFrame:
    """Greedy first-wins where a row goes if its url OR its content was seen in a row that stayed.

    Rounds: rows that are first of both their groups stay, their neighbours go, the rest
    meets again. A chain of rows would need a round for every second of them, so after ``ROUNDS`` rounds
    the rows left are parted into connected components, in rounds that grow with the logarithm of a chain; a
    component of at most ``local_rows`` rows is then settled in order by one task. Larger ones go on in rounds. Null keys match nothing.
    """
    open_rows = materialize(df.select(F.col(ord_col).alias("o"), F.col(url).alias("u"), F.col(content).alias("c")), "open")
    kept: list[DataFrame] = []
    number = 0
    while not open_rows.isEmpty():
        number += 1
        if number % (ROUNDS + 1) == 0:
            stays, left = _settled(open_rows, local_rows)
        else:
            stays, left = _round(open_rows)
        kept.append(stays.select("o"))
        discard(open_rows)
        open_rows = left
    if not kept:
        return df.limit(0)
    return df.join(reduce(DataFrame.unionByName, kept).select(F.col("o").alias(ord_col)), ord_col, "left_semi")


def _round(open_rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows that are first of both their groups, rows that are neither these nor their neighbours)."""
    # Written before they are joined back: both sides of a join are then plain exchanges, whose hot keys Spark splits.
    by_u = materialize(open_rows.where("u is not null").groupBy("u").agg(F.min("o").alias("mu")), "by_u")
    by_c = materialize(open_rows.where("c is not null").groupBy("c").agg(F.min("o").alias("mc")), "by_c")
    first = open_rows.join(by_u, "u", "left").join(by_c, "c", "left").where("coalesce(mu, o) = o and coalesce(mc, o) = o")
    winners = materialize(first.select("o", "u", "c"), "winners")
    left = (
        open_rows.join(winners.select("o"), "o", "left_anti")
        .join(winners.select("u").distinct(), "u", "left_anti")
        .join(winners.select("c").distinct(), "c", "left_anti")
    )
    left = materialize(left, "open")
    discard(by_u, by_c)
    return winners, left


def _settled(open_rows: DataFrame, local_rows: int) -> tuple[DataFrame, DataFrame]:
    """(rows that stay of the components of at most ``local_rows`` rows, all rows of the larger ones)."""
    ends = open_rows.select("o", F.xxhash64(F.lit("u"), "u").alias("a"), F.xxhash64(F.lit("c"), "c").alias("b"), "u", "c")
    ends = materialize(ends, "ends")
    labels = connected_components(ends.where("u is not null and c is not null").select("a", "b"))
    # Keys whose hashes meet only make a component larger.
    at = F.when(F.col("u").isNotNull(), F.col("a")).otherwise(F.col("b"))
    placed = ends.withColumn("node", at).join(labels, "node", "left").select("o", "u", "c", F.coalesce("label", "node").alias("label"))
    placed = materialize(placed, "placed")
    sizes = placed.groupBy("label").agg(F.count("*").alias("n"))
    sized = materialize(sizes, "sizes")
    small = placed.join(sized.where(F.col("n") <= local_rows).select("label"), "label", "left_semi")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        label, seen_u, seen_c = None, set(), set()
        for batch in batches:
            stays = []
            for of, u, c in zip(*(batch[name].to_pylist() for name in ("label", "u", "c")), strict=True):
                if of != label:
                    label, seen_u, seen_c = of, set(), set()
                stays.append((u is None or u not in seen_u) and (c is None or c not in seen_c))
                if stays[-1]:
                    seen_u.add(u)
                    seen_c.add(c)
            yield batch.select(["o"]).filter(pa.array(stays, pa.bool_()))

    sorted_rows = small.repartition("label").sortWithinPartitions("label", "o")
    stays = materialize(sorted_rows.mapInArrow(fold, StructType([open_rows.schema["o"]])), "settled")
    large = placed.join(sized.where(F.col("n") > local_rows).select("label"), "label", "left_semi").select("o", "u", "c")
    left = materialize(large, "open")
    discard(ends, placed, sized)
    return stays, left


def block_stats(pieces: DataFrame, item: str = "doc_id", text: str = "piece", split: str = "split") -> DataFrame:
    """One row of what asking once for each distinct text saves, from the pieces of items.

    ``split`` tells the blocks of long items from contents that stay whole. Columns: items,
    long_items, blocks, average_blocks (of long items), unique_contents, unique_blocks,
    unique_calls, and saved, the share in per cent of the calls for each item.
    """
    whole, long = F.when(~F.col(split), F.md5(text)), F.when(F.col(split), F.md5(text))
    told = pieces.agg(
        F.count_distinct(item).alias("items"),
        F.count_distinct(F.when(F.col(split), F.col(item))).alias("long_items"),
        F.count_if(split).alias("blocks"),
        F.count_distinct(whole).alias("unique_contents"),
        F.count_distinct(long).alias("unique_blocks"),
    )
    calls = F.col("unique_contents") + F.col("unique_blocks")
    return told.select(
        "items",
        "long_items",
        "blocks",
        F.round(F.coalesce(F.try_divide("blocks", "long_items"), F.lit(0.0)), 1).alias("average_blocks"),
        "unique_contents",
        "unique_blocks",
        calls.alias("unique_calls"),
        F.round(F.coalesce(F.try_divide((F.col("items") - calls) * 100.0, F.col("items")), F.lit(0.0)), 6).alias("saved"),
    )


def repeated_keys(df: DataFrame, key: str) -> DataFrame:
    """(key, n) of keys that occur more than once."""
    return df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def natural_chunk_order(df: DataFrame, chunk_id: str = "chunk_id") -> DataFrame:
    """Rows with ``doc_no`` and ``chunk_no`` of chunk ids '<doc>-<n>' and ``pos``, the chunk's place in its document.

    Ordering by (doc_no, chunk_no, id) is the natural order; other ids have null numbers.
    """
    part = lambda k: F.expr(f"try_cast(regexp_extract({chunk_id}, '^([0-9]+)-([0-9]+)$', {k}) as bigint)")
    typed = df.withColumn("doc_no", part(1)).withColumn("chunk_no", part(2))
    own = Window.partitionBy("doc_no", F.when(F.col("doc_no").isNull(), F.col(chunk_id))).orderBy("chunk_no", chunk_id)
    return typed.withColumn("pos", F.row_number().over(own).cast("long"))
