"""Budgeted prefixes and ordered folds over the items of a group.

Prefixes and fixed batches are running sums over ranges of rows. Folds whose state depends on earlier
decisions stream the sorted rows of each group through an Arrow function; what they decide of one row depends on all
before it, so a group is one task's, which holds one row of it at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType
from pyspark.sql.window import Window

from leafmill.operators.dedup import first_wins
from leafmill.storage import materialize


def running_sums(df: DataFrame, group: list[str], ord_col: str, cost: str | None, name: str) -> DataFrame:
    """``df`` with ``name``: the sum of ``cost`` (None: of ones) over a group's rows up to and with this one; null costs count nothing.

    Rows are sorted in ranges of the group and ``ord_col`` and written; sums inside a range come from a window, and
    what the ranges before it have of a group is added: a large group is several tasks'. ``ord_col`` tells a group's rows apart.
    """
    dealt = df.repartitionByRange(*group, ord_col).withColumn("_range", F.spark_partition_id())
    dealt = materialize(dealt, "ranges")
    value = F.lit(1).cast("long") if cost is None else F.coalesce(cost, F.lit(0))
    inside = Window.partitionBy("_range", *group).orderBy(ord_col).rowsBetween(Window.unboundedPreceding, 0)
    parts = dealt.groupBy("_range", *group).agg(F.sum(value).alias("_sum"))
    before = F.sum("_sum").over(Window.partitionBy(*group).orderBy("_range")) - F.col("_sum")
    names = [f"_g{i}" for i in range(len(group))]
    parts = parts.withColumn("_before", before).select(F.col("_range").alias("_r"), *(F.col(g).alias(n) for g, n in zip(group, names, strict=True)), "_before")
    same = F.col("_range") == F.col("_r")
    for g, n in zip(group, names, strict=True):
        same = same & F.col(g).eqNullSafe(F.col(n))
    summed = dealt.withColumn(name, F.sum(value).over(inside)).join(parts, same)
    return summed.withColumn(name, F.col(name) + F.col("_before")).drop("_range", "_r", "_before", *names)


def prefix_within(df: DataFrame, group: list[str], ord_col: str, cost: str, budget: int, base: int = 0) -> DataFrame:
    """Items until the first that overflows: base + running sum of (non-negative) costs stays within the budget."""
    summed = running_sums(df, group, ord_col, cost, "running")
    return summed.withColumn("running", base + F.col("running")).where(F.col("running") <= budget)


def suffix_within(df: DataFrame, group: list[str], ord_col: str, cost: str, budget: int, last: int = 10) -> DataFrame:
    """Of the ``last`` items, from the newest back until the first overflow."""
    newest = Window.partitionBy(*group).orderBy(F.desc(ord_col))
    return (
        df.withColumn("back", F.row_number().over(newest))
        .where(F.col("back") <= last)
        .withColumn("running", F.sum(cost).over(newest.rowsBetween(Window.unboundedPreceding, 0)))
        .where(F.col("running") <= budget)
    )


def fixed_batches(df: DataFrame, group: list[str], ord_col: str, size: int) -> DataFrame:
    """``batch``: 0 for the first ``size`` items, 1 for the next, and so on."""
    numbered = running_sums(df, group, ord_col, None, "batch")
    return numbered.withColumn("batch", F.floor((F.col("batch") - 1) / size).cast("int"))


def _streamed(df: DataFrame, group: list[str], ord_col: str, cost: str, begin: Callable, kind: pa.DataType, name: str) -> DataFrame:
    """``df`` with ``name``: what the fold says of each item, in the order of its group.

    ``begin()`` gives a group's step function, from a cost to a mark. Groups are dealt by
    key and sorted, and each task reads its rows once, batch by batch, with the state of
    one group: neither memory nor time depends on how large a group is.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, step = None, None
        for batch in batches:
            marks = []
            keys = zip(*(batch.column(batch.schema.get_field_index(g)).to_pylist() for g in group), strict=True)
            for key, c in zip(keys, batch.column(batch.schema.get_field_index(cost)).to_pylist(), strict=True):
                if step is None or key != last:
                    last, step = key, begin()
                marks.append(step(c or 0))
            yield batch.append_column(name, pa.array(marks, kind))

    schema = StructType([*df.schema.fields, StructField(name, LongType() if kind == pa.int64() else BooleanType())])
    return df.repartition(*group).sortWithinPartitions(*group, ord_col).mapInArrow(run, schema)


def greedy_batches(df: DataFrame, group: list[str], ord_col: str, cost: str, limit: int) -> DataFrame:
    """``batch`` from 0: items join the open batch while they fit; one above the limit has a batch of its own."""

    def begin():
        batch = n = used = 0

        def step(c: int) -> int:
            nonlocal batch, n, used
            if c > limit:
                own = batch + (n > 0)
                batch, n, used = own + 1, 0, 0
                return own
            if n and used + c > limit:
                batch, n, used = batch + 1, 0, 0
            n, used = n + 1, used + c
            return batch

        return step

    return _streamed(df, group, ord_col, cost, begin, pa.int64(), "batch")


def greedy_batches_base(df: DataFrame, group: list[str], ord_col: str, cost: str, limit: int, base: int) -> DataFrame:
    """Like ``greedy_batches``; every batch starts at cost ``base``, and an oversized item joins an empty batch."""

    def begin():
        batch, n, used = 0, 0, base

        def step(c: int) -> int:
            nonlocal batch, n, used
            if n and used + c > limit:
                batch, n, used = batch + 1, 0, base
            n, used = n + 1, used + c
            return batch

        return step

    return _streamed(df, group, ord_col, cost, begin, pa.int64(), "batch")


def fill_skipping(df: DataFrame, group: list[str], ord_col: str, cost: str, budget: int, id_col: str | None = None) -> DataFrame:
    """Items that still fit when they come up; one that does not is skipped and the next tried.

    With ``id_col``, an id counts once in each group: rows of one id are alike, and as what is
    used only grows, one that did not fit never fits later, so only the first of them is tried.
    """
    if id_col:
        df = first_wins(df, [*(F.col(c) for c in group), F.col(id_col)], ord_col)

    def begin():
        used = 0

        def step(c: int) -> bool:
            nonlocal used
            fits = used + c <= budget
            used += c if fits else 0
            return fits

        return step

    return _streamed(df, group, ord_col, cost, begin, pa.bool_(), "_fits").where("_fits").drop("_fits")


def fill_between(chunks: DataFrame, referenced: DataFrame) -> DataFrame:
    """Every chunk between a document's least and greatest referenced chunk_no, where it has two at least."""
    span = (
        referenced.groupBy("doc_id")
        .agg(F.min("chunk_no").alias("low"), F.max("chunk_no").alias("high"), F.count("*").alias("refs"))
        .where("refs >= 2")
    )
    return chunks.join(span, "doc_id").where("chunk_no between low and high").drop("low", "high", "refs")


def feedback_batches(df: DataFrame, group: list[str], ord_col: str, cost: str, budget: int, grow: Callable[[list[int], int], int]) -> DataFrame:
    """``batch``: items join the open batch while they fit into what the text generated so far leaves of the budget.

    ``grow(costs of a batch, generated so far)`` gives the length generated from a batch.
    """

    def begin():
        batch = used = generated = 0
        open_costs: list[int] = []

        def step(c: int) -> int:
            nonlocal batch, used, generated
            if open_costs and used + c > budget - generated:
                generated += grow(open_costs, generated)
                batch, used = batch + 1, 0
                open_costs.clear()
            used += c
            open_costs.append(c)
            return batch

        return step

    return _streamed(df, group, ord_col, cost, begin, pa.int64(), "batch")
