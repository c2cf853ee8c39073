"""Shared helpers: durable intermediate tables, text expressions, table access."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from leafmill.storage import discard, materialize, new_dir, read_table, shared_dir, write_table

__all__ = ["discard", "materialize", "new_dir", "read_table", "shared_dir", "write_table"]

#: Space, tab, line feed, vertical tab, form feed, carriage return.
BLANKS = " \t\n\x0b\x0c\r"
BLANK_RUN = "[\\x20\\x09-\\x0D]+"

#: Texts have no greatest length, so what one Arrow batch can hold is bounded by rows.
BATCH_ROWS = 1000

#: Files for each core of tables that hold groups, keys or links and no texts.
FEW_FILES = 2


def small_batches(spark: SparkSession) -> None:
    """Let Arrow batches of this session hold at most ``BATCH_ROWS`` rows."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def tidy() -> None:
    """Give memory that a worker no longer uses back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def map_batches(
    df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType
) -> DataFrame:
    """``mapInArrow`` in small batches, whose workers are left tidy."""

    def tidily(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            tidy()

    small_batches(df.sparkSession)
    return df.mapInArrow(tidily, schema)


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body`` as a lambda variable."""
    return F.transform(F.array(value), body)[0]


def text_of(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def words_of(text: Column) -> Column:
    """Maximal runs of characters that are none of ``BLANKS``."""
    return F.filter(F.split(text, BLANK_RUN), lambda w: w != "")


def count_chars(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))
