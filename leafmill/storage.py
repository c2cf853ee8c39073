"""Durable intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StringType, StructField, StructType

_own_dir: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session.

    Where a session on one machine names none (tests), a temporary folder is made once per
    process, set as checkpoint folder and removed at exit; a session on a cluster must name one.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    global _own_dir
    if _own_dir is None:
        local = tempfile.mkdtemp(prefix="leafmill-")
        atexit.register(shutil.rmtree, local, ignore_errors=True)
        _own_dir = f"file://{local}"
    spark.sparkContext.setCheckpointDir(_own_dir)
    return _own_dir


def new_dir(spark: SparkSession, tag: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/leafmill/{tag}-{uuid.uuid4().hex}"


def cores(spark: SparkSession) -> int | None:
    """Cores of the session's executors; None where executors come and go (dynamic allocation)."""
    conf = spark.sparkContext.getConf()
    if conf.get("spark.dynamicAllocation.enabled", "false") == "true":
        return None
    asked = int(conf.get("spark.executor.instances", "1")) * int(conf.get("spark.executor.cores", "1"))
    return max(1, spark.sparkContext.defaultParallelism, asked)


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """What is run here removes its shuffle files when it ends; else they lie on disk until the driver collects garbage."""
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def write_table(df: DataFrame, path: str, files_per_core: int | None = None) -> None:
    """Write ``df`` as Parquet in at most ``files_per_core`` files for each core; None: one for each partition."""
    n = cores(df.sparkSession)
    if files_per_core and n:
        df = df.coalesce(files_per_core * n)
    with shuffles_removed(df.sparkSession):
        df.write.parquet(path)


def materialize(df: DataFrame, tag: str, files_per_core: int | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Cuts the lineage: later stages and lost executors reread the files instead of
    computing the table again. With ``files_per_core``, at most so many files for each core
    are written (partitions are read one after the other, so a task needs no more memory).
    That is for small tables that come out of shuffles; a scan of texts keeps its partitions,
    so that its tasks stay short at any size.
    """
    path = new_dir(df.sparkSession, tag)
    write_table(df, path, files_per_core)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table._leafmill_path = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete what ``materialize`` wrote for these tables; for those that no later plan reads."""
    for table in tables:
        _delete(table.sparkSession, table._leafmill_path)


def _delete(spark: SparkSession, path: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remove_intermediates(spark: SparkSession) -> None:
    """Delete every intermediate table of this library below the shared folder, once no result reads them any more."""
    _delete(spark, f"{shared_dir(spark)}/leafmill")


#: A table of more rows, or of more bytes, than this is not sent to every task.
BROADCAST_ROWS, BROADCAST_BYTES = 500_000, 64 * 1024 * 1024


def _row_bytes(df: DataFrame) -> Column:
    """About how many bytes a row has: strings as they are, nested columns as JSON, others 8."""

    def of(field: StructField) -> Column:
        col = F.col(f"`{field.name}`")
        if isinstance(field.dataType, StringType):
            return F.octet_length(col)
        if isinstance(field.dataType, ArrayType) and isinstance(field.dataType.elementType, StringType):
            return F.octet_length(F.array_join(col, "")) + 8 * F.size(col)
        if isinstance(field.dataType, ArrayType | MapType | StructType):
            return F.octet_length(F.to_json(F.struct(col)))
        return F.lit(8)

    return sum((F.coalesce(of(f), F.lit(0)) + 8 for f in df.schema), F.lit(0))


def _blocks_of(df: DataFrame, rows: int, size: int) -> int:
    """Into how many parts ``df`` must be cut so that each has about ``rows`` rows and ``size`` bytes at most."""
    told = df.agg(F.count("*").alias("n"), F.sum(_row_bytes(df)).alias("bytes")).first()
    return max(1, -(-told["n"] // rows), -(-(told["bytes"] or 0) // size))


def is_small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """Whether ``df`` has at most ``rows`` rows and ``size`` bytes, which is counted."""
    return _blocks_of(df, rows, size) == 1


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows and ``size`` bytes, which is counted; else as it is."""
    return F.broadcast(df) if is_small(df, rows, size) else df


def broadcast_blocks(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> list[DataFrame]:
    """``df`` in parts that can each be sent to every task: one if it is small, else by a hash of its rows.

    For a stated set (an outline) that every row of another table is compared with.
    """
    n = _blocks_of(df, rows, size)
    if n == 1:
        return [F.broadcast(df)]
    part = F.pmod(F.xxhash64(*df.columns), F.lit(2 * n))
    return [F.broadcast(df.where(part == i)) for i in range(2 * n)]
