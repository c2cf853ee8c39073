"""The cache's behaviour as event-time windows, over tables and over streams alike."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sliding_expiry_sessions(events: DataFrame, key: str = "user_id", ts: str = "ts", gap: str = "5 minutes") -> DataFrame:
    """One row for each cache miss: a session of accesses to a key with no gap above ``gap``.

    Every access resets the timer; all but a session's first are hits.
    """
    stamped = events.withColumn("_ts", F.col(ts).cast("timestamp"))
    if events.isStreaming:
        stamped = stamped.withWatermark("_ts", gap)
    return (
        stamped.groupBy(key, F.session_window("_ts", gap).alias("w"))
        .agg(F.count("*").alias("accesses"))
        .select(key, F.col("w.start").alias("started"), "accesses", (F.col("accesses") - 1).alias("hits"))
    )


def hourly_buckets(events: DataFrame, ts: str = "ts") -> DataFrame:
    """Accesses by hour bucket."""
    stamped = events.withColumn("_ts", F.col(ts).cast("timestamp"))
    if events.isStreaming:
        stamped = stamped.withWatermark("_ts", "1 hour")
    return stamped.groupBy(F.window("_ts", "1 hour").alias("w")).agg(F.count("*").alias("accesses")).select(
        F.col("w.start").alias("hour"), "accesses"
    )


def one_at_a_time(requests: DataFrame, fetch, schema: str, domain: str = "domain", partitions: int | None = None) -> DataFrame:
    """Requests of one domain in one task, one after the other; ``fetch`` maps batches as ``mapInPandas`` does."""
    dealt = requests.repartition(partitions, domain) if partitions else requests.repartition(domain)
    return dealt.sortWithinPartitions(domain).mapInPandas(fetch, schema)
