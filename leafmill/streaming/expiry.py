"""A cache whose entries expire a while after their last use, as a keyed operator over tables and streams.

A request for a key that the cache holds is a ``hit`` and starts its timer again. Otherwise the
value is loaded: where that succeeds (``ok``) it is stored, a ``miss``; where it fails nothing is, ``failed``, and
the next request loads again. An entry is ``evicted`` when ``ttl`` seconds have passed without a request; a
request at that very moment comes too late.

Over a table the outcomes are window expressions: requests less than ``ttl`` apart are one stretch, and
the first load of a stretch that succeeds makes hits of what follows. Over a stream they come
from keyed state with event-time timers: requests wait until the watermark has passed them, so
rows that come late, but not later than it allows, give what the table gives.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

_STATE = "waiting array<long>, ids array<long>, oks array<boolean>, last long, held boolean"
HIT, MISS, FAILED, EVICTED = "hit", "miss", "failed", "evicted"


def outcomes(requests: DataFrame, ttl: int, key: str = "key", ts: str = "ts", ok: str = "ok", request: str = "request_id", lateness: str = "1 hour") -> DataFrame:
    """(key, at, request, outcome): one row for each request, and one without request for each eviction.

    ``at`` is a timestamp. Requests of one key at one time are taken by their id; a null ``ok`` is a failure.
    """
    rows = requests.select(
        F.col(key).alias("key"), F.col(ts).cast("timestamp").alias("at"), F.col(request).cast("long").alias("request"), F.coalesce(ok, F.lit(False)).alias("ok")
    )
    if requests.isStreaming:
        found = _by_state(rows.withWatermark("at", lateness), ttl)
    else:
        found = _by_windows(rows, ttl)
    return found.select(F.col("key").alias(key), "at", F.col("request").alias(request), "outcome")


def _by_windows(rows: DataFrame, ttl: int) -> DataFrame:
    rows = rows.withColumn("us", F.unix_micros("at"))
    in_order = Window.partitionBy("key").orderBy("us", "request")
    apart = F.coalesce(F.col("us") - F.lag("us").over(in_order) >= ttl * 1_000_000, F.lit(True))
    stretch = rows.withColumn("stretch", F.sum(apart.cast("int")).over(in_order.rowsBetween(Window.unboundedPreceding, 0)))
    before = Window.partitionBy("key", "stretch").orderBy("us", "request").rowsBetween(Window.unboundedPreceding, -1)
    stored = F.coalesce(F.max("ok").over(before), F.lit(False))
    told = stretch.withColumn("outcome", F.when(stored, HIT).when(F.col("ok"), MISS).otherwise(FAILED))
    evicted = (
        told.groupBy("key", "stretch")
        .agg(F.max("us").alias("us"), F.max("ok").alias("ok"))
        .where("ok")
        .select("key", F.timestamp_micros(F.col("us") + ttl * 1_000_000).alias("at"), F.lit(None).cast("long").alias("request"), F.lit(EVICTED).alias("outcome"))
    )
    return told.select("key", "at", "request", "outcome").unionByName(evicted)


class Entry:
    """One key's requests that wait, and its entry: when it was last used, and whether it is held."""

    def __init__(self, ttl_us: int, waiting=(), ids=(), oks=(), last: int = 0, held: bool = False):
        self.ttl, self.waiting, self.last, self.held = ttl_us, list(zip(waiting, ids, oks, strict=True)), last, held

    def advance(self, until: int) -> list[tuple[int, int | None, str]]:
        """What happens before ``until``: (time, request, outcome) in order of time."""
        out: list[tuple[int, int | None, str]] = []
        self.waiting.sort()
        done = 0
        for at, request, ok in self.waiting:
            if at >= until:
                break
            done += 1
            self._expire(at, out)
            if self.held or ok:
                out.append((at, request, HIT if self.held else MISS))
                self.held, self.last = True, at
            else:
                out.append((at, request, FAILED))
        del self.waiting[:done]
        self._expire(until - 1, out)
        return out

    def _expire(self, now: int, out: list) -> None:
        if self.held and self.last + self.ttl <= now:
            out.append((self.last + self.ttl, None, EVICTED))
            self.held = False

    def next_time(self) -> int | None:
        """When something happens next."""
        times = [at for at, _, _ in self.waiting] + ([self.last + self.ttl] if self.held else [])
        return min(times, default=None)


def _by_state(rows: DataFrame, ttl: int) -> DataFrame:
    schema = StructType([rows.schema["key"]]).add("at", "timestamp").add("request", "long").add("outcome", "string")

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        entry = Entry(ttl * 1_000_000, *state.get) if state.exists else Entry(ttl * 1_000_000)
        for part in parts:
            entry.waiting += zip(part["us"].tolist(), part["request"].tolist(), part["ok"].tolist(), strict=True)
        mark = state.getCurrentWatermarkMs()
        found = entry.advance(mark * 1000)
        if (at := entry.next_time()) is None:
            state.remove()
        else:
            waiting, ids, oks = map(list, zip(*entry.waiting, strict=True)) if entry.waiting else ([], [], [])
            state.update((waiting, ids, oks, entry.last, entry.held))
            state.setTimeoutTimestamp(max(mark + 1, at // 1000 + 1))
        if found:
            yield pd.DataFrame(
                {
                    "key": [key[0]] * len(found),
                    "at": pd.to_datetime([t for t, _, _ in found], unit="us", utc=True),
                    "request": pd.array([r for _, r, _ in found], "Int64"),
                    "outcome": [o for _, _, o in found],
                }
            )

    timed = rows.withColumn("us", F.unix_micros("at"))
    return timed.groupBy("key").applyInPandasWithState(run, schema, _STATE, "append", GroupStateTimeout.EventTimeTimeout)
