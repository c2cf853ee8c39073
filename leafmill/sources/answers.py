"""Answers of model calls kept between runs: a versioned table of bounded size.

A run adds one delta in which every key that was asked has a row: a new answer, or only the time of
its use. A delta counts once it is whole. Reading takes, for each asked key, its last answer; rows lie
in folders by a hash of the key, so only the folders of asked keys are opened. ``compact`` turns
everything into one base and evicts: keys are kept from the last used on as long as
their sizes add up to ``most_bytes``. Where that line is, is found by summing sizes over ever finer ranges
of time, ``RANGES`` sums a round, so that no task or driver sees the keys in order.

One writer at a time; readers keep the version that they opened, until ``vacuum`` removes what no
newer reader needs.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.functions.jsonx import json_array
from leafmill.functions.models import model_call
from leafmill.storage import discard, materialize

BUCKETS, RANGES, DELTAS = 16, 1024, 8

_ROWS = "key string, answer string, size long, used long, version long, bucket int"


def first_out(rows: DataFrame, by: str, budget: int, size: str = "size") -> tuple[int | None, int]:
    """(value, rest): rows with a greater ``by`` all fit into ``budget``, those with ``value`` need more than the ``rest``.

    ``by`` is long; value is None where all rows fit.
    """
    told = rows.agg(F.min(by).alias("low"), F.max(by).alias("high"), F.coalesce(F.sum(size), F.lit(0)).alias("total")).first()
    if told["low"] is None or told["total"] <= budget:
        return None, budget
    low, high = told["low"], told["high"]
    while True:
        width = max(1, -(-(high - low + 1) // RANGES))
        inside = rows.where(F.col(by).between(low, high))
        sums = inside.groupBy(F.expr(f"(cast({by} as decimal(38, 0)) - {low}) div {width}").alias("r")).agg(F.sum(size).alias("n"))
        for r, n in sorted(((int(x["r"]), x["n"]) for x in sums.collect()), reverse=True):
            if n > budget:
                low, high = low + r * width, min(high, low + (r + 1) * width - 1)
                break
            budget -= n
        if low == high:
            return low, budget


def last_used(rows: DataFrame, most_bytes: int) -> DataFrame:
    """The rows (key, size, used) from the last used on whose sizes add up to at most ``most_bytes``; ties by a hash of the key."""
    kept = materialize(rows.select("key", "size", "used", F.xxhash64("key").alias("hash")), "uses")
    at, rest = first_out(kept, "used", most_bytes)
    if at is None:
        return kept.drop("hash")
    tied = kept.where(F.col("used") == at)
    hash_at, _ = first_out(tied, "hash", rest)
    inside = F.col("used") > at
    if hash_at is not None:
        inside |= (F.col("used") == at) & (F.col("hash") > hash_at)
    return kept.where(inside).drop("hash")


class AnswerTable:
    """The table below ``path``; what a run changes is a new version."""

    def __init__(self, spark: SparkSession, path: str, most_bytes: int, buckets: int = BUCKETS, deltas: int = DELTAS):
        self.spark, self.path, self.most_bytes, self.buckets, self.deltas = spark, path.rstrip("/"), most_bytes, buckets, deltas

    def _files(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _versions(self) -> list[tuple[int, str]]:
        """(version, 'base' or 'delta') of what is whole, in order."""
        path, files = self._files()
        if not files.exists(path):
            return []
        found = []
        for status in files.listStatus(path):
            name = re.fullmatch(r"v(\d+)-(base|delta)", status.getPath().getName())
            if name and files.exists(self.spark._jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")):
                found.append((int(name[1]), name[2]))
        return sorted(found)

    def _live(self) -> list[tuple[int, str]]:
        """The last base and the deltas after it."""
        found = self._versions()
        bases = [i for i, (_, kind) in enumerate(found) if kind == "base"]
        return found[bases[-1] :] if bases else found

    def version(self) -> int:
        return max((v for v, _ in self._versions()), default=0)

    def _rows(self) -> DataFrame:
        parts = [self.spark.read.schema(_ROWS).parquet(f"{self.path}/v{v:010}-{kind}") for v, kind in self._live()]
        rows = self.spark.createDataFrame([], _ROWS)
        for part in parts:
            rows = rows.unionByName(part)
        return rows

    @staticmethod
    def _state(rows: DataFrame) -> DataFrame:
        """(key, answer, size, used) of keys that have an answer."""
        last = F.max(F.when(F.col("answer").isNotNull(), F.struct("version", "answer", "size"))).alias("last")
        state = rows.groupBy("bucket", "key").agg(last, F.max("used").alias("used")).where("last is not null")
        return state.select("bucket", "key", "last.answer", "last.size", "used")

    def answers(self) -> DataFrame:
        """(key, answer, size, used) of the whole table."""
        return self._state(self._rows()).drop("bucket")

    def _bucket(self) -> Column:
        return F.expr(f"cast(pmod(xxhash64(key), {self.buckets}) as int)")

    def _write(self, rows: DataFrame, kind: str) -> None:
        version = self.version() + 1
        rows = rows.withColumn("version", F.lit(version).cast("long"))
        rows.select("key", "answer", "size", "used", "version", "bucket").repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(
            f"{self.path}/v{version:010}-{kind}"
        )

    def lookup(self, keys: DataFrame) -> DataFrame:
        """(key, answer, size, used) of the distinct ``keys`` that the table has."""
        asked = keys.select("key").distinct().withColumn("bucket", self._bucket())
        return self._state(self._rows().join(asked, ["bucket", "key"], "left_semi")).drop("bucket")

    def ask(self, asks: DataFrame, call: Callable[[str], str], on_failure: Callable[[Column], Column] | None = None) -> DataFrame:
        """(key, answer, error, cached) for each distinct key of ``asks`` (key, input, used).

        Keys that the table has are answered from it and count as used; the others are asked once each and
        their answers kept. A failed call is an answer of null and its error, and is asked again by the next run, unless
        ``on_failure`` makes an answer of the error. Of a key's rows the least input is asked.
        """
        asked = asks.where("key is not null").groupBy("key").agg(F.min("input").alias("input"), F.max("used").alias("used"))
        asked = materialize(asked.withColumn("bucket", self._bucket()), "asked")
        known = materialize(self.lookup(asked).select("key", "answer"), "known")
        new = model_call(asked.join(known, "key", "left_anti"), F.col("input"), call, "answer")
        if on_failure is not None:
            new = new.withColumn("answer", F.when(F.col("answer_error").isNotNull(), on_failure(F.col("answer_error"))).otherwise(F.col("answer")))
        new = materialize(new, "new_answers")
        size = F.octet_length("answer").cast("long")
        kept = new.where("answer is not null").select("key", "answer", size.alias("size"), "used", "bucket")
        touched = asked.join(known.select("key"), "key", "left_semi").select(
            "key", F.lit(None).cast("string").alias("answer"), F.lit(0).cast("long").alias("size"), "used", "bucket"
        )
        self._write(kept.unionByName(touched), "delta")
        if sum(kind == "delta" for _, kind in self._live()) >= self.deltas:
            self.compact()
        fresh = new.select("key", "answer", F.col("answer_error").alias("error"), F.lit(False).alias("cached"))
        return known.select("key", "answer", F.lit(None).cast("string").alias("error"), F.lit(True).alias("cached")).unionByName(fresh)

    def compact(self) -> None:
        """One base of the keys last used whose answers fit into ``most_bytes``."""
        state = materialize(self._state(self._rows()), "state")
        kept = last_used(state, self.most_bytes)
        self._write(state.join(kept.select("key"), "key", "left_semi"), "base")
        discard(state)

    def vacuum(self) -> None:
        """Delete versions before the last base; no reader that opened them may still run."""
        live = self._live()
        path, files = self._files()
        for v, kind in self._versions():
            if live and v < live[0][0]:
                files.delete(self.spark._jvm.org.apache.hadoop.fs.Path(path, f"v{v:010}-{kind}"), True)


#: Reasons of judgements that no model gave.
NO_REASON, UNREADABLE, CALL_FAILED = "No reason provided.", "Failed to parse JSON from LLM response: ", "LLM call failed - "


def judged(table: AnswerTable, asks: DataFrame, call: Callable[[str], str]) -> DataFrame:
    """(key, is_high_quality, reason, source, cached) for each distinct key of ``asks`` (key, input, used).

    The answer's JSON object has ``is_high_quality`` and ``reason``; an array gives its first object. A failed call and
    an answer without an object are judgements too, of low quality, and kept like the others. ``source`` is cache or call.
    """

    def failed(error: Column) -> Column:
        reason = F.concat(F.lit(CALL_FAILED), F.regexp_replace(error, "^[A-Za-z_.]+: ", ""))
        return F.to_json(F.struct(F.lit(False).alias("is_high_quality"), reason.alias("reason")))

    said = table.ask(asks, call, on_failure=failed).where("answer is not null")
    found = F.try_parse_json(json_array(F.col("answer")))
    first = F.coalesce(F.try_variant_get(found, "$[0]", "variant"), found)
    readable = F.coalesce(F.startswith(F.schema_of_variant(first), F.lit("OBJECT")), F.lit(False))
    good = F.coalesce(F.try_variant_get(first, "$.is_high_quality", "boolean"), F.lit(False))
    reason = F.coalesce(F.try_variant_get(first, "$.reason", "string"), F.lit(NO_REASON))
    return said.select(
        "key",
        F.when(readable, good).otherwise(False).alias("is_high_quality"),
        F.when(readable, reason).otherwise(F.concat(F.lit(UNREADABLE), "answer")).alias("reason"),
        F.when(F.col("cached"), "cache").otherwise("call").alias("source"),
        "cached",
    )
