"""Caches: expiry by state and by windows, the answers table, against plain simulations."""

import random
from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from leafmill.sources import answers
from leafmill.storage import new_dir
from leafmill.streaming import expiry

DAY = datetime(2024, 5, 1, tzinfo=timezone.utc)


def plain_cache(requests, ttl):
    """A dictionary of times of last use, asked in order of time."""
    out, last = [], {}
    for key, at, i, ok in sorted(requests, key=lambda r: (r[1], r[2])):
        for k, t in list(last.items()):
            if t + ttl <= at:
                out.append((k, t + ttl, None, "evicted"))
                del last[k]
        if key in last:
            outcome = "hit"
        else:
            outcome = "miss" if ok else "failed"
        if outcome != "failed":
            last[key] = at
        out.append((key, at, i, outcome))
    out += [(k, t + ttl, None, "evicted") for k, t in last.items()]
    return sorted(map(str, out))


def requests_of(seed, n=400):
    rng = random.Random(seed)
    times = [rng.choice([rng.randrange(0, 40_000), 60 * rng.randrange(0, 600)]) for _ in range(n)]
    return [(rng.choice("abcd"), t, i, rng.choice([True, True, False, None])) for i, t in enumerate(times)]


def frame(spark, rows):
    stamped = [(k, DAY + timedelta(seconds=t), i, ok) for k, t, i, ok in rows]
    return spark.createDataFrame(stamped, "key string, ts timestamp, request_id long, ok boolean")


def told(df):
    rows = df.select("key", F.unix_seconds("at").alias("at"), "request_id", "outcome").collect()
    start = int(DAY.timestamp())
    return sorted(str((r["key"], r["at"] - start, r["request_id"], r["outcome"])) for r in rows)


def test_expiry_of_a_table(spark):
    rows = requests_of(1)
    want = plain_cache([(k, t, i, bool(ok)) for k, t, i, ok in rows], 300)
    assert told(expiry.outcomes(frame(spark, rows), 300)) == want
    assert {w.split("'")[-2] for w in want} == {"hit", "miss", "failed", "evicted"}


def test_expiry_of_one_key_in_pieces():
    """However the times at which state is looked at fall."""
    rng = random.Random(3)
    rows = [(t, i, rng.random() < 0.6) for i, t in enumerate(sorted(rng.randrange(0, 9000) for _ in range(200)))]
    want = plain_cache([("k", *r) for r in rows], 70)
    for step in (1, 13, 500, 20_000):
        entry, found = expiry.Entry(70), []
        for now in range(0, 20_000, step):
            entry.waiting += [r for r in rows if now <= r[0] < now + step]
            found += entry.advance(now + step - (step > 1))
            assert entry.next_time() is None or entry.next_time() >= now + step - 1
        found += entry.advance(10**6)
        assert sorted(str(("k", *f)) for f in found) == want


def test_expiry_of_a_stream_equals_the_table(spark, tmp_path):
    """Files whose rows overlap in time, late ones included; a last request far ahead lets all timers go off."""
    rows = sorted(requests_of(2, 150), key=lambda r: r[1] + random.Random(r[2]).randrange(0, 2000))
    parts = [rows[i : i + 50] for i in range(0, 150, 50)] + [[("z", 500_000, 999, False)], [("z", 900_000, 1000, False)], [("z", 1_900_000, 1001, False)]]
    for i, part in enumerate(parts):
        frame(spark, part).coalesce(1).write.parquet(str(tmp_path / "in" / f"p{i}"))
    schema = frame(spark, rows[:1]).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    running = expiry.outcomes(stream, 300).writeStream.outputMode("append").format("memory").queryName("expiry_test").start()
    running.processAllAvailable()
    running.stop()
    found = [t for t in told(spark.table("expiry_test")) if not t.startswith("('z'")]
    assert found == plain_cache([(k, t, i, bool(ok)) for k, t, i, ok in rows], 300)


def test_answers_are_kept_between_runs(spark):
    """A second run asks nothing; failures are asked again, or kept where that is wanted."""
    path = new_dir(spark, "test_answers")

    def call(text):
        if text == "bad":
            raise ValueError("no")
        return text * 2

    asks = spark.createDataFrame([("a", "x", 1), ("a", "y", 5), ("b", "bad", 2), ("c", None, 3), (None, "q", 4)], "key string, input string, used long")
    told = lambda df: {r["key"]: (r["answer"], r["error"], r["cached"]) for r in df.collect()}
    table = answers.AnswerTable(spark, path, 1000)
    error = "ValueError: no"
    assert told(table.ask(asks, call)) == {"a": ("xx", None, False), "b": (None, error, False), "c": (None, None, False)}
    again = answers.AnswerTable(spark, path, 1000)
    assert told(again.ask(asks, lambda t: t * 3)) == {"a": ("xx", None, True), "b": ("badbadbad", None, False), "c": (None, None, False)}
    assert again.version() == 2 and told(again.ask(asks.where("key < 'c'"), call)) == {"a": ("xx", None, True), "b": ("badbadbad", None, True)}
    kept = again.ask(spark.createDataFrame([("d", "bad", 9)], asks.schema), call, on_failure=lambda e: F.concat(F.lit("failed - "), e))
    assert told(kept) == {"d": ("failed - " + error, error, False)}
    assert {r["key"]: r["used"] for r in again.answers().collect()} == {"a": 5, "b": 2, "d": 9}


def test_eviction_like_a_simulation(spark):
    """Answers of many sizes, ties in time apart; the table holds the last used that fit, run after run."""
    rng = random.Random(5)
    table = answers.AnswerTable(spark, new_dir(spark, "test_answers"), 120, buckets=3, deltas=1)
    held: dict[str, tuple[int, int]] = {}
    clock = 0
    for _ in range(4):
        asks = []
        for _ in range(12):
            clock += 1
            key = rng.choice("abcdefghijklmnop")
            asks.append((key, key * (1 + 3 * (ord(key) % 7)), clock))
        said = {r["key"]: r["cached"] for r in table.ask(spark.createDataFrame(asks, "key string, input string, used long"), str.upper).collect()}
        assert said == {k: k in held for k, _, _ in asks}
        for key, text, at in asks:
            held[key] = (at, len(text))
        room, kept = 120, {}
        for key in sorted(held, key=lambda k: -held[k][0]):
            if held[key][1] > room:
                break
            room, kept[key] = room - held[key][1], held[key]
        held = kept
        assert {r["key"]: (r["used"], r["size"]) for r in table.answers().collect()} == held
    table.vacuum()
    assert {r["key"]: (r["used"], r["size"]) for r in table.answers().collect()} == held


def test_unfinished_versions_do_not_count(spark, tmp_path):
    table = answers.AnswerTable(spark, f"file://{tmp_path}/t", 100)
    table.ask(spark.createDataFrame([("a", "x", 1)], "key string, input string, used long"), str.upper)
    (tmp_path / "t" / "v0000000002-base").mkdir()
    assert table.version() == 1 and [r["answer"] for r in table.answers().collect()] == ["X"]


def test_line_of_eviction_with_ties(spark):
    rows = [(f"k{i}", 10, i % 3) for i in range(30)]
    df = spark.createDataFrame(rows, "key string, size long, used long")
    kept = answers.last_used(df, 155).collect()
    assert len(kept) == 15 and sum(r["used"] == 2 for r in kept) == 10 and all(r["used"] >= 1 for r in kept)
    assert answers.last_used(df, 300).count() == 30 and answers.last_used(df, 5).count() == 0
