"""The registered data source: reads, pushed filters, two-phase writes, streams."""

import os

import pytest
from pyspark.sql import functions as F

from leafmill.sources import committed

SCHEMA = "id long, name string, tags array<string>, inner struct<a:long,b:string>, ok boolean, x double"


@pytest.fixture
def source(spark):
    committed.register(spark)
    return spark


def rows(n, start=0):
    return [(i, None if i % 7 == 0 else f"n{i} é\n", [str(i)] * (i % 3), (i, None) if i % 2 else None, i % 5 == 0, i / 4) for i in range(start, start + n)]


def written(spark, path, data, parts=4, mode="append"):
    df = spark.createDataFrame(data, SCHEMA).repartitionByRange(parts, "id")
    df.write.format("committed_json").option("path", path).option("key", "id").mode(mode).save()


def read(spark, path):
    return spark.read.format("committed_json").option("path", path).option("key", "id").option("files_per_partition", "1").load()


def told(df):
    return sorted(map(str, df.select("id", "name", "tags", "inner", "ok", "x").collect()))


def test_round_trip_and_overwrite(source, tmp_path):
    path = str(tmp_path / "t")
    written(source, path, rows(40))
    written(source, f"file://{path}", rows(10, 100))
    assert told(read(source, path)) == told(source.createDataFrame(rows(40) + rows(10, 100), SCHEMA))
    written(source, path, rows(3), mode="overwrite")
    assert told(read(source, path)) == told(source.createDataFrame(rows(3), SCHEMA))
    assert sum(len(files) for _, _, files in os.walk(tmp_path / "t" / "data")) <= 4
    assert not [f for f in os.listdir(tmp_path / "t" / "commits") if not f.endswith(".json")]


@pytest.mark.parametrize(
    "where, partitions",
    [("id = 13", 1), ("id >= 30", 1), ("id > 5 and id < 8", 1), ("id in (2, 39)", 2), ("id = 1000", 1), ("name = 'n8 é\\n'", 4), ("x > 8", 4),
     ("name is null", 4), ("id <=> 3", 1), ("id <= 9 and ok", 1)],
)
def test_pushed_filters(source, tmp_path, where, partitions):
    path = str(tmp_path / "t")
    written(source, path, rows(40))
    df = read(source, path).where(where)
    assert told(df) == told(source.createDataFrame(rows(40), SCHEMA).where(where))
    assert df.rdd.getNumPartitions() == partitions


def test_failed_tasks_leave_nothing(source, tmp_path):
    path = tmp_path / "t"
    written(source, str(path), rows(8))
    before = sorted(os.listdir(path / "data"))
    broken = source.createDataFrame(rows(40), SCHEMA).repartitionByRange(4, "id").withColumn("ok", F.when(F.col("id") == 39, F.raise_error(F.lit("stop"))).otherwise(F.col("ok")))
    with pytest.raises(Exception, match="stop"):
        broken.select("id", "name", "tags", "inner", F.col("ok").cast("boolean").alias("ok"), "x").write.format("committed_json").option("path", str(path)).mode("append").save()
    assert sorted(os.listdir(path / "data")) == before and len(os.listdir(path / "commits")) == 1
    with pytest.raises(Exception, match="cannot hold"):
        source.range(1).select(F.current_timestamp().alias("t")).write.format("committed_json").option("path", str(path)).mode("append").save()


def test_streams_read_every_commit_once(source, tmp_path):
    path, out, state = str(tmp_path / "t"), str(tmp_path / "out"), str(tmp_path / "state")
    written(source, path, rows(10))

    def run():
        stream = source.readStream.format("committed_json").option("path", path).schema(SCHEMA).load().where("id % 2 = 0")
        writing = stream.writeStream.format("committed_json").option("path", out).option("checkpointLocation", state).trigger(availableNow=True)
        started = writing.start()
        started.awaitTermination(120)
        started.stop()

    run()
    written(source, path, rows(6, 50))
    run()
    run()
    assert told(read(source, out)) == told(source.createDataFrame(rows(10) + rows(6, 50), SCHEMA).where("id % 2 = 0"))


def test_empty_folders(source, tmp_path):
    with pytest.raises(Exception, match="no commit"):
        read(source, str(tmp_path / "none")).count()
    written(source, str(tmp_path / "t"), [])
    assert read(source, str(tmp_path / "t")).count() == 0
