"""The stream's keyed table: replays, restarts, order and the history's limit."""

import pytest
from pyspark.sql import functions as F

from claimspark.streaming.keyed_table import merge_batch, merge_stream, read_table, state, tidy
from claimspark.streaming.usage import keep_usage

SCHEMA = "k int, ts int, v string"


def rows(spark, path):
    return sorted((tuple(r) for r in read_table(spark, path).select("k", "ts", "v").collect()), key=str)


def test_replays_and_order(spark, tmp_path):
    path, df = str(tmp_path / "t"), lambda *r: spark.createDataFrame(list(r), SCHEMA)
    assert state(spark, path) is None
    with pytest.raises(ValueError):
        read_table(spark, path)
    merge_batch(df((1, 1, "a"), (2, 1, "b"), (2, 2, "c"), (None, 1, "n")), 0, path, ["k"], ["ts"], buckets=4)
    want = [(1, 1, "a"), (2, 2, "c"), (None, 1, "n")]
    assert rows(spark, path) == sorted(want, key=str)
    merge_batch(df((1, 9, "again")), 0, path, ["k"], ["ts"], buckets=4)  # the same batch once more
    assert rows(spark, path) == sorted(want, key=str) and state(spark, path).lifetime == 3
    merge_batch(df((1, 0, "late"), (2, 2, "newer batch"), (3, None, "x"), (None, 2, "m")), 1, path, ["k"], ["ts"], buckets=4)
    want = [(1, 1, "a"), (2, 2, "newer batch"), (3, None, "x"), (None, 2, "m")]
    assert rows(spark, path) == sorted(want, key=str) and state(spark, path).lifetime == 4
    merge_batch(df(), 2, path, ["k"], ["ts"], buckets=4)
    assert state(spark, path).version == 1
    with pytest.raises(ValueError):
        merge_batch(df((1, 1, "a")), 3, path, ["k"], ["ts"], buckets=5)


def test_a_batch_that_died_before_its_manifest_starts_afresh(spark, tmp_path):
    path, df = str(tmp_path / "t"), lambda *r: spark.createDataFrame(list(r), SCHEMA)
    merge_batch(df((1, 1, "a")), 0, path, ["k"], ["ts"], buckets=2)
    df((9, 9, "half")).withColumn("bucket", F.lit(1)).write.partitionBy("bucket").parquet(f"{path}/data/1")
    assert rows(spark, path) == [(1, 1, "a")]
    merge_batch(df((5, 1, "e")), 1, path, ["k"], ["ts"], buckets=2)
    assert rows(spark, path) == [(1, 1, "a"), (5, 1, "e")]


def test_tidy_keeps_what_manifests_name(spark, tmp_path):
    path = str(tmp_path / "t")
    for n in range(5):
        merge_batch(spark.createDataFrame([(n % 2, n, str(n)), (7, 0, "once")], SCHEMA), n, path, ["k"], ["ts"], keep=10)
    before = rows(spark, path)
    assert tidy(spark, path, 1) == 8 and rows(spark, path) == before == [(0, 4, "4"), (1, 3, "3"), (7, 0, "once")]
    merge_batch(spark.createDataFrame([(8, 1, "8")], SCHEMA), 5, path, ["k"], ["ts"], keep=10)
    assert len(rows(spark, path)) == 4


def test_stream_goes_on_from_its_checkpoint(spark, tmp_path):
    src, path, state_dir = str(tmp_path / "in"), str(tmp_path / "t"), str(tmp_path / "c")

    def run(limit=None):
        read = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(src)
        merge_stream(read, path, state_dir, ["k"], ["ts"], lambda b: b.withColumn("v", F.upper("v")), limit, 3).awaitTermination()

    for n in range(3):
        spark.createDataFrame([(k, n, f"b{n}") for k in range(n, n + 4)], SCHEMA).coalesce(1).write.mode("append").parquet(src)
    run()
    assert rows(spark, path) == [(0, 0, "B0"), (1, 1, "B1")] + [(k, 2, "B2") for k in range(2, 6)]
    run()
    spark.createDataFrame([(0, 5, "end")], SCHEMA).write.mode("append").parquet(src)
    run()
    assert rows(spark, path)[0] == (0, 5, "END") and state(spark, path).lifetime == 6


def test_usage_log_keeps_the_newest(spark, tmp_path):
    fields = "request_id int, ts int, provider string, model string, input long, output long, cached long, reasoning long, cache_creation long"
    prices = spark.createDataFrame([("p", "m", 3.0, None, 1.0, None, None)], "provider string, model string, input double, cached double, output double, reasoning double, cache_creation double")
    src = str(tmp_path / "in")
    for part in ([(i, i % 50, "p", "m", 1_000_000, 0, 0, 0, 0) for i in range(60)], [(i, i % 50, "p", "m", 1_000_000, 0, 0, 0, 0) for i in range(55, 90)]):
        spark.createDataFrame(part, fields).coalesce(1).write.mode("append").parquet(src)
    keep_usage(spark.readStream.schema(fields).option("maxFilesPerTrigger", 1).parquet(src), prices, str(tmp_path / "t"), str(tmp_path / "c"), keep=25).awaitTermination()
    got = [(r.ts, r.request_id) for r in read_table(spark, str(tmp_path / "t")).filter("cost = 3.0").collect()]
    assert sorted(got) == sorted(sorted(((i % 50, i) for i in range(90)), key=lambda x: (-x[0], x[1]))[:25])
    # Requests 55 to 59 had gone when they came again.
    assert state(spark, str(tmp_path / "t")).lifetime == 95
