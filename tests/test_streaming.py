"""Incremental runs: each file once, each key once, repeated batches without effect."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscale.streaming import incremental


def test_files_are_taken_once(spark, tmp_path):
    inbox, log, check = str(tmp_path / "in"), str(tmp_path / "log"), str(tmp_path / "check")
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    rows.write.parquet(f"{inbox}")
    run = lambda: incremental.run_once(incremental.new_files(spark, inbox, rows.schema), lambda batch, _: incremental.append_unseen(batch, log, ["id"]), check)
    run()
    run()
    spark.createDataFrame([(2, "c"), (3, "d"), (3, "d")], "id int, v string").write.mode("append").parquet(inbox)
    run()
    assert sorted(map(tuple, spark.read.parquet(log).collect())) == [(1, "a"), (2, "b"), (3, "d")]


def test_upsert_is_idempotent(spark, tmp_path):
    path = str(tmp_path / "t")
    first = spark.createDataFrame([("j", 1, 1, "x"), ("j", 1, 2, "y"), ("k", 1, 1, "z")], "journal string, volume int, t int, v string")
    for _ in range(2):
        incremental.upsert(first, path, ["journal", "volume"], ["t"])
    incremental.upsert(first.where("journal = 'k'").withColumn("v", F.lit("w")), path, ["journal", "volume"], ["t"])
    assert sorted((row.journal, row.v) for row in spark.read.parquet(path).collect()) == [("j", "y"), ("k", "w")]


def test_seen_once_in_a_stream(spark, tmp_path, data):
    events = spark.read.parquet(f"{data}/events.parquet")
    events.select("event_id", "ts", "user_id").repartition(3).write.parquet(str(tmp_path / "in"))
    stream = incremental.new_files(spark, str(tmp_path / "in"), events.select("event_id", "ts", "user_id").schema)
    once = incremental.seen_once(stream, ["user_id"], "ts", "60 days")
    out = str(tmp_path / "out")
    incremental.run_once(once, lambda batch, _: batch.write.mode("append").parquet(out), str(tmp_path / "check"))
    assert spark.read.parquet(out).count() == events.select("user_id").distinct().count()
