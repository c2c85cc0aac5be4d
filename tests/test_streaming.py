"""Residual expiry in batch, template counts in a stream."""

from __future__ import annotations

import datetime

from sparkpress.streaming import residual_store


def test_alive_and_expand(spark):
    rows = spark.createDataFrame([("s", "a", "x", 1), ("s", "b", "y", 5), ("t", "a", "z", 1)], "session string, handle string, text string, stored_at long")
    live = residual_store.alive(rows, 2)
    assert {(r.session, r.handle) for r in live.collect()} == {("s", "b"), ("t", "a")}
    asked = spark.createDataFrame([("s", "a"), ("s", "b")], "session string, handle string")
    assert [r.text for r in residual_store.expand(live, asked).collect()] == ["y"]


def test_template_counts_stream(spark, tmp_path):
    rows = [(datetime.datetime(2024, 1, 1, 10, m), f"m{m % 2}") for m in range(20)]
    spark.createDataFrame(rows, "ts timestamp, mask string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, mask string").parquet(str(tmp_path / "in"))
    query = residual_store.template_counts(stream).writeStream.outputMode("append").format("memory").queryName("templates").start()
    query.processAllAvailable()
    query.stop()
    # the last event is at 10:19, so with ten minutes of lateness only windows that end by 10:09 are final
    assert {(r.mask, r.n) for r in spark.table("templates").collect()} == {("m0", 3), ("m1", 2)}
