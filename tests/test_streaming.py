from __future__ import annotations

from datetime import datetime

from curvestat.operators.reml import sufficient
from curvestat.streaming import running


def test_windows_merge_to_the_batch_statistics(spark, tmp_path):
    rows = [(i, datetime(2024, 1, 1 + i % 5, i % 24), i % 3, float(i)) for i in range(60)]
    rows.append((99, datetime(2024, 3, 1), 0, 0.0))  # moves the watermark past all others
    events = spark.createDataFrame(rows, "event_id int, ts timestamp, user_id int, value double")
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = running.to_parquet(running.windowed_statistics(stream, "user_id", "value"), str(tmp_path / "out"), str(tmp_path / "state"))
    q.awaitTermination(120)
    merged = running.merge(spark.read.parquet(str(tmp_path / "out")), ["user_id"]).collect()
    batch = sufficient(events.filter("event_id < 99"), [], "user_id", "value").collect()
    key = lambda r: (r["user_id"], r["n"], r["s"], r["z"])
    assert sorted(map(key, merged)) == sorted(map(key, batch))
