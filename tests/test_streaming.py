"""Streams over files, run to their end."""

from __future__ import annotations

import datetime as dt

from fathomline import streaming

T = dt.datetime(2024, 1, 1)


def at(minutes: int) -> dt.datetime:
    return T + dt.timedelta(minutes=minutes)


def test_sessions_close_after_a_gap_and_late_rows_are_left_out(spark, tmp_path):
    schema = "user_id int, ts timestamp"
    for name, rows in (("1", [(1, at(0)), (1, at(20)), (1, at(90))]), ("2", [(2, at(600))]), ("3", [(2, at(610))]), ("4", [(1, at(5)), (2, at(900))])):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / name))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    q = streaming.sessions(stream).writeStream.format("memory").queryName("closed_sessions").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = sorted((r.user_id, r.first, r.last, r.n) for r in spark.table("closed_sessions").collect())
    assert got[:2] == [(1, at(0), at(50), 2), (1, at(90), at(120), 1)] and all(r[0] == 2 for r in got[2:])


def test_upserts_keep_the_last_row_of_a_key_and_batches_replace_themselves(spark, tmp_path):
    path = str(tmp_path / "out")
    write = streaming.upsert_into(path, ["k"], "seq")
    first = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")], "k string, seq int, v string")
    second = spark.createDataFrame([("b", 5, "new")], first.schema)
    for batch, number in ((first, 0), (second, 1), (second, 1)):
        write(batch, number)
    assert sorted((r.k, r.v) for r in streaming.latest(spark, path, ["k"]).collect()) == [("a", "y"), ("b", "new")]
