"""Moments of a stream agree with those of a batch; late rows are dropped."""

from pyspark.sql import functions as F

from ndspark.streaming.moments import moments


def test_windows_and_late_rows(spark, tmp_path):
    def write(k, rows):
        spark.createDataFrame(rows, "ts string, k string, x double").withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.parquet(str(tmp_path / "in" / f"b{k}"))

    write(0, [("2024-01-01 00:10:00", "a", 1.0), ("2024-01-01 00:20:00", "a", 3.0), ("2024-01-01 05:00:00", "a", 5.0)])
    write(1, [("2024-01-01 05:10:00", "a", float("nan"))])
    write(2, [("2024-01-01 00:30:00", "a", 100.0)])  # far behind the watermark
    write(3, [("2024-01-01 09:00:00", "b", 2.0)])
    write(4, [("2024-01-01 09:30:00", "b", 2.0)])
    schema = "ts timestamp, k string, x double"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(str(tmp_path / "in" / "*"))
    query = moments(stream, "x", ["k"], time="ts", window="1 hour", late="10 minutes", nan=True).writeStream.format("memory").queryName("late_moments").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    found = {(r["k"], r["window_start"].hour): r for r in spark.table("late_moments").collect()}
    assert found["a", 0]["count"] == 2 and found["a", 0]["sum"] == 4.0 and found["a", 0]["var"] == 2.0
    assert found["a", 5]["sum"] == 5.0 and found["a", 5]["count"] == 2


def test_running_sums_of_late_rows(spark, tmp_path):
    from ndspark.streaming.scans import running

    def write(k, rows):
        spark.createDataFrame(rows, "ts string, k string, id long, x double").withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.parquet(str(tmp_path / "in" / f"b{k}"))

    write(0, [("2024-01-01 00:10:00", "a", 1, 1.0), ("2024-01-01 00:30:00", "a", 3, 4.0), ("2024-01-01 00:30:00", "b", 4, 7.0)])
    write(1, [("2024-01-01 00:20:00", "a", 2, 2.0), ("2024-01-01 00:20:00", "a", 1, None)])  # late, but not too late
    write(2, [("2024-01-01 03:00:00", "a", 5, 8.0)])
    write(3, [("2024-01-01 03:10:00", "a", 8, 1.0)])  # rows before 02:30 leave
    write(4, [("2024-01-01 00:15:00", "a", 6, 100.0)])  # too late
    write(5, [("2024-01-01 09:00:00", "c", 7, 16.0)])
    stream = spark.readStream.schema("ts timestamp, k string, id long, x double").option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(str(tmp_path / "in" / "*"))
    query = running(stream, "x", ["k"], "ts", "id", "30 minutes").writeStream.format("memory").queryName("running_sums").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    found = sorted((r["k"], r["ts"].hour, r["ts"].minute, r["id"], r["x"], r["cumsum"], r["diff"]) for r in spark.table("running_sums").collect())
    assert found == [("a", 0, 10, 1, 1.0, 1.0, None), ("a", 0, 20, 1, 0.0, 1.0, -1.0), ("a", 0, 20, 2, 2.0, 3.0, 2.0), ("a", 0, 30, 3, 4.0, 7.0, 2.0), ("a", 3, 0, 5, 8.0, 15.0, 4.0), ("a", 3, 10, 8, 1.0, 16.0, -7.0), ("b", 0, 30, 4, 7.0, 7.0, None)]


def test_sliding_windows_and_sessions_of_a_table(spark):
    rows = [("2024-01-01 00:10:00", "a", 1.0), ("2024-01-01 00:40:00", "a", 2.0), ("2024-01-01 03:00:00", "a", 4.0)]
    df = spark.createDataFrame(rows, "ts string, k string, x double").withColumn("ts", F.to_timestamp("ts"))
    sliding = {(r["window_start"].hour, r["window_start"].minute): r["sum"] for r in moments(df, "x", ["k"], time="ts", window="1 hour", slide="30 minutes").collect()}
    assert sliding == {(23, 30): 1.0, (0, 0): 3.0, (0, 30): 2.0, (2, 30): 4.0, (3, 0): 4.0}
    sessions = sorted((r["window_start"].hour, r["sum"], r["count"]) for r in moments(df, "x", ["k"], time="ts", gap="1 hour").collect())
    assert sessions == [(0, 3.0, 2), (3, 4.0, 1)]


def test_running_sums_leave_in_pieces_and_not_by_the_driver(spark, tmp_path, monkeypatch):
    from ndspark.queries import QUERIES
    from ndspark.streaming import scans

    monkeypatch.setattr(scans, "OUT", 7)
    rows = [(f"2024-01-01 {(k * 7) % 20:02d}:00:00", "a", k, float(k)) for k in range(40)]
    spark.createDataFrame(rows, "ts string, k string, id long, x double").withColumn("ts", F.to_timestamp("ts")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, k string, id long, x double").parquet(str(tmp_path / "in"))
    query = scans.running(stream, "x", ["k"], "ts", "id", "1 hour").writeStream.format("memory").queryName("running_pieces").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    found = sorted((r["ts"].hour, r["id"], r["cumsum"], r["diff"]) for r in spark.table("running_pieces").collect())
    want, total, last = [], 0.0, None
    for ts, _, k, x in sorted(rows, key=lambda r: (r[0], r[2])):
        total += x
        if int(ts[11:13]) < 18:
            want.append((int(ts[11:13]), k, total, None if last is None else x - last))
        last = x
    assert found == want
    assert "array" not in scans._STATE
    before = {t.name for t in spark.catalog.listTables()}
    assert QUERIES["stream_running"](spark, "/root/testdata/sf0.001").count() > 0
    assert {t.name for t in spark.catalog.listTables()} == before
