from pyspark.sql import functions as F

from tessellar.streaming import running


def test_windows_drop_late_rows(spark, tmp_path):
    rows = [("2024-01-01 00:10:00", "a", 1.0), ("2024-01-01 00:20:00", "a", 3.0), ("2024-01-01 09:00:00", "a", 5.0)]
    frame = spark.createDataFrame(rows, "t string, key string, value double").select(F.to_timestamp("t").alias("ts"), "key", "value")
    frame.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = running.windowed_maps(spark.readStream.schema(frame.schema).parquet(str(tmp_path / "in")))
    query = stream.writeStream.outputMode("append").format("memory").queryName("windows").option("checkpointLocation", str(tmp_path / "c")).start()
    query.processAllAvailable()
    query.stop()
    out = spark.sql("SELECT * FROM windows").collect()
    assert [(r.n, r.mean, r.sd) for r in out] == [(2, 2.0, 1.0)]


def test_zscored(spark):
    events = spark.createDataFrame([("a", 3.0), ("b", 1.0)], "key string, value double")
    reference = spark.createDataFrame([("a", 1.0, 2.0), ("b", 1.0, 0.0)], "key string, mean double, sd double")
    assert {r.key: r.z for r in running.zscored(events, reference).collect()} == {"a": 1.0, "b": None}
