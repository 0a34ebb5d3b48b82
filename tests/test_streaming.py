from pyspark.sql import functions as F

from weftline.streaming import events


def test_streams_agree_with_batches(spark, tmp_path):
    rows = [(i % 40, f"2024-01-01 0{i % 5}:{i % 60:02d}:00", "ab"[i % 2]) for i in range(200)]
    table = spark.createDataFrame(rows, "event_id int, ts string, event_type string").withColumn("ts", F.to_timestamp("ts"))
    table.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(table.schema).parquet(f"{tmp_path}/in")
    events.run_available(events.first_of_key(stream, "event_id", "ts", "10 hours"), f"{tmp_path}/first", f"{tmp_path}/c1")
    assert spark.read.parquet(f"{tmp_path}/first").count() == 40
    query = events.window_counts(stream, "ts", ["event_type"]).writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    want = sorted(map(tuple, events.window_counts(table, "ts", ["event_type"]).collect()))
    assert sorted(map(tuple, spark.table("counts").collect())) == want
    assert events.sessions(table, "ts", ["event_type"]).agg(F.sum("n")).first()[0] == 200
    for part in range(2):
        events.merge_edges(spark.createDataFrame([("a", "b", 1.5, 2, 1)], "source string, target string, weight double, cooccurrences int, episodes int"), f"{tmp_path}/edges")
    assert tuple(events.merged_edges(spark.read.parquet(f"{tmp_path}/edges")).first()) == ("a", "b", 3.0, 4, 2)
