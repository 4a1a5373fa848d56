from pyspark.sql import functions as F

from snpweave.streaming import events


def test_blocks_and_counts_of_a_stream(spark, tmp_path):
    source = str(tmp_path / "in")
    rows = [(1, "2024-01-01 00:00:00", "a", 1.0), (1, "2024-01-01 01:00:00", "a", 2.0), (1, "2024-01-01 05:00:00", "b", 3.0), (2, "2024-01-03 00:00:00", "a", 4.0)]
    made = spark.createDataFrame(rows, "user_id long, t string, event_type string, value double").select("user_id", F.col("t").cast("timestamp").alias("ts"), "event_type", "value")
    made.coalesce(1).write.parquet(source)
    stream = events.event_stream(spark, source, made.schema)
    events.append(events.session_blocks(stream), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    got = {(r.user_id, r.n) for r in spark.read.schema("user_id long, first timestamp, last timestamp, n long").parquet(str(tmp_path / "out")).collect()}
    assert got == {(1, 2), (1, 1)}  # the last block is open until the watermark passes it
    events.append(events.running_counts(events.event_stream(spark, source, made.schema)), str(tmp_path / "out2"), str(tmp_path / "state2")).awaitTermination()
    assert spark.read.schema("start timestamp, event_type string, n long, total double").parquet(str(tmp_path / "out2")).agg(F.sum("n")).first()[0] == 3
