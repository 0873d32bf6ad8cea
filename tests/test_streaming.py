import datetime

from folioscope.streaming.arrivals import arrivals_per_window, read_arrivals


def test_late_and_repeated_records(spark, tmp_path):
    day = lambda d, h=0: datetime.datetime(2025, 1, d, h)
    schema = "eid string, source string, loaded_at timestamp"
    batches = [[("a", "X", day(1)), ("b", "X", day(1, 5)), ("c", None, day(1)), (None, "X", day(1))], [("a", "X", day(1)), ("d", "X", day(2)), ("e", "Y", None)], [("f", "X", day(1, 9))]]
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = arrivals_per_window(read_arrivals(spark, str(tmp_path / "in"), schema), "source")
    query = stream.writeStream.outputMode("complete").format("memory").queryName("arrivals").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    assert query.awaitTermination(90)
    found = {(r.window_start.day, r.source): r.records for r in spark.table("arrivals").collect()}
    assert found == {(1, "X"): 3, (1, None): 1, (2, "X"): 1}
