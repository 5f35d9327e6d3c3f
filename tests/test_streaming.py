from skarn.functions import udf
from skarn.streaming import windows


def test_stream_agrees_with_table(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.repartition(3).write.parquet(f"{tmp_path}/in")
    table = windows.tumbling(events, "ts", "1 day", ["event_type"], "value")
    stream = windows.tumbling(windows.read_stream(spark, f"{tmp_path}/in"), "ts", "1 day", ["event_type"], "value", late="60 days")
    run = stream.writeStream.format("memory").queryName("t_windows").outputMode("complete").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    run.awaitTermination(60)
    assert sorted(map(str, spark.table("t_windows").collect())) == sorted(map(str, table.collect()))


def test_functions(spark):
    spark.range(6).selectExpr("id", "id % 2 AS g").createOrReplaceTempView("t_udf")
    udf.scalar(spark, "twice", lambda v: v * 2, "long")
    udf.aggregate(spark, "spread", lambda v: float(v.max() - v.min()), "double")
    assert [r[0] for r in spark.sql("SELECT twice(id) FROM t_udf ORDER BY id").collect()] == [0, 2, 4, 6, 8, 10]
    assert {tuple(r) for r in spark.sql("SELECT g, spread(id) FROM t_udf GROUP BY g").collect()} == {(0, 4.0), (1, 4.0)}
