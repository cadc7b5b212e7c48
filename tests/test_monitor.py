"""The stream monitor over files that arrive one by one, against the batch chart's limits."""

from pyspark.sql import functions as F

from statloom.operators import series
from statloom.streaming.monitor import monitor


def test_points_outside_the_limits(spark, tmp_path):
    rows = [(f"2024-03-0{1 + i // 24} {i % 24:02d}:{m:02d}:00", tool, 10.0 + (i * 7 + m) % 5 + (30.0 if tool == "B" and i == 40 else 0.0)) for tool in "AB" for i in range(60) for m in (5, 35)]
    df = spark.createDataFrame(rows, "ts string, tool string, value double").withColumn("ts", F.to_timestamp("ts"))
    past = df.where("ts < '2024-03-02'").withColumn("h", F.date_trunc("hour", "ts"))
    limits = series.spc_limits(series.series(past, "h", "value", ["tool"]), ["tool"])
    source = str(tmp_path / "in")
    for day in ("2024-03-01", "2024-03-02", "2024-03-03"):
        df.where(F.to_date("ts") == day).coalesce(1).write.mode("append").parquet(source)
    late = [("2024-03-01 00:10:00", "A", 1e6)]  # two days behind the watermark: dropped
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(source)
    found = monitor(stream, limits, "tool", "ts", "value")
    query = found.writeStream.format("memory").queryName("monitored").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).start()
    query.processAllAvailable()
    spark.createDataFrame(late, "ts string, tool string, value double").withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.mode("append").parquet(source)
    query.processAllAvailable()
    query.stop()
    got = spark.table("monitored").collect()
    assert len(got) > 100 and max(r["v"] for r in got) < 1e5
    assert [(r["tool"], str(r["start"])) for r in got if r["outside"]] == [("B", "2024-03-02 16:00:00")]
    want = {(r["tool"], r["h"]): r["v"] for r in df.groupBy("tool", F.date_trunc("hour", "ts").alias("h")).agg(F.avg("value").alias("v")).collect()}
    assert all(abs(want[r["tool"], r["start"]] - r["v"]) < 1e-9 for r in got)
