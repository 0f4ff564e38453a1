from pyspark.sql import functions as F

from stintmill.streaming.points import append_to, windowed_points


def test_final_windows_are_written_once(spark, tmp_path):
    day = "2024-01-01"
    rows = [(f"{day} 00:10:00", 1, 2), (f"{day} 00:50:00", 1, 3), (f"{day} 01:10:00", 2, 1), (f"{day} 03:00:00", 1, 2)]
    df = spark.createDataFrame(rows, "ts string, offense_team_id long, points long").withColumn("ts", F.to_timestamp("ts"))
    df.write.parquet(f"{tmp_path}/in")
    for _ in range(2):  # a second run finds nothing new
        stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
        append_to(windowed_points(stream), f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination(120)
    got = sorted((r.start.hour, r.offense_team_id, r.possessions, r.points) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == [(0, 1, 2, 5), (1, 2, 1, 1)]
