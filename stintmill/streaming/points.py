"""Points and possessions as they come in, by window of event time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_points(possessions: DataFrame, every: str = "1 hour", late: str = "10 minutes", time: str = "ts") -> DataFrame:
    """Possessions and points by window and offensive team; a window is final once ``late`` has passed.

    possessions: a stream of possession rows with an event time. State is one row a window and team.
    """
    return (
        possessions.withWatermark(time, late)
        .groupBy(F.window(time, every).alias("span"), "offense_team_id")
        .agg(F.count("*").alias("possessions"), F.sum("points").alias("points"))
        .select(F.col("span.start").alias("start"), F.col("span.end").alias("end"), "offense_team_id", "possessions", "points")
    )


def append_to(stream: DataFrame, path: str, checkpoint: str):
    """Write final windows to Parquet, all that has arrived, then stop; exactly once by the checkpoint."""
    return stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).option("path", path).trigger(availableNow=True).start()
