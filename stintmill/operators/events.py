"""Ordered event logs: which free throws end a possession, and the coefficient that follows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LOOK_AHEAD = 4
CONVENTIONAL = 0.44


class UnknownLabels(ValueError):
    """Free-throw labels that are neither technical nor ``k of n``."""


def unknown_labels(pbp: DataFrame) -> DataFrame:
    """Distinct free-throw labels that cannot be classified."""
    t = F.col("type_text")
    return pbp.where(t.startswith("Free Throw") & ~t.contains("Technical") & ~t.rlike(r"\d+ of \d+$")).select("type_text").distinct()


def classify_free_throws(pbp: DataFrame, check: bool = False) -> DataFrame:
    """pbp plus is_free_throw, is_last_of_trip and ends_possession (null where it cannot be told).

    A technical, flagrant, clear-path or one-shot trip leaves the ball where it was. The last shot
    of any other trip ends the possession when made; when missed, the first rebound among the next
    four events of the game tells, and a new shot before it closes the search. One window gives
    all look-aheads. With ``check``, unknown labels raise, with five examples.
    """
    if check and (odd := [r.type_text for r in unknown_labels(pbp).orderBy("type_text").limit(5).collect()]):
        raise UnknownLabels(f"free-throw labels that are not understood: {odd}")
    t = F.coalesce("type_text", F.lit(""))
    throw = t.startswith("Free Throw")
    technical = throw & t.contains("Technical")
    keeps = throw & (t.contains("Flagrant") | t.contains("Clear Path"))
    place = F.expr("try_cast(nullif(regexp_extract(type_text, '([0-9]+) of ([0-9]+)$', 1), '') as int)")
    size = F.expr("try_cast(nullif(regexp_extract(type_text, '([0-9]+) of ([0-9]+)$', 2), '') as int)")
    rows = pbp.withColumns({"_technical": technical, "_keeps": keeps, "_place": place, "_size": size, "is_free_throw": throw})
    last = F.col("is_free_throw") & (F.col("_technical") | F.coalesce(F.col("_place") == F.col("_size"), F.lit(False)))
    rows = rows.withColumn("is_last_of_trip", last)
    ahead = Window.partitionBy("game_id").orderBy("game_play_number")
    told = F.lit(None).cast("boolean")
    for k in range(LOOK_AHEAD, 0, -1):
        label, shot = F.lead("type_text", k).over(ahead), F.lead("shooting_play", k).over(ahead)
        told = (
            F.when(label == "Defensive Rebound", F.lit(True))
            .when(label == "Offensive Rebound", F.lit(False))
            .when(F.coalesce(shot, F.lit(False)), F.lit(None).cast("boolean"))
            .otherwise(told)
        )
    rows = rows.withColumn("_told", told)
    plain = ~(F.col("_technical") | F.col("_keeps") | F.coalesce(F.col("_size") == 1, F.lit(False)))
    ends = F.when(
        F.col("is_last_of_trip"),
        F.when(~plain, F.lit(False)).when(F.coalesce("scoring_play", F.lit(False)), F.lit(True)).otherwise(F.col("_told")),
    )
    return rows.withColumn("ends_possession", ends).drop("_technical", "_keeps", "_place", "_size", "_told")


def coefficients(classified: DataFrame, by: str = "season") -> DataFrame:
    """Possessions ended per free-throw attempt, by season; attempts without an answer are left out."""
    count = lambda c: F.count(F.when(c, 1))
    open_ = F.col("is_last_of_trip") & F.col("ends_possession").isNull()
    return (
        classified.groupBy(by)
        .agg(
            count(F.col("is_free_throw")).alias("total_attempts"),
            count(open_).alias("unresolved"),
            count(F.col("is_last_of_trip") & F.coalesce("ends_possession", F.lit(False))).alias("ending_trips"),
        )
        .withColumn("attempts", F.col("total_attempts") - F.col("unresolved"))
        .withColumn("coefficient", F.try_divide("ending_trips", "attempts"))
        .withColumn("difference", F.col("coefficient") - CONVENTIONAL)
    )


def coefficient_summary(by_season: DataFrame) -> DataFrame:
    """Least, greatest, spread and mean of the seasons' coefficients."""
    return by_season.agg(
        F.min("coefficient").alias("least"),
        F.max("coefficient").alias("greatest"),
        (F.max("coefficient") - F.min("coefficient")).alias("spread"),
        F.avg("coefficient").alias("mean"),
        F.count("coefficient").alias("seasons"),
    )


def number_events(possessions: DataFrame) -> DataFrame:
    """``event_order`` from 0 by (period, event_num) within a game, where the feed gives none."""
    order = Window.partitionBy("game_id").orderBy("period", "event_num")
    numbered = F.row_number().over(order).cast("long") - 1
    given = F.col("event_order") if "event_order" in possessions.columns else F.lit(None).cast("long")
    return possessions.withColumn("event_order", F.coalesce(given, numbered))
