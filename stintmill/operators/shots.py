"""What attempts are worth by where they are taken, and what a player scores beyond that."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BIN = (2.0, 2.0)
PRIOR = 20.0  # attempts that a bin's neighbours count for


def _binned(shots: DataFrame, size: tuple[float, float]) -> DataFrame:
    """Attempts and points of each player in each bin; attempts without a place are left out."""
    placed = shots.where("x is not null and y is not null")
    bins = [F.floor(F.col(c) / s).alias(f"bin_{c}") for c, s in zip(("x", "y"), size, strict=True)]
    return placed.groupBy("player_id", *bins).agg(F.count("*").alias("n"), F.sum(F.coalesce("points", F.lit(0))).cast("double").alias("s"))


def location_values(shots: DataFrame, size: tuple[float, float] = BIN, prior: float = PRIOR) -> DataFrame:
    """(bin_x, bin_y, attempts, plain, value): a bin's mean points, and the same drawn towards its neighbours.

    The eight bins around a bin count for ``prior`` attempts of their mean; where they have none the mean of
    all attempts does. A prior of 0 gives the plain means.
    """
    bins = _binned(shots, size).groupBy("bin_x", "bin_y").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    steps = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1) if (i, j) != (0, 0)]
    near = F.explode(F.array(*[F.struct((F.col("bin_x") + i).alias("bin_x"), (F.col("bin_y") + j).alias("bin_y")) for i, j in steps]))
    around = bins.select(near.alias("b"), "n", "s").groupBy("b.bin_x", "b.bin_y").agg(F.sum("n").alias("an"), F.sum("s").alias("as"))
    whole = bins.agg(F.try_divide(F.sum("s"), F.sum("n")).alias("mean"))
    both = bins.join(around, ["bin_x", "bin_y"], "left").join(F.broadcast(whole))  # one row
    towards = F.coalesce(F.try_divide("as", "an"), F.col("mean"))
    return both.select("bin_x", "bin_y", F.col("n").alias("attempts"), (F.col("s") / F.col("n")).alias("plain"), ((F.col("s") + prior * towards) / (F.col("n") + prior)).alias("value"))


def shot_values(shots: DataFrame, size: tuple[float, float] = BIN, prior: float = PRIOR) -> DataFrame:
    """(player_id, attempts, points, expected, above): the mean value of where a player shoots from, and the points an attempt beyond it.

    shots: player_id, x, y, points. A player's attempts of a bin are added before they meet the bin's value, so a
    crowded bin is a row a player.
    """
    own = _binned(shots, size)
    valued = own.join(location_values(shots, size, prior).select("bin_x", "bin_y", "value"), ["bin_x", "bin_y"])
    out = valued.groupBy("player_id").agg(F.sum("n").alias("attempts"), F.sum("s").alias("points"), (F.sum(F.col("n") * F.col("value")) / F.sum("n")).alias("expected"))
    return out.withColumn("above", F.col("points") / F.col("attempts") - F.col("expected"))
