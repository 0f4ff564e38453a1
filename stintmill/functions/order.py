"""Places, running sums and order statistics over a whole table, without a window that one task must hold."""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .staging import written

ROW_BITS = 33  # a row's number inside its partition, as monotonically_increasing_id packs it
FEW = 20_000  # values that may reach the driver


def _ranged(df: DataFrame, order: tuple[Column | str, ...]) -> DataFrame:
    """df in ranges of the order, written, with the range (_part) and the row's number in it (_row)."""
    cols = [F.col(c) if isinstance(c, str) else c for c in order]
    placed = df.withColumns({f"_o{k}": c for k, c in enumerate(cols)})
    names = [f"_o{k}" for k in range(len(cols))]
    held = placed.repartitionByRange(*names).sortWithinPartitions(*names).drop(*names).withColumn("_id", F.monotonically_increasing_id())
    held = written(held, "ranged")
    return held.select(*df.columns, F.shiftright("_id", ROW_BITS).alias("_part"), F.col("_id").bitwiseAND((1 << ROW_BITS) - 1).alias("_row"))


def _before(totals: DataFrame, col: str) -> DataFrame:
    """(_part, _start): sums of the ranges before each; a row a range, so one task is enough."""
    up = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("_part", F.coalesce(F.sum(col).over(up), F.lit(0)).alias("_start"))


def numbered(df: DataFrame, *order: Column | str, name: str = "place") -> DataFrame:
    """df plus its place in the order, from 0. Rows that the order does not tell apart stand in any order.

    Ranges of the order are sorted apart; a range's rows start from the counts of the ranges before it.
    """
    held = _ranged(df, order)
    starts = _before(held.groupBy("_part").agg(F.count("*").alias("n")), "n")
    return held.join(F.broadcast(starts), "_part").withColumn(name, F.col("_start") + F.col("_row")).drop("_part", "_row", "_start")  # a row a range


def tiles(df: DataFrame, k: int, *order: Column | str, name: str = "tile") -> DataFrame:
    """df plus its tile of k nearly equal ones in the order, from 0; the first tiles are the larger ones, as ntile has them."""
    placed = numbered(df, *order, name="_place")
    n = placed.count()
    size, larger = divmod(n, k)
    edge = larger * (size + 1)
    tile = F.when(F.col("_place") < edge, F.floor(F.col("_place") / (size + 1))).otherwise(larger + F.floor((F.col("_place") - edge) / max(size, 1)))
    return placed.withColumn(name, tile.cast("int")).drop("_place")


def running(df: DataFrame, value: str, *order: Column | str, name: str = "before") -> DataFrame:
    """df plus the sum of value over the rows before it in the order."""
    held = _ranged(df, order)
    starts = _before(held.groupBy("_part").agg(F.sum(value).alias("n")), "n")
    up = Window.partitionBy("_part").orderBy("_row").rowsBetween(Window.unboundedPreceding, -1)
    summed = held.join(F.broadcast(starts), "_part").withColumn(name, F.col("_start") + F.coalesce(F.sum(value).over(up), F.lit(0)))
    return summed.drop("_part", "_row", "_start")


def average_ranks(df: DataFrame, value: str, name: str) -> DataFrame:
    """df plus the rank of its value from 1, ties at the mean of their places; null values have none.

    Places are counted over distinct values, so many equal values are one row of the order.
    """
    counts = running(df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("_v")).agg(F.count("*").alias("_n")), "_n", "_v", name="_before")
    return df.join(counts, F.col(value) == F.col("_v"), "left").withColumn(name, F.col("_before") + (F.col("_n") + 1) / 2).drop("_v", "_n", "_before")


def order_statistics(df: DataFrame, value: str, ranks: list[int], cuts: int = 1000, few: int = FEW) -> dict[int, float]:
    """The values at ranks (from 0) of a column without nulls: exact, by range counts in rounds.

    A round cuts the values at a sketch's quantiles, counts what lies in each range and what equals its lower cut,
    and goes on in the ranges that hold a wanted rank, until so few values are left that they are read.
    """
    rows = df.select(F.col(value).cast("double").alias("x"))
    return _selected(rows, sorted(set(ranks)), cuts, few)


def _selected(rows: DataFrame, ranks: list[int], cuts: int, few: int) -> dict[int, float]:
    if not ranks:
        return {}
    ends = rows.agg(F.min("x").alias("low"), F.percentile_approx("x", [k / cuts for k in range(1, cuts)], 10 * cuts).alias("cuts"), F.max("x").alias("high"), F.count("*").alias("n")).first()
    if ends.n <= few:
        values = sorted(r.x for r in rows.collect())
        return {r: values[r] for r in ranks}
    splits = sorted({ends.low, *ends.cuts, ends.high})
    if len(splits) < 3:  # one or two distinct values reach here only as ends
        splits = [ends.low, ends.high] if ends.low < ends.high else [ends.low]
    if len(splits) == 1:
        return {r: splits[0] for r in ranks}
    edges = [*splits, math.inf]
    binned = Bucketizer(splits=edges, inputCol="x", outputCol="bin").transform(rows)
    at = F.element_at(F.array(*map(F.lit, splits)), F.col("bin").cast("int") + 1)
    found = {int(r.bin): (r.n, r.same) for r in binned.groupBy("bin").agg(F.count("*").alias("n"), F.count(F.when(F.col("x") == at, 1)).alias("same")).collect()}
    out, inside, upto = {}, {}, 0
    for k in range(len(splits)):
        n, same = found.get(k, (0, 0))
        for r in ranks:
            if upto <= r < upto + same:
                out[r] = splits[k]
            elif upto + same <= r < upto + n:
                inside.setdefault(k, {})[r - upto - same] = r
        upto += n
    small = {k: w for k, w in inside.items() if found[k][0] - found[k][1] <= few}
    if small:  # read together: at most few a range, and no more ranges than ranks
        held: dict[int, list[float]] = {k: [] for k in small}
        for r in binned.where(F.col("bin").isin(list(map(float, small))) & (F.col("x") != at)).collect():
            held[int(r.bin)].append(r.x)
        for k, w in small.items():
            values = sorted(held[k])
            out |= {r: values[local] for local, r in w.items()}
    for k, w in inside.items():
        if k not in small:
            part = rows.where((F.col("x") > splits[k]) & (F.col("x") < edges[k + 1]))
            got = _selected(part, sorted(w), cuts, few)
            out |= {r: got[local] for local, r in w.items()}
    return out


def quantiles(df: DataFrame, value: str, shares: list[float]) -> list[float]:
    """Exact quantiles, interpolated between the two values beside each place, of the values that are not null."""
    used = df.where(F.col(value).isNotNull())
    n = used.count()
    if not n:
        raise ValueError("no value to take a quantile of")
    places = [s * (n - 1) for s in shares]
    found = order_statistics(used, value, [f(p) for p in places for f in (math.floor, math.ceil)])
    return [found[math.floor(p)] + (found[math.ceil(p)] - found[math.floor(p)]) * (p - math.floor(p)) for p in places]
