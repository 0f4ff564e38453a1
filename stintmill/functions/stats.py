"""Column helpers and the tails of the t and Kolmogorov distributions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .order import average_ranks


def spearman_brown(rho: Column, times: Column | float) -> Column:
    """Reliability of a measure ``times`` as long; null where times is not positive."""
    n = times if isinstance(times, Column) else F.lit(float(times))
    return F.when(n > 0, F.try_divide(n * rho, 1 + (n - 1) * rho))


def reliability_at(rho: Column, games: Column | float, games_per_half: Column) -> Column:
    """Reliability at a number of games, capped just under one."""
    n = games if isinstance(games, Column) else F.lit(float(games))
    return F.least(F.lit(0.9999), spearman_brown(rho, F.try_divide(n, games_per_half)))


def with_average_rank(df: DataFrame, value: str, by: tuple[str, ...], name: str) -> DataFrame:
    """Rank with ties at the mean of their places; without ``by``, over ranges of the values and not in one task."""
    if not by:
        return average_ranks(df, value, name)
    order, peers = Window.partitionBy(*by).orderBy(value), Window.partitionBy(*by, value)
    return df.withColumn(name, F.rank().over(order) + (F.count("*").over(peers) - 1) / 2)


def spearman(df: DataFrame, x: str, y: str, by: tuple[str, ...]) -> DataFrame:
    """Rank correlation by group over rows with both values."""
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    ranked = with_average_rank(with_average_rank(both, x, by, "_rx"), y, by, "_ry")
    return ranked.groupBy(*by).agg(F.corr("_rx", "_ry").alias("spearman"), F.count("*").alias("n"))


def seeded(*parts: Column | str, seed: int) -> Column:
    """An md5 that orders rows at random, the same on every run and partitioning."""
    cols = [F.coalesce((F.col(p) if isinstance(p, str) else p).cast("string"), F.lit("")) for p in parts]
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *cols))


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function by Lentz's method."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 300):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + num * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + num / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return h


def incomplete_beta(a: float, b: float, x: float) -> float:
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def t_two_sided(t: float, df: float) -> float:
    """Two-sided p value of Student's t."""
    return incomplete_beta(df / 2, 0.5, df / (df + t * t))


def kolmogorov_p(statistic: float, n: int, m: int) -> float:
    """Asymptotic p value of the two-sample statistic."""
    x = statistic * math.sqrt(n * m / (n + m))
    if x < 0.2:
        return 1.0
    return max(0.0, min(1.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * x * x) for k in range(1, 101))))
