"""Distribution drift between two rating windows, and table fingerprints."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.order import quantiles
from ..functions.stats import kolmogorov_p

EPSILON = 1e-6
BINS = 10


def stability_index(reference: DataFrame, comparison: DataFrame, value: str, bins: int = BINS) -> DataFrame:
    """Population stability index over the reference's quantile bins, open at both ends; nulls dropped.

    The edges are exact, found by range counts in rounds; an empty side raises.
    """
    sides = reference.select(F.lit(0).alias("side"), F.col(value).alias("x")).unionByName(comparison.select(F.lit(1).alias("side"), F.col(value).alias("x"))).where("x is not null")
    if sides.where("side = 1").isEmpty():
        raise ValueError("no value to compare")
    edges = sorted(set(quantiles(sides.where("side = 0"), "x", [k / bins for k in range(bins + 1)])))
    # inner edges at or below x; the outer edges are open
    binned = sides.withColumn("bin", sum(((F.col("x") >= e).cast("int") for e in edges[1:-1]), F.lit(0)))
    counted = binned.groupBy("bin").agg(F.count(F.when(F.col("side") == 0, 1)).alias("a"), F.count(F.when(F.col("side") == 1, 1)).alias("b"))
    whole = Window.partitionBy()  # a row a bin
    shares = counted.withColumns({"p": F.col("a") / F.sum("a").over(whole) + EPSILON, "q": F.col("b") / F.sum("b").over(whole) + EPSILON})
    # a bin that neither side has adds nothing: both shares are epsilon
    return shares.agg(F.sum((F.col("q") - F.col("p")) * F.log(F.col("q") / F.col("p"))).alias("psi"), F.sum("a").alias("reference_n"), F.sum("b").alias("comparison_n"))


def ks_statistic(reference: DataFrame, comparison: DataFrame, value: str, parts: int = 64) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov statistic: counts by value, then running sums over the values.

    The values are cut into ranges; a range's sums start from the totals of the ranges before it.
    """
    both = reference.select(F.lit(1).alias("a"), F.lit(0).alias("b"), F.col(value).alias("x")).unionByName(comparison.select(F.lit(0).alias("a"), F.lit(1).alias("b"), F.col(value).alias("x")))
    counted = both.where("x is not null").groupBy("x").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    cuts = counted.agg(F.percentile_approx("x", [k / parts for k in range(1, parts)]).alias("cuts"))
    placed = counted.join(cuts).select("x", "a", "b", F.size(F.filter("cuts", lambda c: c < F.col("x"))).alias("part"))
    before, whole = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    totals = placed.groupBy("part").agg(F.sum("a").alias("ta"), F.sum("b").alias("tb"))
    starts = totals.select("part", *[F.coalesce(F.sum(t).over(before), F.lit(0)).alias(f"s{t}") for t in ("ta", "tb")], *[F.sum(t).over(whole).alias(f"n{t}") for t in ("ta", "tb")])
    up = Window.partitionBy("part").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    share = lambda c: (F.col(f"st{c}") + F.sum(c).over(up)) / F.col(f"nt{c}")
    return placed.join(starts, "part").select(F.abs(share("a") - share("b")).alias("g")).agg(F.max("g").alias("ks"))


def verdict(psi: F.Column) -> F.Column:
    return F.when(psi < 0.10, "stable").when(psi < 0.25, "watch").otherwise("shifted")


def compare_windows(ratings: DataFrame, column: str, reference_end: int | None = None, comparison_end: int | None = None, with_p: bool = False) -> DataFrame:
    """One row: PSI, KS statistic and verdict of a column between two windows, by default first and last."""
    ends = [r.window_end for r in ratings.select("window_end").distinct().orderBy("window_end").collect()]  # one a window
    first, last = (ends[0] if reference_end is None else reference_end), (ends[-1] if comparison_end is None else comparison_end)
    for end in (first, last):
        if end not in ends:
            raise ValueError(f"no window ends in {end}; there are {ends}")
    a, b = ratings.where(F.col("window_end") == first), ratings.where(F.col("window_end") == last)
    out = stability_index(a, b, column).join(ks_statistic(a, b, column))
    out = out.select(F.lit(column).alias("column"), F.lit(first).alias("reference_window"), F.lit(last).alias("comparison_window"), "psi", "ks", "reference_n", "comparison_n", verdict(F.col("psi")).alias("verdict"))
    if with_p:
        p = F.udf(kolmogorov_p, "double")  # one row
        out = out.withColumn("ks_p", p("ks", "reference_n", "comparison_n"))
    return out


def drift_report(ratings: DataFrame, columns: tuple[str, ...] = ("offensive", "defensive", "total"), **windows) -> DataFrame:
    out = None
    for c in columns:
        row = compare_windows(ratings, c, **windows)
        out = row if out is None else out.unionByName(row)
    return out


def render(report: DataFrame) -> str:
    """The report as a Markdown table; a row a column."""
    rows = report.collect()
    head = "| column | windows | PSI | KS | verdict |\n| --- | --- | --- | --- | --- |"
    return "\n".join([head, *[f"| {r.column} | {r.reference_window} to {r.comparison_window} | {r.psi:.4f} | {r.ks:.4f} | {r.verdict} |" for r in rows]])


def fingerprint(frame: DataFrame, columns: tuple[str, ...] | None = None) -> DataFrame:
    """A digest of a table that does not depend on the order of rows or columns, and does on types."""
    kinds = dict(frame.dtypes)
    names = sorted(columns or frame.columns)
    parts = [x for c in names for x in (F.lit(f"{c}:{kinds[c]}"), F.col(c), F.col(c).isNull())]
    one, two = F.xxhash64(*parts), F.xxhash64(F.lit(7), *parts)
    wide = lambda h: F.sum(h.cast("decimal(38,0)"))
    return frame.select(one.alias("a"), two.alias("b")).agg(F.md5(F.concat_ws("|", wide(F.col("a")).cast("string"), wide(F.col("b")).cast("string"), F.count("*").cast("string"))).alias("fingerprint"), F.count("*").alias("rows"))
