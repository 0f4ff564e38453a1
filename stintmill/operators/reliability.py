"""How repeatable a metric is: split halves over many draws."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, GroupedData, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, ByteType, StructType

from ..functions.hashing import Md5
from ..functions.stats import reliability_at
from .box import COUNTS, counts_of, long_metrics, metric_arrays, metrics

SEED = 20260910
ROW_KEY = ("game_id", "line", "part", "minutes", "points")


def assign_halves(rows: DataFrame, rule: str = "random", draws: int = 1, seed: int = SEED, row_key: tuple[str, ...] = ROW_KEY) -> DataFrame:
    """Each row once a draw, with half 0 or 1; a person's halves differ by at most one row.

    "random" orders a person's rows by a seeded hash, "odd_even" by date; the rank's parity is the half. Rows are shuffled once
    and not once a draw: a row gets its halves of all draws as one array, which is spread afterwards.
    """
    if rule != "random":
        order = Window.partitionBy("season", "athlete_id").orderBy("game_date", *row_key)
        return rows.withColumn("draw", F.lit(1)).withColumn("half", F.pmod(F.row_number().over(order), F.lit(2)).cast("int"))
    columns, each = rows.columns, rows.withColumn("_tail", _tail(row_key))
    people = each.groupBy("season", "athlete_id").agg(F.collect_list(F.struct(*each.columns)).alias("rows"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, values, starts in _slices(batches, draws):
            half = _halves(values.field("_tail"), starts, draws, seed)
            ends = pa.array(np.arange(0, half.size + 1, draws, dtype=np.int32))
            dealt = pa.ListArray.from_arrays(ends, pa.array(half.T.reshape(-1).view(np.int8)))
            yield pa.RecordBatch.from_arrays([*(values.field(c) for c in columns), dealt], [*columns, "_halves"])

    dealt = people.mapInArrow(run, StructType([*rows.schema.fields]).add("_halves", ArrayType(ByteType())))
    return dealt.select(*columns, F.posexplode("_halves").alias("_d", "half")).select(*columns, (F.col("_d") + 1).alias("draw"), F.col("half").cast("int").alias("half"))


def _tail(row_key: tuple[str, ...]):
    """What is hashed of a row after the seed and the draw, as ``seeded`` has it."""
    return F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("athlete_id", *row_key)])


def _slices(batches: Iterator[pa.RecordBatch], draws: int, cells: int = 1 << 22) -> Iterator[tuple[pa.RecordBatch, pa.StructArray, np.ndarray]]:
    """(people, their rows, where each person's rows start and the last ones end) of column ``rows``: whole people, about ``cells`` rows x draws at once."""
    most = max(1, cells // draws)
    for batch in batches:
        lists = batch.column("rows")
        ends = lists.offsets.to_numpy().astype(np.int64)
        first = 0
        while first < len(ends) - 1:
            last = max(first + 1, int(np.searchsorted(ends, ends[first] + most, "right")) - 1)
            yield batch.slice(first, last - first), lists.values[ends[first] : ends[last]], ends[first : last + 1] - ends[first]
            first = last


def _halves(tails: pa.Array, starts: np.ndarray, draws: int, seed: int) -> np.ndarray:
    """(draws, rows) of 0 and 1: the parity of a row's place among its person's rows, from 1, in the order of the seeded hash."""
    size = np.diff(starts)
    person = np.repeat(np.arange(len(size), dtype=np.uint64), size)
    parity = ((np.arange(starts[-1]) - np.repeat(starts[:-1], size) + 1) % 2).astype(np.uint8)
    bits = np.uint64(max(1, len(size).bit_length()))
    high_person = person << (np.uint64(64) - bits)
    hashed = Md5([t.encode() for t in tails.to_pylist()])
    out = np.empty((draws, len(person)), np.uint8)
    for d in range(draws):
        high, low = hashed.of(f"{seed}|{d + 1}|".encode())
        key = high_person | (high >> bits)
        order = np.argsort(key)
        ordered = key[order]
        if (ordered[1:] == ordered[:-1]).any():  # the bits that fit do not tell all rows apart
            order = np.lexsort((low, high, person))
        out[d, order] = parity
    return out


def measured(rows: DataFrame, floor: float = 500.0) -> DataFrame:
    """Rows of people with enough minutes over the whole season."""
    enough = rows.groupBy("season", "athlete_id").agg(F.sum("minutes").alias("_m")).where(F.col("_m") >= floor)
    return rows.join(enough.drop("_m"), ["season", "athlete_id"], "left_semi")


def half_totals(halved: DataFrame) -> DataFrame:
    have = [c for c in COUNTS if c in halved.columns]
    return halved.groupBy("season", "draw", "athlete_id", "half").agg(*[F.sum(c).alias(c) for c in have], F.countDistinct("game_id").alias("games"))


def drawn_totals(rows: DataFrame, draws: int, seed: int = SEED, row_key: tuple[str, ...] = ROW_KEY, rule: str = "random") -> DataFrame:
    """What ``half_totals`` says of ``assign_halves``, both halves in one row: (season, athlete_id, draw, a, b), a and b with the totals of half 0 and 1.

    A person's rows of a season are read once for all draws, so rows are not repeated by draws: a row holds a person's season, some
    hundred rows, and its totals are one product of the draws' halves and the counts.
    """
    have = [c for c in COUNTS if c in rows.columns]
    names = [*have, "games"]
    side = lambda s: F.when(F.col(f"{s}_any"), F.struct(*[F.col(f"{s}_{c}").alias(c) for c in names])).alias(s)
    return _flat_totals(rows, draws, seed, row_key, rule, have).select("season", "athlete_id", "draw", side("a"), side("b"))


def _flat_totals(rows: DataFrame, draws: int, seed: int, row_key: tuple[str, ...], rule: str, have: list[str]) -> DataFrame:
    """``drawn_totals`` of the counts ``have``, a column a half and count, and whether a half has a row (a_any, b_any)."""
    names = [*have, "games"]
    counts = [F.col(c).cast("double").alias(f"v_{c}") for c in have]
    game = F.col("game_id").cast("string").alias("game")
    if rule == "random":
        held = F.collect_list(F.struct(_tail(row_key).alias("tail"), game, *counts))
    else:  # in order of date; there is one such order
        draws, held = 1, F.sort_array(F.collect_list(F.struct("game_date", *row_key, game, *counts)))
    people = rows.groupBy("season", "athlete_id").agg(held.alias("rows"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, values, starts in _slices(batches, draws):
            size = np.diff(starts)
            if rule == "random":
                half = _halves(values.field("tail"), starts, draws, seed)
            else:
                half = ((np.arange(starts[-1]) - np.repeat(starts[:-1], size) + 1) % 2).astype(np.uint8)[None, :]
            v = np.stack([values.field(f"v_{c}").to_numpy(zero_copy_only=False) for c in have], axis=1)
            totals = _half_sums(half, v, starts)
            games = _half_games(half, values.field("game"), starts)
            who = pa.array(np.repeat(np.arange(len(size)), draws))
            out = [batch.column("season").take(who), batch.column("athlete_id").take(who), pa.array(np.tile(np.arange(1, draws + 1, dtype=np.int32), len(size)))]
            for side in (0, 1):
                out += [pa.array(np.ascontiguousarray(totals[side][:, :, k]).reshape(-1), from_pandas=True) for k in range(len(have))]
                out += [pa.array(games[side].T.reshape(-1)), pa.array((np.repeat(size, draws) > 1 - side))]
            yield pa.RecordBatch.from_arrays(out, columns)

    columns = ["season", "athlete_id", "draw", *[f"{s}_{c}" for s in "ab" for c in (*names, "any")]]
    kinds = {"season": "long", "athlete_id": "long", "draw": "int"}
    kind = lambda c: kinds.get(c) or ("long" if c.endswith("_games") else "boolean" if c.endswith("_any") else "double")
    typed = people.select(F.col("season").cast("long").alias("season"), F.col("athlete_id").cast("long").alias("athlete_id"), "rows")
    return typed.mapInArrow(run, ", ".join(f"{c} {kind(c)}" for c in columns))


def _half_sums(half: np.ndarray, values: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(people, draws, counts) of half 0 and of half 1: sums of the known values, not a number where none is."""
    seen = ~np.isnan(values)
    known, second = np.where(seen, values, 0.0), half.astype(float)
    out = tuple(np.empty((len(starts) - 1, len(half), values.shape[1])) for _ in (0, 1))
    for k in range(len(starts) - 1):
        own = slice(starts[k], starts[k + 1])
        for side, part in enumerate((1 - second[:, own], second[:, own])):
            out[side][k] = part @ known[own]
            if not seen[own].all():
                out[side][k][part @ seen[own] == 0] = np.nan
            elif starts[k + 1] - starts[k] < 2:
                out[side][k][part.sum(axis=1) == 0] = np.nan
    return out


def _half_games(half: np.ndarray, games: pa.Array, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(draws, people) of half 0 and of half 1: how many games a half has rows of; an unknown game is none."""
    code = games.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
    person = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    order = np.lexsort((code, person))
    code, dealt = code[order], half[:, order]  # people stay where they are
    fresh = np.append(True, (code[1:] != code[:-1]) | (person[1:] != person[:-1]))
    at = np.flatnonzero(fresh)
    known = (code[at] >= 0).astype(np.int64)
    of_person = np.searchsorted(at, starts[:-1])
    second, first = np.maximum.reduceat(dealt, at, axis=1), 1 - np.minimum.reduceat(dealt, at, axis=1)
    return tuple(np.add.reduceat(side * known, of_person, axis=1) for side in (first, second))


def _pair_totals(rows: DataFrame, rule: str, draws: int, names: tuple[str, ...], seed: int) -> DataFrame:
    """Totals of both halves, of people with a row in each, of the counts that the metrics ``names`` are made of."""
    return _flat_totals(rows, draws, seed, ROW_KEY, rule, list(counts_of(names))).where("a_any and b_any").drop("a_any", "b_any")


def _sides(totals: pa.Table | pa.RecordBatch, names: tuple[str, ...], have: tuple[str, ...]) -> list[list[np.ndarray]]:
    """The metrics of half 0 and of half 1: arithmetic on whole columns, which took a third of the time of conditional shares in the JVM."""
    return [metric_arrays({c: np.asarray(totals.column(f"{s}_{c}")) for c in have}, names) for s in "ab"]


def pairs_of(rows: DataFrame, rule: str, draws: int, names: tuple[str, ...], seed: int = SEED) -> DataFrame:
    """(season, draw, athlete_id, games, first, second): arrays of both halves' metrics, of all draws by a rule: random halves, or by date."""
    have = counts_of(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ends = pa.array(np.arange(0, b.num_rows * len(names) + 1, len(names), dtype=np.int32))
            sides = [pa.ListArray.from_arrays(ends, pa.array(np.stack(v, axis=1).reshape(-1), from_pandas=True)) for v in _sides(b, names, have)]
            games = (np.asarray(b.column("a_games")) + np.asarray(b.column("b_games"))) / 2
            yield pa.RecordBatch.from_arrays([b.column("season"), b.column("draw"), b.column("athlete_id"), pa.array(games), *sides], ["season", "draw", "athlete_id", "games", "first", "second"])

    kinds = "season long, draw int, athlete_id long, games double, first array<double>, second array<double>"
    return _pair_totals(rows, rule, draws, names, seed).mapInArrow(run, kinds)


def _ranks(x: np.ndarray) -> np.ndarray:
    """Ranks with ties at the mean of their places."""
    order = np.argsort(x)
    fresh = np.flatnonzero(np.append(True, np.diff(x[order]) != 0))
    upto = np.append(fresh[1:], len(x))
    out = np.empty(len(x))
    out[order] = np.repeat((fresh + upto + 1) / 2, upto - fresh)
    return out


def _corr(x: np.ndarray, y: np.ndarray) -> float:
    """Correlation; not a number where one side does not vary, as Spark's has it."""
    if x.min() == x.max() or y.min() == y.max():
        return np.nan
    x, y = x - x.mean(), y - y.mean()
    return float(x @ y / np.sqrt((x @ x) * (y @ y)))


def _correlated(grouped: GroupedData, names: tuple[str, ...], least: int, sides: Callable[[pa.Table], tuple[np.ndarray, list, list]]) -> DataFrame:
    """Pearson and Spearman of the halves in each group of a season and draw; ``sides``: its games and both halves' metrics."""

    def run(group: pa.Table) -> pa.Table:
        out, (games, first, second) = [], sides(group)
        for name, x, y in zip(names, first, second, strict=True):
            both = ~(np.isnan(x) | np.isnan(y))
            n = int(both.sum())
            if n >= least:
                x, y = x[both], y[both]
                out.append((name, _corr(x, y), float(games[both].mean()), n, _corr(_ranks(x), _ranks(y))))
        key = (group["season"][0].as_py(), group["draw"][0].as_py())
        columns = list(zip(*[(*key, *r) for r in out], strict=True)) or [()] * len(kinds)
        return pa.table({n: pa.array(v, kinds[n]) for n, v in zip(kinds, columns, strict=True)})

    kinds = {"season": pa.int64(), "draw": pa.int32(), "metric": pa.string(), "rho": pa.float64(), "games_per_half": pa.float64(), "players": pa.int64(), "spearman": pa.float64()}
    return grouped.applyInArrow(run, "season long, draw int, metric string, rho double, games_per_half double, players long, spearman double")


def draw_correlations(pairs: DataFrame, names: tuple[str, ...], least: int = 3) -> DataFrame:
    """Pearson and Spearman of the halves for each season, draw and metric with enough people.

    A task takes one draw of one season, a row a person, and ranks its metrics one after the other.
    """
    flat = pairs.select("season", "draw", "games", *[F.get(side, F.lit(k)).alias(f"{side}{k}") for side in ("first", "second") for k in range(len(names))])
    sides = lambda g: (g["games"].to_numpy(), *[[g[f"{side}{k}"].to_numpy() for k in range(len(names))] for side in ("first", "second")])
    return _correlated(flat.groupBy("season", "draw"), names, least, sides)


def drawn_correlations(rows: DataFrame, rule: str, draws: int, names: tuple[str, ...], seed: int = SEED, least: int = 3) -> DataFrame:
    """``draw_correlations`` of ``pairs_of``: totals, small whole numbers, are shuffled, and a draw's task takes the metrics of them."""
    have = counts_of(names)
    totals = _pair_totals(rows, rule, draws, names, seed).drop("athlete_id")
    sides = lambda g: ((g["a_games"].to_numpy() + g["b_games"].to_numpy()) / 2, *_sides(g, names, have))
    return _correlated(totals.groupBy("season", "draw"), names, least, sides)


def traded_share(rows: DataFrame) -> DataFrame:
    """Share of people with more than one team, by season."""
    teams = rows.groupBy("season", "athlete_id").agg(F.countDistinct("team_id").alias("t"))
    return teams.groupBy("season").agg(F.avg((F.col("t") > 1).cast("double")).alias("traded_share"))


def summarise_draws(correlations: DataFrame) -> DataFrame:
    """Across draws: mean and sd of rho (0 for one draw), mean Spearman and games, whole mean players."""
    out = correlations.groupBy("season", "metric").agg(
        F.avg("rho").alias("rho_half"),
        F.coalesce(F.stddev_samp("rho"), F.lit(0.0)).alias("rho_half_sd"),
        F.avg("spearman").alias("rho_half_spearman"),
        F.avg("games_per_half").alias("games_per_half"),
        F.floor(F.avg("players")).alias("players"),
        F.count("rho").alias("draws_used"),
    )
    return out.withColumn("reliability_at_observed_length", reliability_at(F.col("rho_half"), 2 * F.col("games_per_half"), F.col("games_per_half"))).withColumn(
        "reliability_at_82_games", reliability_at(F.col("rho_half"), 82.0, F.col("games_per_half"))
    )


def measure(rows: DataFrame, rule: str = "random", draws: int = 20, floor: float = 500.0, names: tuple[str, ...] | None = None, seed: int = SEED) -> DataFrame:
    """The season table: every metric's repeatability; all metrics share the draws."""
    names = names or tuple(m.name for m in metrics())
    used = measured(rows, floor)
    out = summarise_draws(drawn_correlations(used, rule, draws, names, seed))
    return out.join(traded_share(used), "season").withColumn("rule", F.lit(rule))


def split_half(rows: DataFrame, metric: str, rule: str = "random", draws: int = 20, floor: float = 500.0, seed: int = SEED) -> DataFrame:
    """One metric's repeatability by season; a ValueError where no draw of any season leaves it defined."""
    if metric not in {m.name for m in metrics()}:
        raise ValueError(f"no metric {metric!r}")
    table = measure(rows, rule, draws, floor, (metric,), seed).where("draws_used > 0")
    if table.isEmpty():
        raise ValueError(f"too few people have {metric} in both halves over {floor:g} minutes")
    return table


def curve(rows: DataFrame, metric: str, floors: tuple[float, ...] = (200.0, 500.0, 1000.0, 1500.0), draws: int = 10, seed: int = SEED) -> DataFrame:
    """One metric at nested minute floors; floors with too few people are left out.

    A person's halves do not depend on the floor, so they are dealt once and each floor selects people.
    """
    minutes = rows.groupBy("season", "athlete_id").agg(F.sum("minutes").alias("_m"))
    used = measured(rows, min(floors))
    pairs = pairs_of(used, "random", draws, (metric,), seed).select("season", "draw", "athlete_id", "games", F.get("first", F.lit(0)).alias("first"), F.get("second", F.lit(0)).alias("second"))
    pairs = pairs.where("first is not null and second is not null").join(minutes, ["season", "athlete_id"])
    each = pairs.withColumn("floor", F.explode(F.array(*[F.lit(float(f)) for f in floors]))).where("_m >= floor")
    by = ("season", "draw", "floor")
    drawn = each.groupBy(*by).agg(F.corr("first", "second").alias("rho"), F.avg("games").alias("games_per_half"), F.count("*").alias("players")).where("players >= 3")
    return drawn.groupBy("season", "floor").agg(F.avg("rho").alias("rho_half"), F.avg("games_per_half").alias("games_per_half"), F.floor(F.avg("players")).alias("players"))


def pooled_reliability(tables: DataFrame, rating: float = 0.796) -> DataFrame:
    """Mean over seasons of each metric's reliability at 82 games for random halves, and the rating's own."""
    own = tables.where("rule = 'random'").groupBy("metric").agg(F.avg("reliability_at_82_games").alias("reliability"))
    return own.unionByName(own.sparkSession.createDataFrame([("rating", rating)], "metric string, reliability double"))


def validity_profile(wide: DataFrame, rating: str, names: tuple[str, ...], reliability: DataFrame) -> DataFrame:
    """Each metric's correlation with the rating beside its reliability, and the correlation of the two."""
    each = long_metrics(wide, (rating,), names).groupBy("metric").agg(F.corr("value", rating).alias("validity"))
    both = each.join(reliability, "metric")
    return both.join(both.agg(F.corr("reliability", F.abs("validity")).alias("profile")))


def rule_differences(tables: DataFrame) -> DataFrame:
    """Mean and greatest absolute difference of rho between the two rules, over metrics and seasons."""
    sides = tables.groupBy("season", "metric").agg(
        F.max(F.when(F.col("rule") == "random", F.col("rho_half"))).alias("a"), F.max(F.when(F.col("rule") == "odd_even", F.col("rho_half"))).alias("b")
    )
    gap = F.abs(F.col("a") - F.col("b"))
    return sides.agg(F.avg(gap).alias("mean_difference"), F.max(gap).alias("greatest_difference"), F.count(gap).alias("compared"))
