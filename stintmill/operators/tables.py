"""Files in and out, lookups, and the queries that serve the published tables."""

from __future__ import annotations

import re
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

POOLED_COEFFICIENT = 0.4178
SCHEDULE_JSON = "lscd array<struct<mscd: struct<g: array<struct<gid: string>>>>>"
GAME_JSON = "g struct<gid: string, pd: array<struct<p: int>>>"
EXTERNAL_CSV = "game_id string, home_lineup string, away_lineup string, n_pos bigint, home_points bigint, away_points bigint"


def season_scan(spark: SparkSession, root: str, dataset: str, seasons: list[int], columns: list[str] | None = None) -> tuple[DataFrame | None, list[int]]:
    """(rows of the seasons that are there, seasons that are not): absent is reported, not empty.

    Files lie at root/dataset/season=YYYY, so a season is a partition and pruned at planning.
    """
    found = spark.read.parquet(f"{root}/{dataset}")
    have = {r.season for r in found.where(F.col("season").isin(seasons)).select("season").distinct().collect()}  # of the asked partitions alone
    asked = [s for s in seasons if s in have]
    rows = found.where(F.col("season").isin(asked)) if asked else None
    return (rows.select(*columns) if rows is not None and columns else rows), [s for s in seasons if s not in have]


def master_scan(spark: SparkSession, path: str, season: int) -> DataFrame | None:
    """One season of a table that holds them all; None when it has no rows."""
    rows = spark.read.parquet(path).where(F.col("season") == season)
    return None if rows.isEmpty() else rows


def read_external_stints(spark: SparkSession, path: str) -> DataFrame:
    """Foreign stints from CSV: the game id stays a string; a missing column raises."""
    head = spark.read.csv(path, header=True).columns
    missing = [c.split()[0] for c in EXTERNAL_CSV.split(", ") if c.split()[0] not in head]
    if missing:
        raise ValueError(f"external stints lack columns: {missing}")
    return spark.read.csv(path, header=True).select(*[F.col(c.split()[0]).cast(c.split()[1]) for c in EXTERNAL_CSV.split(", ")])


def schedule_games(payloads: DataFrame, regular_only: bool = True) -> DataFrame:
    """Game ids of schedule payloads (column ``json``), regular season ones start with 002."""
    ids = payloads.select(F.from_json("json", SCHEDULE_JSON).alias("s")).select(F.explode("s.lscd").alias("m")).select(F.explode("m.mscd.g").alias("g")).select(F.col("g.gid").alias("game_id"))
    return (ids.where(F.col("game_id").startswith("002")) if regular_only else ids).distinct()


def payload_validity(payloads: DataFrame) -> DataFrame:
    """payloads (name, json) plus whether each is a game with events, and whether a schedule with months."""
    game, schedule = F.from_json("json", GAME_JSON), F.from_json("json", SCHEDULE_JSON)
    return payloads.select(
        "name",
        F.coalesce(F.size(game["g"]["pd"]) > 0, F.lit(False)).alias("valid_game"),
        F.coalesce(F.size(schedule["lscd"]) > 0, F.lit(False)).alias("valid_schedule"),
    )


def landed_files(spark: SparkSession, pattern: str) -> DataFrame:
    """(file, rows, usable) of the Parquet files under a pattern; unreadable ones have no rows."""
    listed = spark.read.format("binaryFile").load(pattern).select(F.col("path").alias("file"))
    # rows are counted without any column, so no file's schema is asked for
    rows = spark.read.schema("_none string").option("ignoreCorruptFiles", True).parquet(pattern).groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count("*").alias("rows"))
    bare = lambda df: df.withColumn("file", F.regexp_replace("file", "^file:/+", "/"))
    return bare(listed).join(bare(rows), "file", "left").select("file", F.coalesce("rows", F.lit(0)).alias("rows"), (F.coalesce("rows", F.lit(0)) > 0).alias("usable"))


def write_by_season(rows: DataFrame, path: str) -> None:
    """Write a table by season; only the seasons in it are replaced."""
    write_by(rows, path, "season")


def write_by(rows: DataFrame, path: str, column: str) -> None:
    """Write a table by a column (ratings by ``window_end``, reliability by ``season``); only the values in it are replaced."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(column).parquet(path)


def read_by(spark: SparkSession, path: str, column: str, *values: int) -> DataFrame:
    """A table that ``write_by`` wrote, or some values of its column; a ValueError names those that it lacks."""
    rows = spark.read.parquet(path)
    if not values:
        return rows
    found = {r[0] for r in rows.select(column).where(F.col(column).isin(*values)).distinct().collect()}
    if lacking := sorted(set(values) - found):
        raise ValueError(f"{path} has no {column} {lacking}")
    return rows.where(F.col(column).isin(*values))


def publish(rows: DataFrame, path: str, mismatches: DataFrame | None = None, by: str | None = None) -> str:
    """Publish a table as a new version under path and name it: readers see it whole, or the version before.

    The version is written to a folder of its own. It is published by one more row in the manifest, which is written last and
    only if ``mismatches`` has no row; else a ValueError tells how many there are and the table stays as it was.
    """
    spark = rows.sparkSession
    version = uuid.uuid4().hex
    target = f"{path}/versions/{version}"
    writer = rows.write
    (writer.partitionBy(by) if by else writer).parquet(target)
    if mismatches is not None and (n := mismatches.count()):
        raise ValueError(f"{n} rows do not agree; {path} is left as it was")
    number = max((r.number for r in _manifest(spark, path)), default=0) + 1
    spark.createDataFrame([(number, version)], "number long, version string").coalesce(1).write.mode("append").json(f"{path}/manifest")
    return version


def _manifest(spark: SparkSession, path: str) -> list:
    """The published versions; a row each time a table was published."""
    try:
        return spark.read.schema("number long, version string").json(f"{path}/manifest").collect()
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return []


def published(spark: SparkSession, path: str) -> DataFrame:
    """The version published last."""
    if not (rows := _manifest(spark, path)):
        raise LookupError(f"nothing is published under {path}")
    return spark.read.parquet(f"{path}/versions/{max(rows, key=lambda r: (r.number, r.version)).version}")


def rating_query(ratings: DataFrame, window_end: int | None = None, least_possessions: float = 0.0) -> DataFrame:
    """Published ratings of a window over a possession floor; an unknown window raises with the range."""
    if window_end is not None and ratings.where(F.col("window_end") == window_end).isEmpty():
        span = ratings.agg(F.min("window_end").alias("a"), F.max("window_end").alias("b")).first()
        raise ValueError(f"no window ends in {window_end}; windows end {span.a} to {span.b}")
    rows = ratings.where(F.col("possessions") >= least_possessions)
    return rows if window_end is None else rows.where(F.col("window_end") == window_end)


def reliability_query(reliability: DataFrame, season: int | None = None, rule: str | None = None) -> DataFrame:
    for column, value in (("season", season), ("rule", rule)):
        if value is not None:
            if reliability.where(F.col(column) == value).isEmpty():
                raise ValueError(f"no {column} {value!r}")
            reliability = reliability.where(F.col(column) == value)
    return reliability


def with_coefficient(rows: DataFrame, measured: DataFrame, season: str = "season") -> DataFrame:
    """rows plus the coefficient measured for their season, or the pooled one."""
    known = measured.select(F.col("season").alias("_s"), F.col("coefficient").alias("_c"))
    return rows.join(known, F.col(season) == F.col("_s"), "left").withColumn("coefficient", F.coalesce("_c", F.lit(POOLED_COEFFICIENT))).drop("_s", "_c")


def top_rated(ratings: DataFrame, n: int, by: str = "total") -> DataFrame:
    if not 1 <= n <= 500:
        raise ValueError("the limit is 1 to 500")
    return ratings.orderBy(F.desc(by), "player_id", *[c for c in ("window_end", "player", "seasons_played") if c in ratings.columns]).limit(n)


def history(ratings: DataFrame, player_id: int) -> DataFrame:
    rows = ratings.where(F.col("player_id") == player_id)
    if rows.isEmpty():
        raise LookupError(f"no player {player_id}")
    return rows.orderBy("window_end")


def serving_health(ratings: DataFrame) -> DataFrame:
    return ratings.agg(F.count("*").alias("rows"), F.min("window_end").alias("first_window"), F.max("window_end").alias("last_window"))


def named(ratings: DataFrame) -> DataFrame:
    return ratings.dropna(subset=["player"])


def compare_players(ratings: DataFrame, players: list[str]) -> DataFrame:
    """Windows down, up to five players across, the mean total in each cell."""
    if len(players) > 5:
        raise ValueError("up to five players")
    return ratings.where(F.col("player").isin(players)).groupBy("window_end").pivot("player", players).agg(F.avg("total"))


def axis_labels(ratings: DataFrame) -> DataFrame:
    """A label a row: the player and seasons played, with the window's end where that is not unique."""
    plain = F.concat("player", F.lit(" ("), F.col("seasons_played").cast("string"), F.lit(")"))
    rows = named(ratings).withColumn("label", plain)
    shared = F.count("*").over(Window.partitionBy("label")) > 1
    return rows.withColumn("label", F.when(shared, F.concat("label", F.lit(" to "), F.col("window_end").cast("string"))).otherwise(F.col("label")))


def signed_split(ratings: DataFrame, column: str) -> DataFrame:
    return ratings.withColumn(f"{column}_up", F.greatest(F.col(column), F.lit(0.0))).withColumn(f"{column}_down", F.least(F.col(column), F.lit(0.0)))


def latest_rows(ratings: DataFrame) -> DataFrame:
    """The last window of each player."""
    return ratings.groupBy("player_id").agg(F.max_by(F.struct("window_end", "total", "seasons_played"), F.struct("window_end", "player", "total", "seasons_played")).alias("r")).select("player_id", "r.*")


def partial_windows(ratings: DataFrame, whole: int = 3) -> DataFrame:
    return ratings.agg(F.count(F.when(F.col("seasons_played") < whole, 1)).alias("partial"), F.count("*").alias("rows"))


def season_ranges(seasons: DataFrame, by: tuple[str, ...] = (), season: str = "season") -> DataFrame:
    """Runs of consecutive seasons as ``2002-2005``; one row a run."""
    order = Window.partitionBy(*by).orderBy(season)
    runs = seasons.select(*by, season).distinct().withColumn("_g", F.col(season) - F.row_number().over(order))
    span = runs.groupBy(*by, "_g").agg(F.min(season).alias("first"), F.max(season).alias("last")).drop("_g")
    return span.withColumn("label", F.when(F.col("first") == F.col("last"), F.col("first").cast("string")).otherwise(F.concat_ws("-", "first", "last")))


def parse_seasons(spec: str, low: int = 2002, high: int = 2026) -> list[int]:
    """``2024`` or ``2015-2024``, inside the bounds."""
    m = re.fullmatch(r"(\d{4})(?:-(\d{4}))?", spec.strip())
    if not m:
        raise ValueError(f"{spec!r} is not a season or a range of seasons")
    first, last = int(m[1]), int(m[2] or m[1])
    if first > last or first < low or last > high:
        raise ValueError(f"seasons run from {low} to {high}, first to last")
    return list(range(first, last + 1))


def precision_view(ratings: DataFrame) -> DataFrame:
    return named(ratings).select("player", "window_end", "possessions", "total")


def long_to_wide(long: DataFrame, keys: tuple[str, ...], name: str, value: str, names: list[str]) -> DataFrame:
    """A column a name; repeated cells take their mean."""
    return long.groupBy(*keys).pivot(name, names).agg(F.avg(value))


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


