import pytest
from pyspark.sql import functions as F

from stintmill.operators import box, checks, drift, shots, stints, tables


def test_every_violation_is_found_and_extras_pass(spark):
    df = spark.createDataFrame([(1, 2024, 5, 5, "x"), (1, 1900, 6, None, "y"), (None, 2024, 7, 8, "z")], "game_id long, season long, home_id long, away_id long, extra string")
    clean, bad = checks.validate(df.withColumn("game_date", F.lit("2024-01-01")), "schedules")
    found = {(r.column_name, r.rule) for r in bad.collect()}
    assert {("home_id", "distinct_teams"), ("season", "in_range(1946,2100)"), ("away_id", "not_null"), ("game_id", "not_null"), ("game_id", "unique")} == found
    assert "extra" in clean.columns


def test_every_row_of_a_repeated_key_is_a_violation(spark):
    rows = [(7, 2024, 1, 2)] * 500 + [(None, 2024, 1, 2)] * 2 + [(k, 2024, 1, 2) for k in range(100, 150)]
    df = spark.createDataFrame(rows, "game_id long, season long, home_id long, away_id long").withColumn("game_date", F.lit("2024-01-01"))
    clean, bad = checks.validate(df, "schedules")
    assert {(r.value, r["count"]) for r in bad.where("rule = 'unique'").groupBy("value").count().collect()} == {("7", 500), ("", 2)}
    assert clean.count() == len(rows)


def test_people_of_one_name_take_its_least_id_in_every_season(spark):
    rows = [(s, i, "Many") for s in (1, None) for i in range(300, 5, -1)] + [(1, 5, "One"), (1, 300, "Other"), (1, 4, None)]
    df = spark.createDataFrame(rows, "season long, athlete_id long, athlete_display_name string")
    moved = {(r.season, r.athlete_display_name): r.ids for r in box.merge_people(df).where("season = 1").groupBy("season", "athlete_display_name").agg(F.collect_set("athlete_id").alias("ids")).collect()}
    assert moved == {(1, "Many"): [6], (1, "One"): [5], (1, "Other"): [6], (1, None): [4]}
    assert {r.season: r.merged for r in box.merged_ids(df).collect()} == {1: 294, None: 294}


def test_cast_failure_and_missing_column_are_violations(spark):
    df = spark.createDataFrame([("x", "1")], "game_id string, period string")
    found = {(r.column_name, r.rule) for r in checks.validate(df, "play_by_play")[1].collect()}
    assert ("game_id", "type(bigint)") in found
    assert ("type_id", "present") in found


def test_skipped_is_not_passed(spark):
    sched = spark.createDataFrame([], "game_id long, season long, game_date string, home_id long, away_id long")
    pbp = spark.createDataFrame([(1, 1)], "game_id long, period long")
    assert checks.events_in_order(pbp).first().status == "skipped"
    assert checks.dates_in_season(sched).first().status == "skipped"
    assert checks.no_duplicates(pbp, "play_by_play").first().status == "skipped"


def test_coverage_both_ways(spark):
    sched = spark.createDataFrame([(1, True), (2, True), (3, None)], "game_id long, status_type_completed boolean")
    pbp = spark.createDataFrame([(1,), (9,)], "game_id long")
    got = {r.check: (r.status, r.n, r.detail) for r in checks.coverage(sched, pbp).collect()}
    assert got == {"scheduled_without_events": ("failed", 1, "2"), "events_without_schedule": ("failed", 1, "9")}


def test_merge_and_eligibility(spark):
    cols = "season long, season_type int, game_id long, team_id long, athlete_id long, athlete_display_name string, minutes double, did_not_play boolean"
    rows = [(1, 2, g, 1, 7 if g % 2 else 5, "Ann", 10.0, False) for g in range(4)]
    rows += [(1, 2, 0, 1, 9, None, 10.0, None), (1, 2, 0, 2, 8, "Bob", 10.0, False), (1, 3, 9, 1, 5, "Ann", 10.0, False)]
    df = spark.createDataFrame(rows, cols)
    got = box.eligible_rows(df, least_team_games=3).collect()
    assert {r.athlete_id for r in got} == {5}
    assert len(got) == 4


def test_metric_needs_evidence(spark):
    df = spark.createDataFrame([(99.0, 10.0), (100.0, 10.0), (0.0, 1.0)], "minutes double, points double")
    got = [r.points_per_36 for r in box.with_metrics(df, only=("points_per_36",)).collect()]
    assert got == [None, 3.6, None]


def test_season_ranges_and_arguments(spark):
    df = spark.createDataFrame([(s,) for s in (2002, 2003, 2005, 2005)], "season long")
    assert sorted(r.label for r in tables.season_ranges(df).collect()) == ["2002-2003", "2005"]
    assert tables.parse_seasons("2015-2017") == [2015, 2016, 2017]
    for bad in ("2017-2015", "99", "1900"):
        with pytest.raises(ValueError):
            tables.parse_seasons(bad)


def test_season_scan_reports_what_is_absent(spark, tmp_path):
    tables.write_by_season(spark.createDataFrame([(2001, 1), (2002, 2)], "season long, x long"), f"{tmp_path}/raw/box")
    rows, absent = tables.season_scan(spark, f"{tmp_path}/raw", "box", [2002, 2003], ["x"])
    assert [r.x for r in rows.collect()] == [2]
    assert absent == [2003]
    landed = tables.landed_files(spark, f"{tmp_path}/raw/box/*/*.parquet").collect()
    assert sorted((r.rows, r.usable) for r in landed) == [(1, True), (1, True)]


def test_external_csv_keeps_game_ids_as_text(spark, tmp_path):
    (tmp_path / "s.csv").write_text("game_id,home_lineup,away_lineup,n_pos,home_points,away_points\n0022,1_2,3_4,3,1,2\n")
    assert tables.read_external_stints(spark, str(tmp_path / "s.csv")).first().game_id == "0022"
    (tmp_path / "t.csv").write_text("game_id\n1\n")
    with pytest.raises(ValueError, match="n_pos"):
        tables.read_external_stints(spark, str(tmp_path / "t.csv"))


def test_fingerprint_ignores_order_and_sees_types(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "x long, y string")
    one = drift.fingerprint(df).first()[0]
    assert drift.fingerprint(df.orderBy(F.desc("x")).select("y", "x")).first()[0] == one
    assert drift.fingerprint(df.withColumn("x", F.col("x").cast("int"))).first()[0] != one
    assert drift.fingerprint(df.union(df.limit(1))).first()[0] != one


def test_drift_is_zero_on_equal_windows_and_grows(spark):
    rows = [(2001, float(i)) for i in range(200)] + [(2002, float(i)) for i in range(200)] + [(2003, i + 80.0) for i in range(200)]
    df = spark.createDataFrame(rows, "window_end long, total double")
    same = drift.compare_windows(df, "total", 2001, 2002).first()
    moved = drift.compare_windows(df, "total", 2001, 2003, with_p=True).first()
    assert (same.psi, same.ks, same.verdict) == (pytest.approx(0, abs=1e-12), 0.0, "stable")
    assert moved.verdict == "shifted" and moved.ks == pytest.approx(0.4) and moved.ks_p < 1e-6
    with pytest.raises(ValueError, match="2001"):
        drift.compare_windows(df, "total", 1999)


def test_tables_by_a_column_are_replaced_by_value_and_read_back(spark, tmp_path):
    path = str(tmp_path / "ratings")
    rows = spark.createDataFrame([(2001, 1, 1.0), (2002, 1, 2.0)], "window_end int, player_id long, total double")
    tables.write_by(rows, path, "window_end")
    tables.write_by(rows.where("window_end = 2002").withColumn("total", F.lit(5.0)), path, "window_end")
    assert {(r.window_end, r.total) for r in tables.read_by(spark, path, "window_end").collect()} == {(2001, 1.0), (2002, 5.0)}
    assert [r.total for r in tables.read_by(spark, path, "window_end", 2002).collect()] == [5.0]
    with pytest.raises(ValueError):
        tables.read_by(spark, path, "window_end", 1999)


def test_absent_tables_and_columns_are_skipped(spark):
    nothing = checks.validate_season(spark, {})
    assert [r.status for r in nothing.collect()] == ["skipped"] * 7
    sched = spark.createDataFrame([(1, 2024, "2024-01-01", 1, 2), (1, 2024, "2020-01-01", 1, 2)], "game_id long, season long, game_date string, home_id long, away_id long")
    pbp = spark.createDataFrame([(1, 1)], "game_id long, period long")
    text = checks.summary_text(checks.validate_season(spark, {"schedules": sched, "play_by_play": pbp, "player_box": None})).split("\n")
    assert text[0] == "7 checks: 1 passed, 2 failed, 4 skipped" and len(text) == 8
    assert text[1].startswith("  [passed ] schedule_and_events_agree") and "no column play_by_play.home_team_id" in text[2] and "player_box not given" in text[6]


def test_event_log_declares_its_columns(spark):
    columns = checks.SCHEMAS["play_by_play"].columns
    assert len(columns) == 31 and sum(not nullable for _, nullable in columns.values()) == 10


def test_bad_payloads_fail_alone_and_with_a_reason(spark):
    ok = '{"possessions":[{"possession_no":1,"stats":[{"stat_no":0,"stat_key":"OffPoss","stat_value":1,"team_id":1,"opponent_team_id":2,"lineup_id":"a","opponent_lineup_id":"b"}]}]}'
    rows = [
        ("ok", ok), ("cut", ok[:-5]), ("typed", ok.replace('"stat_value":1', '"stat_value":"x"')), ("null", None), ("empty", '{"possessions":[]}'), ("other", '{"x":1}'), ("text", "oops"),
        ("unkeyed", ok.replace('"possession_no":1,', "")), ("twice", ok.replace("[{", "[" + ok[16:-2] + ",{", 1)), ("teamless", ok.replace('"team_id":1,', "")), ("uncounted", ok.replace("OffPoss", "Held")), ("same", ok), ("same", ok),
    ]
    good, bad = stints.season_stints(spark.createDataFrame(rows, "game_id string, json string"))
    assert [(r.game_id, r.possessions) for r in good.collect()] == [("ok", 1.0)]
    assert {r.game_id: r.reason for r in bad.collect()} == {
        "cut": "corrupt", "typed": "corrupt", "null": "corrupt", "text": "corrupt", "empty": "empty", "other": "empty", "unkeyed": "unkeyed", "twice": "unkeyed",
        "teamless": "unattributed", "uncounted": "uncounted", "same": "repeated",
    }
    assert tuple(stints.season_summary(good, bad).first()) == (1, 1, 1.0, 11)


def test_a_mismatch_leaves_the_published_table(spark, tmp_path):
    path = str(tmp_path / "tenure")
    old = spark.createDataFrame([(1, 2000, 5.0)], "player_id long, window_end long, possessions double")
    new = spark.createDataFrame([(1, 2000, 6.0)], "player_id long, window_end long, possessions double")
    with pytest.raises(LookupError):
        tables.published(spark, path)
    tables.publish(old, path, stints.tenure_mismatches(old, old))
    with pytest.raises(ValueError, match="1 rows"):
        tables.publish(new, path, stints.tenure_mismatches(old, new))
    assert tables.published(spark, path).collect() == old.collect()
    tables.publish(new, path, stints.tenure_mismatches(new, new), by="window_end")
    assert tables.published(spark, path).select(*new.columns).collect() == new.collect()


def test_location_values_lean_on_their_neighbours(spark):
    rows = [(1, 0.5, 0.5, 3), (1, 0.5, 0.7, 0), (2, 3.0, 0.5, 2), (2, 40.0, 40.0, 2), (3, None, 1.0, 3)]
    df = spark.createDataFrame(rows, "player_id long, x double, y double, points long")
    got = {(r.bin_x, r.bin_y): (r.attempts, r.plain, r.value) for r in shots.location_values(df, prior=2.0).collect()}
    assert got[0, 0] == (2, 1.5, (3 + 2 * 2) / 4) and got[1, 0] == (1, 2.0, (2 + 2 * 1.5) / 3)
    assert got[20, 20] == (1, 2.0, (2 + 2 * 7 / 4) / 3)  # no neighbours: the mean of all
    by = {r.player_id: r for r in shots.shot_values(df, prior=0.0).collect()}
    assert set(by) == {1, 2} and by[1].above == by[2].above == 0 and by[2].expected == 2
    assert shots.shot_values(df.limit(0)).count() == 0


def test_master_scan_landed_files_and_reliability_query(spark, tmp_path):
    df = spark.createDataFrame([(1, 2001, "random"), (2, 2002, "odd_even")], "game_id long, season long, rule string")
    df.write.parquet(f"{tmp_path}/master")
    assert [r.game_id for r in tables.master_scan(spark, f"{tmp_path}/master", 2001).collect()] == [1]
    assert tables.master_scan(spark, f"{tmp_path}/master", 1900) is None
    assert [r.season for r in tables.reliability_query(df, 2002, "odd_even").collect()] == [2002]
    with pytest.raises(ValueError):
        tables.reliability_query(df, 1990)
    (tmp_path / "master" / "bad.parquet").write_bytes(b"not a table")
    told = {r.file.rsplit("/", 1)[-1]: r.usable for r in tables.landed_files(spark, f"{tmp_path}/master/*.parquet").collect()}
    assert told.pop("bad.parquet") is False and sum(told.values()) == 2  # an empty file is not usable either
