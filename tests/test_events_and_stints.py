import pytest

from stintmill.operators import events, stints

PBP = "game_id long, game_play_number long, type_text string, scoring_play boolean, shooting_play boolean"


def classify(spark, *rows):
    df = spark.createDataFrame([(1, n, *r) for n, r in enumerate(rows)], PBP)
    return [r.ends_possession for r in events.classify_free_throws(df).orderBy("game_play_number").collect()]


@pytest.mark.parametrize(
    ("after", "ends"),
    [
        ([("Defensive Rebound", None, False)], True),
        ([("Offensive Rebound", None, False)], False),
        ([("Substitution", None, False)] * 3 + [("Defensive Rebound", None, False)], True),
        ([("Substitution", None, False)] * 4 + [("Defensive Rebound", None, False)], None),
        ([("Jump Shot", None, True), ("Defensive Rebound", None, False)], None),
        ([], None),
    ],
)
def test_missed_last_shot_looks_ahead(spark, after, ends):
    assert classify(spark, ("Free Throw - 2 of 2", False, True), *after)[0] is ends


@pytest.mark.parametrize(
    ("label", "made", "ends"),
    [
        ("Free Throw - 2 of 2", True, True),
        ("Free Throw - 1 of 2", True, None),
        ("Free Throw - 1 of 1", True, False),
        ("Free Throw - Technical", False, False),
        ("Free Throw - Flagrant 2 of 2", True, False),
        ("Free Throw - Clear Path 2 of 2", True, False),
        ("Jump Shot", True, None),
        (None, True, None),
    ],
)
def test_labels(spark, label, made, ends):
    assert classify(spark, (label, made, True), ("Defensive Rebound", None, False))[0] is ends


def test_unknown_label_raises(spark):
    df = spark.createDataFrame([(1, 1, "Free Throw - odd", True, True)], PBP)
    with pytest.raises(events.UnknownLabels, match="odd"):
        events.classify_free_throws(df, check=True)


def test_coefficient_leaves_out_unresolved(spark):
    rows = [(1, 1, "Free Throw - 1 of 2", True, True), (1, 2, "Free Throw - 2 of 2", True, True), (2, 1, "Free Throw - 1 of 2", True, True), (2, 2, "Free Throw - 2 of 2", False, True)]
    df = spark.createDataFrame([(*r, 2024) for r in rows], PBP + ", season long")
    got = events.coefficients(events.classify_free_throws(df)).first()
    assert (got.total_attempts, got.unresolved, got.ending_trips) == (4, 1, 1)
    assert got.coefficient == pytest.approx(1 / 3)


def test_possession_points_follow_the_scorer(spark):
    cols = "game_id string, possession_no long, stat_no int, stat_key string, stat_value long, team_id long, opponent_team_id long, lineup_id string, opponent_lineup_id string"
    rows = [
        ("g", 1, 0, "OffPoss", 1, 10, 20, "a", "b"),
        ("g", 1, 1, "OpponentPoints", 9, 20, 10, "b", "a"),
        ("g", 1, 2, "OpponentPoints", 2, 20, 10, "b", "a"),  # stated again: the last counts
        ("g", 1, 3, "OpponentPoints", 1, 20, 10, "c", "a"),  # another pairing adds
        ("g", 1, 4, "OpponentPoints", 1, 10, 20, "a", "b"),  # the defence scores
        ("g", 2, 0, "OpponentPoints", 3, 20, 10, "b", "a"),  # never counted as a possession
    ]
    got = stints.possessions(spark.createDataFrame(rows, cols)).collect()
    assert [(r.possession_no, r.offense_team_id, r.points, r.opponent_points) for r in got] == [(1, 10, 3, 1)]


def test_external_stints_split_possessions(spark):
    df = spark.createDataFrame([("g", "1_2_3_4_5", "6_7_8_9_10", 5, 4, 6)], "game_id string, home_lineup string, away_lineup string, n_pos long, home_points long, away_points long")
    got = sorted((r.offense_lineup, r.possessions, r.points) for r in stints.external_stints(df).collect())
    assert got == [("1-2-3-4-5", 2.5, 4.0), ("6-7-8-9-10", 2.5, 6.0)]


STATS = "game_id string, stats array<struct<stat_no: bigint, stat_key: string, stat_value: bigint, team_id: bigint, opponent_team_id: bigint, lineup_id: string, opponent_lineup_id: string>>"


def test_possessions_of_whole_rows_are_those_of_the_stats(spark):
    stat = lambda n, key, value, team, other, line="a", against="b": (n, key, value, team, other, line, against)
    said = lambda *rows: ("g", list(rows))
    whole = [
        said(stat(3, "OffPoss", 1, 1, 2, "late"), stat(0, "OffPoss", 1, 1, 2), stat(2, "OpponentPoints", 3, 2, 1), stat(1, "OpponentPoints", 9, 2, 1)),
        said(stat(0, "OffPoss", 1, 1, 2), stat(1, "OpponentPoints", 2, 2, 1), stat(2, "OpponentPoints", 1, 2, 1, "c"), stat(3, "OpponentPoints", 4, 1, 2)),
        said(stat(0, "OffPoss", 1, 1, 2, None, None), stat(1, "OpponentPoints", 2, 2, 1, None, None), stat(2, "OpponentPoints", None, 2, 1, None, None)),
        said(stat(None, "OffPoss", 1, 1, 2), stat(0, "OffPoss", 1, 2, 1), stat(None, "OpponentPoints", 5, 1, 2), stat(1, "OpponentPoints", 7, 2, None)),
        said(stat(0, "OffPoss", 1, 1, 2), stat(1, "OpponentPoints", 6, 2, None), stat(2, "OpponentPoints", 2, 2, 1, None), stat(3, "OpponentPoints", 3, 2, 1, None)),
        said(stat(0, "Other", 1, 1, 2), stat(1, "OpponentPoints", 2, 2, 1)),
        ("g", []),
    ]
    each = spark.createDataFrame(whole, STATS)
    flat = [("g", n, *s) for n, (_, stats) in enumerate(whole) for s in stats]
    rows = spark.createDataFrame(flat, "game_id string, possession_no long, stat_no long, stat_key string, stat_value long, team_id long, opponent_team_id long, lineup_id string, opponent_lineup_id string")
    want = sorted(map(str, stints.possessions(rows).drop("possession_no").collect()))
    assert len(want) == 5 and sorted(map(str, stints.told_possessions(each).collect())) == want


def test_payloads_are_dealt_to_parts_whose_number_grows_with_the_orders(spark, monkeypatch):
    from stintmill.plans import events_and_stints as plan

    at = "/root/testdata/sf0.001"
    told = lambda: sorted(map(tuple, plan.QUERIES["season_stints"](spark, at).collect()))
    usual, orders = told(), spark.read.parquet(f"{at}/orders.parquet").count()
    monkeypatch.setattr(plan, "POSSESSIONS", 50)
    parts = plan._payloads(spark, at).rdd.getNumPartitions()
    assert parts == -(-orders // 50) > spark.sparkContext.defaultParallelism
    assert told() == usual


def test_payloads_are_shuffled_by_game_once(spark):
    from stintmill.plans import events_and_stints as plan

    for name in ("season_stints", "season_failures"):
        text = plan.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert text.count("Exchange hashpartitioning(game_id") == 1 and "SortMergeJoin" not in text, name
        assert text.count("Exchange hashpartitioning") == 2, name  # orders, and their rows by game
