"""The driver's contract at the smallest scale."""

import decimal

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SAMPLE = ["classify_free_throws", "game_stints", "schema_player_box", "check_season", "reliability_season", "crosswalk", "drift_report", "gram_sums", "compare_candidates", "season_failures", "window_metrics", "window_crosswalk", "game_folds", "schema_play_by_play"]


def test_every_oracle_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", SAMPLE)
def test_values_match_the_oracle(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = entry.queries()[name](spark, SF).toPandas(), con.sql(entry.oracle_sql()[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    said = lambda v: "null" if pd.isna(v) else f"{float(v):.7g}" if isinstance(v, int | float | decimal.Decimal) and not isinstance(v, bool) else str(v)
    plain = lambda df: sorted(tuple(map(said, row)) for row in df[columns].astype(object).values.tolist())
    assert plain(got) == plain(want)
