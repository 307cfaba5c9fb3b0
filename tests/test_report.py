"""Leaderboards."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tessera.operators import report as R

COLUMNS = (
    "run_id string, run_ts timestamp_ntz, ingested_at timestamp_ntz, neg_log_prob_sum double, `avg character count` double,"
    " `avg bytes` double, `parameters count` double, model_name_or_path string, data_path string"
)


def logs(spark, rows):
    full = [(str(i), datetime(2025, m, 1), datetime(2025, m, 2), n, 100.0, b, p, name, f"data/{d}.json") for i, (m, n, b, p, name, d) in enumerate(rows)]
    return spark.createDataFrame(full, COLUMNS)


def test_latest_wins_and_paths_are_keys(spark):
    df = logs(spark, [(1, 70.0, 50.0, 1.0, "a/m", "x"), (2, 140.0, 50.0, 2.0, "a/m", "x"), (1, 35.0, 50.0, None, "b/m", "x")])
    board = {r["model_name_or_path"]: r for r in R.leaderboard(df, "nats_per_char").collect()}
    assert board["a/m"]["average"] == pytest.approx(1.4)
    assert board["a/m"]["parameters_b"] == 2.0
    assert board["b/m"]["position"] == 1
    assert board["b/m"]["parameters_b"] is None
    assert board["b/m"]["model"] == "m"


def test_missing_figures(spark):
    df = logs(spark, [(1, 70.0, None, 1.0, "a", "x"), (1, float("nan"), 50.0, 1.0, "b", "x"), (1, 70.0, 0.0, 1.0, "c", "x")])
    assert R.latest(df, "bpb").count() == 0
    assert R.latest(df, "bpc").count() == 2


def test_profile(spark):
    df = logs(spark, [(1, v, 50.0, 1.0, m, d) for m, v in (("a", 10.0), ("b", 20.0), ("c", 30.0)) for d in ("x", "y")] + [(1, 5.0, 50.0, 1.0, "a", "z")])
    rows = R.profile(df, 2).collect()
    assert {r["model_name_or_path"] for r in rows} == {"a", "b"}
    assert all(r["scaled"] is None or 0.8 <= r["scaled"] <= 0.95 for r in rows)
    assert [r["scaled"] for r in rows if r["dataset"] == "z.json"] == [None]
    assert {r["dataset"]: r["angle"] for r in rows}["x.json"] == 0
    positions = {(r["model_name_or_path"], r["dataset"]): r["position"] for r in R.colour_position(df).collect()}
    assert positions[("a", "x.json")] == 0 and positions[("c", "x.json")] == 1 and positions[("a", "z.json")] is None


def test_tiers_colours_and_pivot(spark):
    df = spark.createDataFrame([(0.5,), (3.0,), (70.0,), (None,)], "p double")
    assert [r[0] for r in df.select(R.tier(F.col("p"))).collect()] == ["1.5B", "3B", "larger", None]
    df = spark.createDataFrame([(0.0,), (0.5,), (1.0,)], "p double")
    assert [r[0] for r in df.select(R.colour(F.col("p"))).collect()] == ["#00ff00", "#ffffff", "#ff0000"]
    wide = R.pivot(R.latest(logs(spark, [(1, 10.0, 5.0, 1.0, "a", "x")])), ["x.json", "y.json"])
    assert wide.columns == ["model_name_or_path", "x.json", "y.json"]
    changes = R.rank_changes(logs(spark, [(1, 10.0, 5.0, 1.0, "a", "x"), (1, 20.0, 5.0, 1.0, "b", "x"), (2, 10.0, 5.0, 1.0, "b", "x"), (2, 20.0, 5.0, 1.0, "a", "x")]))
    assert {(r["month"], r["model_name_or_path"]): r["gained"] for r in changes.collect()}[("2025-02", "b")] == 1
    assert "<td>1.235</td>" in R.html_table(spark.createDataFrame([(1.23456,)], "x double"), "t")
