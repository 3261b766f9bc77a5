"""The three jobs and their writers on the smallest tables."""

import os

import pytest
from pyspark.sql import functions as F

from playerday.functions.scalars import rank_of
from playerday.operators import value
from playerday.plans import jobs
from playerday.sources import files
from playerday.sources.schemas import PLAYER_DAY, PLAYER_SEGMENTS, REVIEW, RISK_LABELS, VALUE_LABELS, KMeansConfig
from playerday.sources.testdata import load_testdata

TABLES = "Method_Summary Value_Profile Risk_Profile Value_Risk_Matrix Player_Segments Data_Quality_Notes Archetype_Profile Risk_Flag_Summary Cluster_Profile KMeans_Diagnostics Method_Crosstab".split()


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("jobs"))
    for name, df in load_testdata(spark, "/root/testdata/sf0.001").items():
        df.write.parquet(f"{root}/sources/{name}")
    jobs.build_player_day(spark, f"{root}/sources", f"{root}/out")
    jobs.build_segments(spark, f"{root}/out/player_day", f"{root}/segments", KMeansConfig(n_init=2, k_range=(2, 3)))
    jobs.build_review(spark, f"{root}/out/player_day", f"{root}/out")
    return root


def test_player_day_and_months(spark, built):
    days = files.read_player_day(spark, f"{built}/out/player_day")
    assert sorted(days.columns) == sorted(PLAYER_DAY) and days.count() > 0
    assert sum(x.startswith("Month=") for x in os.listdir(f"{built}/out/player_day")) == 12  # a folder for each month
    months = files.read_monthly(spark, f"{built}/out/monthly")
    assert months.columns == ["MonthDate", "GameType", "PlayerVolume", "TotalWagers", "TotalWinnings", "AverageOdds"]
    sums = days.agg(F.sum("CashGameWagers") + F.sum("TournamentWagers")).first()[0]
    assert months.agg(F.sum("TotalWagers")).first()[0] == sums


def test_segment_tables(spark, built):
    tables = {n: spark.read.parquet(f"{built}/segments/{n}") for n in TABLES}
    df = tables["Player_Segments"]
    assert df.columns == PLAYER_SEGMENTS and len(PLAYER_SEGMENTS) == 60
    rows = df.select(rank_of("Value Segment", VALUE_LABELS).alias("v"), rank_of("Risk Segment", RISK_LABELS).alias("r"), "NetGaming").collect()
    assert rows == sorted(rows, key=lambda x: (-x.v, -x.r, -x.NetGaming))
    assert tables["Value_Risk_Matrix"].count() == 12 and tables["Value_Risk_Matrix"].agg(F.sum("Players")).first()[0] == len(rows)
    profile = {r.Segment: r for r in tables["Risk_Profile"].collect()}
    assert sum(r.Players for r in profile.values()) == len(rows) and all("%" in r.GenderMix and r.CountryMix.count("%") <= 3 for r in profile.values())
    diagnostics = tables["KMeans_Diagnostics"].collect()
    assert sorted(str(r.K) for r in diagnostics) == ["2", "3", "None"] and "silhouette" in next(r.Selected for r in diagnostics if r.K is None)


def test_review_export(spark, built):
    back = spark.read.csv(f"{built}/out/aml_review", header=True)
    assert back.columns == REVIEW and back.count() == 50
    assert back.where(~F.col("Activity Date").rlike(r"^\d{4}-\d{2}-\d{2}$")).count() == 0


def test_csv_writers(spark, built, tmp_path):
    days = files.read_player_day(spark, f"{built}/out/player_day")
    files.write_player_day(days, f"{tmp_path}/days", "csv")
    back = files.read_player_day(spark, f"{tmp_path}/days", "csv")
    assert back.columns == PLAYER_DAY and back.count() == days.count()
    files.write_tables({"one": days.limit(3)}, f"{tmp_path}/tables", "csv")
    assert spark.read.csv(f"{tmp_path}/tables/one", header=True).count() == 3


def test_equal_archetypes_carry_their_cluster(spark):
    rows = [(0, 0.9, 0.5, 0.9), (1, 0.8, 0.1, 0.7), (2, -0.9, -1.0, 0.0)]
    df = value.archetypes(spark.createDataFrame(rows, "KMeansCluster int, Recency double, Frequency double, Monetary double"))
    assert {r[0]: r["Behaviour Archetype"] for r in df.collect()} == {0: "Lapsed Whales (C0)", 1: "Lapsed Whales (C1)", 2: "Active Casuals"}
