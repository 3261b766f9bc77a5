"""The three jobs as spark-submit entry points: python -m playerday.plans.jobs <job> <input> <output> [csv]."""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame, SparkSession

from playerday.operators import activity, features, quality, reports, review, risk, value
from playerday.sources import files
from playerday.sources.schemas import KMeansConfig


def build_player_day(spark: SparkSession, source: str, out: str, fmt: str = "parquet") -> None:
    """Eight source tables (Parquet datasets or text sheets) to the player-day and monthly tables, whose months are replaced."""
    with files.work_tables(spark):
        days = files.laid_out(activity.player_day(files.load_sources(spark, source, fmt)), "player-days")  # one pass over the sources, not two
        files.write_player_day(days, f"{out}/player_day")
        files.write_monthly(activity.monthly_by_game_type(days), f"{out}/monthly", "parquet")


def build_segments(spark: SparkSession, source: str, out: str, config: KMeansConfig = KMeansConfig()) -> None:
    """A player-day table to segments, profiles, matrix, comparison and notes."""
    with files.work_tables(spark):
        days = quality.load_player_day(files.read_player_day(spark, source))
        players = files.written(features.player_features(days), "features")
        scored = files.written(value.rfm_scores(files.written(risk.risk_segments(players), "risk")), "scores")
        clustered, clusters = value.kmeans_segments(scored, config)
        df = files.written(clustered, "clusters")
        tables: dict[str, DataFrame] = {
            "Player_Segments": reports.player_segments(df),
            "Method_Summary": reports.method_summary(df),
            "Value_Profile": reports.segment_profile(df, "Value Segment"),
            "Risk_Profile": reports.segment_profile(df, "Risk Segment"),
            "Archetype_Profile": reports.segment_profile(df, "Behaviour Archetype"),
            "Value_Risk_Matrix": reports.value_risk_matrix(df, "Value Segment"),
            "Data_Quality_Notes": reports.data_quality_notes(days, df),
            "Risk_Flag_Summary": risk.risk_flag_summary(df),
            "Cluster_Profile": clusters,
            "KMeans_Diagnostics": value.kmeans_diagnostics(value.standardize(value.lrfm_features(df)), config),
            "Method_Crosstab": reports.method_crosstab(df),
        }
        files.write_tables(tables, out)


def build_review(spark: SparkSession, source: str, out: str) -> None:
    """A player-day table to the review queue of the top withdrawers."""
    files.export_review_csv(review.review_table(review.top_withdrawers(files.read_player_day(spark, source), strict=True)), f"{out}/aml_review")


JOBS = {"player-day": build_player_day, "segments": build_segments, "review": build_review}

if __name__ == "__main__":
    JOBS[sys.argv[1]](SparkSession.builder.appName(f"playerday-{sys.argv[1]}").getOrCreate(), *sys.argv[2:5])
