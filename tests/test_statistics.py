"""Ranks, quantiles, player sets and sketches against the engine's own, and their plans."""

import random

import pytest
from pyspark.sql import functions as F

from playerday.functions import stats
from playerday.operators import activity, features, quality, reports, risk, value
from playerday.plans import queries
from playerday.sources import files
from playerday.sources.schemas import RISK_LABELS, VALUE_LABELS, KMeansConfig
from playerday.sources.testdata import load_testdata

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().toString()


def test_quantiles_against_percentile(spark):
    """100,000 distinct values, a group of one, one of nulls, hot values; parts of 7,000 values."""
    x = F.when(F.col("id") % 3 == 0, 5.0).when(F.col("id") % 1000 == 1, None).otherwise(F.rand(3) * 1e6)
    df = spark.range(150_000).select(F.when(F.col("id") == 7, "lone").when(F.col("id") % 5 == 0, None).otherwise("many").alias("g"), x.alias("x"), (F.col("id") % 11).alias("y"))
    df = files.written(df.union(spark.createDataFrame([("empty", None, None)], df.schema)), "test")
    wanted = {"m": ("x", 0.5), "p": ("x", 0.9), "low": ("x", 0.0), "y25": ("y", 0.25)}
    got = stats.quantiles(df, wanted, ["g"], per_part=7000)
    assert "percentile" not in plan(got) and "median" not in plan(got)
    want = df.groupBy("g").agg(*[F.percentile(F.col(c).cast("double"), q).alias(n) for n, (c, q) in wanted.items()])
    rows = {r.g: r for r in want.collect()}
    for r in got.collect():
        assert all(r[n] == pytest.approx(rows[r.g][n], rel=1e-12) for n in wanted)
    assert {r.g for r in got.collect()} == set(rows) - {"empty"}
    kept = stats.with_quantiles(df.groupBy("g").count(), df, wanted, ["g"])
    assert {r.g: r.m is None for r in kept.collect()} == {"lone": False, "many": False, None: False, "empty": True}


def test_no_part_holds_more_values_than_set(spark):
    df = spark.range(60_000).select((F.col("id") * 7 % 50_000).alias("x"))
    counts = stats.cumulative(df, {"x": F.col("x")}, per_part=5000)
    assert counts.count() == 50_000
    written = [p for p in files._work if "value-parts" in p][-1]
    sizes = [r["count"] for r in spark.read.parquet(written).groupBy("part").count().collect()]
    assert len(sizes) >= 8 and max(sizes) < 10_000


def test_ranks_of_several_columns_in_one_scan(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice([0, 0, rng.randint(0, 9000)]), rng.choice([None, rng.random()])) for i in range(4000)]
    df = files.written(spark.createDataFrame(rows, "id int, a int, b double"), "test")
    got = {r.id: r for r in stats.avg_ranks(df, {"a": "ra", "b": "rb"}, per_part=500).collect()}
    for c, name in ((1, "ra"), (2, "rb")):
        known = sorted(r[c] for r in rows if r[c] is not None)
        first, last = {}, {}
        for place, x in enumerate(known, 1):
            first.setdefault(x, place)
            last[x] = place
        assert all(got[r[0]][name] == (None if r[c] is None else first[r[c]] + last[r[c]]) for r in rows)
    scores = stats.quintile_scores(df, {"a": "sa", "b": "sb"}, reverse=["b"])
    assert plan(scores).split("== Physical Plan ==")[1].count("a:int,b:double") == 1  # the rows alone: all cuts come from the counts
    n = len(rows)
    for r in scores.collect():
        want = [None if got[r.id][x] is None else max(1, min(5, -(-got[r.id][x] * 5 // (2 * n)))) for x in ("ra", "rb")]
        assert (r.sa, r.sb) == (want[0], None if want[1] is None else 6 - want[1])


@pytest.fixture(scope="module")
def days(spark):
    return files.laid_out(activity.player_day(load_testdata(spark, SF)), "test-days")


def test_laid_out_days_need_no_exchange(spark, days):
    """Windows, streaks and roll-up by player read the table as it lies."""
    for df in (features.sequence_features(days), features.player_features(days)):
        assert "Exchange hashpartitioning(UserID" not in plan(df) and "Exchange hashpartitioning" not in plan(df)
    plain = files.written(days, "test-plain")
    assert "Exchange hashpartitioning(UserID" in plan(features.sequence_features(plain))
    assert sorted(map(str, features.sequence_features(days).collect())) == sorted(map(str, features.sequence_features(plain).collect()))


def test_days_are_dealt_by_player_once(spark):
    physical = plan(activity.player_day(load_testdata(spark, SF))).split("== Physical Plan ==")[1]
    assert physical.count("Exchange hashpartitioning(UserID#") - physical.count(", ActivityDate#") <= 2  # the days, and the dimension if it is not broadcast


def test_player_sets_grow_by_month(spark, days):
    old, new = days.where("ActivityDate < '2015-08-01'"), days.where("ActivityDate >= '2015-08-01'")
    sets = activity.player_sets(old).union(activity.player_sets(new))
    assert {tuple(r) for r in activity.distinct_players(sets).collect()} == {tuple(r) for r in activity.distinct_players(activity.player_sets(days)).collect()}
    any_ = next(r.Players for r in activity.distinct_players(sets).collect() if r.GameType == "Any")
    assert any_ == days.select("UserID").distinct().count() == reports.kpi_summary(days, sets).first().ActivePlayers


def test_contributions_in_one_scan(spark, days):
    df = reports.contributions(days)
    assert plan(df).split("== Physical Plan ==")[1].count("FileScan") == 1
    rows = df.collect()
    total = next(r for r in rows if r.Dimension == "All")
    for dimension in reports.DIMENSIONS:
        mine = [r for r in rows if r.Dimension == dimension]
        assert sum(r.Wagers for r in mine) == pytest.approx(total.Wagers) and sum(r.NetGamingShare for r in mine) == pytest.approx(1)


def test_summaries_merge(spark):
    """Quartiles and distinct counts of merged spans within the errors that the sketches state; moments exact."""
    df = files.written(spark.range(40_000).select((F.rand(5) * 1000).alias("x"), (F.col("id") % 7000).alias("k"), F.when(F.col("id") % 4 == 0, None).otherwise(F.concat(F.lit("n"), F.col("id") % 300)).alias("t"), F.date_add(F.lit("2020-01-01").cast("date"), (F.col("id") % 30).cast("int")).alias("d")), "test")
    parts = [quality.column_sketches(df.where(F.col("d") < "2020-01-11"), F.col("d")), quality.column_sketches(df.where(F.col("d") >= "2020-01-11"), F.col("d"))]
    got = {r.column_name: r for r in quality.summarize(parts[0].union(parts[1])).collect()}
    exact = df.agg(F.avg("x").alias("m"), F.stddev_samp("x").alias("s"), F.percentile("x", [0.25, 0.5, 0.75]).alias("q")).first()
    assert got["x"].avg == pytest.approx(exact.m) and got["x"].std == pytest.approx(exact.s)
    assert [got["x"].q25, got["x"].q50, got["x"].q75] == pytest.approx(exact.q, abs=0.01 * 1000)  # a hundredth of the ranks
    for c, distinct in (("k", 7000), ("t", 225), ("d", 30)):
        assert got[c].approx_unique == pytest.approx(distinct, rel=0.03)
    assert (got["k"].min, got["k"].max, got["t"].null_percentage, got["d"]["count"], got["d"].min, got["t"].q50) == ("0", "6999", 25.0, 40_000, "2020-01-01", None)
    empty = {r.column_name: r for r in quality.summarize(quality.column_sketches(df.limit(0))).collect()}
    assert all(r["count"] == 0 for r in empty.values())


def test_replaced_tables_are_seen(spark, tmp_path):
    """A file replaced between two calls of a query changes its result, and the old frames go."""
    sf = f"file://{tmp_path}"
    for name in ("orders", "lineitem", "customer", "nation"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(f"{sf}/{name}.parquet")
    before = queries.QUERIES["kpi_summary"](spark, sf).first()
    assert queries.QUERIES["kpi_summary"](spark, sf).first() == before
    old = set(files._work)
    spark.read.parquet(f"{SF}/lineitem.parquet").where("l_orderkey % 2 = 0").write.mode("overwrite").parquet(f"{sf}/lineitem.parquet")
    after = queries.QUERIES["kpi_summary"](spark, sf).first()
    assert after.Wagers < before.Wagers
    months = queries.QUERIES["monthly_by_game_type"](spark, sf).agg(F.sum("TotalWagers")).first()[0]
    assert months == pytest.approx(after.Wagers) and not old <= set(files._work)
    shared = {p for _, _, paths in queries._shared.values() for p in paths}
    assert shared <= set(files._work)
    queries.release(spark)
    assert not queries._shared and not shared & set(files._work)


def test_clusters_hold_together(spark):
    """Every player once, assignment as kmeans_assign on the centroids, cells that add up; starts side by side give the best of all."""
    days = files.laid_out(activity.player_day(load_testdata(spark, SF)), "test-days")
    players = files.written(value.rfm_scores(files.written(risk.risk_segments(files.written(features.player_features(days), "test")), "test")), "test")
    config = KMeansConfig(n_init=4)
    clustered, profile = value.kmeans_segments(players, config)
    rows = clustered.collect()
    assert len({r.UserID for r in rows}) == len(rows) == players.count()
    scaled = value.standardize(value.lrfm_features(players))
    centroids = value.kmeans_fit(scaled, config)
    near = {r.UserID: r.KMeansCluster for r in value.kmeans_assign(scaled, centroids).collect()}
    assert all(near[r.UserID] == r.KMeansCluster for r in rows)
    costs = [value.inertia(scaled, value.kmeans_fit(scaled, KMeansConfig(seed=42 + i), n_init=1)).first()[0] for i in range(4)]
    assert value.inertia(scaled, centroids).first()[0] == pytest.approx(min(costs), rel=1e-6)
    profile = profile.collect()
    assert sum(r.Players for r in profile) == len(rows) and sum(r.NetGamingShare for r in profile) == pytest.approx(1)
    assert [r["Value Segment"] for r in sorted(profile, key=lambda r: r.NetGamingPerPlayer)] == VALUE_LABELS
    cells = reports.method_crosstab(clustered).collect()
    assert len(cells) == 4 and sum(sum(r[v] for v in VALUE_LABELS) for r in cells) == len(rows)
    metrics = {r.Metric: r.Value for r in reports.method_summary(clustered).collect()}
    assert sum(metrics[f"{v} players"] for v in VALUE_LABELS) == sum(metrics[f"{r} players"] for r in RISK_LABELS) == len(rows)
    assert metrics["Methods agree exactly (players)"] == sum(next(r for r in cells if r["Value Segment"] == v)[v] for v in VALUE_LABELS)
    with pytest.raises(ValueError, match="hand over a sample"):
        value.silhouette(value.kmeans_assign(scaled, centroids), most=10)


def test_actions_of_the_matrix(spark, days):
    """The text of every cell, written out where it differs by segment."""
    players = value.rfm_scores(files.written(risk.risk_segments(files.written(features.player_features(days), "test")), "test"))
    cells = {(r["Value Segment"], r["Risk Segment"]): r["Recommended Action"] for r in reports.value_risk_matrix(files.written(players, "test")).collect()}
    assert len(cells) == 12 and all(cells.values())
    assert all("manual" in cells[v, "High Risk"] for v in VALUE_LABELS)
    assert all("onitor" in cells[v, "Medium Risk"] for v in VALUE_LABELS if v != "Medium Value") and "monitor" in cells["Medium Value", "Medium Risk"]
    assert cells["Low Value", "Low Risk"].endswith("measure cost per reactivated player.") and "high-touch" in cells["Premium", "Low Risk"]
