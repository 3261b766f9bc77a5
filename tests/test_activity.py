"""Edge rows of the player-activity operators."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from playerday.functions.scalars import age_at, age_band, safe_divide
from playerday.functions.stats import avg_ranks, exact_quantiles, quintile
from playerday.operators import activity, features, quality, review, risk, value
from playerday.sources.schemas import PLAYER_DAY, REVIEW, SOURCES


def d(s):
    return dt.date.fromisoformat(s)


@pytest.fixture(scope="module")
def src(spark):
    m = Decimal
    rows = {
        "country_reference": [(1, " Canada ")],
        "demographics": [(1, d("2000-02-29"), "F", 1), (2, None, None, 9)],
        "games": [(1, d("2020-01-01"), 2, 2.0, m("10"), m("4")), (1, d("2020-01-01"), 1, 4.0, m("5"), m("1")), (3, d("2020-01-02"), 1, 0.0, m("7"), m("0")), (None, d("2020-01-02"), 1, 0.0, m("7"), m("0"))],
        "tournaments": [(2, d("2020-02-01"), 0, None, m("0"), m("0"))],
        "deposits_successful": [(1, 1, d("2020-01-02"), "01:00:00", "VISA", "Card", m("50"), "S"), (2, 2, d("2020-01-05"), "01:00:00", "VISA", "Card", m("9"), "S")],
        "deposits_failed": [],
        "withdrawals_successful": [(1, 3, d("2020-01-04"), "01:00:00", "VISA", "Card", m("20"), "S")],
        "withdrawals_failed": [],
    }
    return {n: spark.createDataFrame(rows[n], s) for n, s in SOURCES.items()}


def test_player_day(spark, src):
    df = activity.player_day(src)
    assert df.columns == PLAYER_DAY
    rows = {(r.UserID, str(r.ActivityDate)): r for r in df.collect()}
    assert set(rows) == {(1, "2020-01-01"), (1, "2020-01-02"), (1, "2020-01-04"), (2, "2020-01-05"), (2, "2020-02-01"), (3, "2020-01-02")}
    r = rows[1, "2020-01-01"]
    assert (r.CashGames, r.CashGameWagers, r.CashGameAvgOdds, r.DepositAmount, r.Country, r.Age) == (3, 15, 3.0, 0, "Canada", 19)
    assert rows[2, "2020-01-05"].CashGameAvgOdds is None and rows[2, "2020-01-05"].Age is None
    assert {(r["table"], r["rows"]) for r in activity.rejected_keys(src).collect()} == {("games", 1)}
    spine = {tuple(r) for r in activity.player_day_spine(src).where("UserID IS NOT NULL").collect()}
    assert spine == {(u, d(x)) for u, x in rows}


def test_monthly(src):
    rows = {(str(r.MonthDate), r.GameType): r for r in activity.monthly_by_game_type(activity.player_day(src)).collect()}
    assert set(rows) == {("2020-01-01", "Cash Games")}  # no activity and no odds leaves the month out
    assert rows["2020-01-01", "Cash Games"].PlayerVolume == 2 and rows["2020-01-01", "Cash Games"].AverageOdds == 3.0  # odds of 0 do not count


def test_sequence(src):
    r = {x.UserID: x for x in features.sequence_features(activity.player_day(src)).collect()}[1]
    assert (r.LossChasingDays, r.MaxConsecutiveActiveDays) == (1, 2)
    f = {x.UserID: x for x in features.player_features(activity.player_day(src)).collect()}
    assert f[1].Frequency == 3 and f[1].TenureDays == 3 and abs(f[1].WithdrawalToDeposit - 0.4) < 1e-9
    assert f[3].Playthrough is None and f[3].WithdrawalToDeposit == 0


def test_scalars(spark):
    rows = [("2000-02-29", "2001-02-28", 0), ("2000-02-29", "2001-03-01", 1), ("2000-12-31", "2001-01-01", 0)]
    df = spark.createDataFrame(rows, "b string, a string, want int")
    assert df.where(age_at(F.col("b").cast("date"), F.col("a").cast("date")) != F.col("want")).count() == 0
    bands = spark.createDataFrame([(18, "Under 19"), (19, "19-24"), (24, "19-24"), (25, "25-34"), (64, "55-64"), (65, "65+")], "a int, want string")
    assert bands.where(age_band("a") != F.col("want")).count() == 0
    assert spark.range(1).select(safe_divide(F.lit(1), F.lit(0)), safe_divide(F.lit(1), F.lit(0), 0)).first()[:] == (None, 0.0)


def test_ranks_and_quantiles(spark):
    df = spark.createDataFrame([(x,) for x in [5, 5, 5, 5, 1, 9, None]], "x int")
    got = sorted((r.x, r.r) for r in avg_ranks(df, {"x": "r"}, 2).collect() if r.x is not None)
    assert got == [(1, 2)] + [(5, 7)] * 4 + [(9, 12)]
    same = spark.createDataFrame([(1, 8)] * 7, "x int, r bigint")
    assert {r[0] for r in same.select(quintile(F.col("r"), F.lit(7))).collect()} == {3}
    assert exact_quantiles(df, {f"q{q}": ("x", q) for q in (0.0, 0.5, 1.0, 0.9)}, 2) == {"q0.0": 1.0, "q0.5": 5.0, "q1.0": 9.0, "q0.9": 7.0}


def _player(**kw):
    base = dict(UserID=1, DepositAmount=0.0, WithdrawalAmount=0.0, Playthrough=None, WithdrawalToDeposit=0.0, DepositFailedCount=0, DepositFailedRate=0.0, LossChasingDays=0, DepositEscalationRatio=None, RecentDepositWithoutEarlierBaseline=0, TenureDays=0, NetLossPerActiveDay=0.0, MaxConsecutiveActiveDays=1, NetGaming=0.0)
    return base | kw


def test_risk(spark):
    rows = [_player(UserID=i, NetLossPerActiveDay=float(i), NetGaming=float(i), WithdrawalAmount=float(i)) for i in range(100, 200)]
    rows += [_player(UserID=1, DepositAmount=5000.0, WithdrawalAmount=4000.0, WithdrawalToDeposit=0.8, Playthrough=0.09), _player(UserID=2, WithdrawalAmount=1.0), _player(UserID=3, LossChasingDays=10, RecentDepositWithoutEarlierBaseline=1, TenureDays=180)]
    schema = ", ".join(f"{k} {'bigint' if isinstance(v, int) else 'double'}" for k, v in _player().items())
    out = {r.UserID: r for r in risk.risk_segments(spark.createDataFrame(rows, schema)).collect()}
    assert (out[1]["Risk Segment"], out[1]["Risk Driver"], out[1].AMLRiskScore) == ("High Risk", "AML", 4)
    assert out[2].AML_WithdrawalNoDeposit == 1 and out[2].AMLRiskScore == 3
    assert (out[3].RGRiskScore, out[3]["Risk Driver"]) == (4, "Responsible Gambling")


def test_clustering(spark):
    rows = [(i, float(i % 2) * 5, 1.0) for i in range(40)]
    df = value.standardize(spark.createDataFrame(rows, "UserID int, x double, y double"), ["x", "y"])
    assert {r.y for r in df.collect()} == {0.0}  # a constant column
    c = value.kmeans_fit(df, k=2, n_init=1, columns=["x", "y"])
    near = value.kmeans_assign(df, c, ["x", "y"])
    assert near.select("KMeansCluster").distinct().count() == 2
    assert value.silhouette(near, ["x", "y"]).first()[0] == pytest.approx(1.0)
    lone = near.where("UserID < 1")
    assert value.silhouette(lone, ["x", "y"]).first()[0] == 0.0


def test_review(spark):
    rows = [(d("2020-01-01"), str(i), "M", 30, "Canada", 1.0, 1.0, 1.0, float(i), "Review Completed", "No Action required", "") for i in range(50)]
    base = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "position int, `Activity Date` date, `Player ID` string, Gender string, Age int, Country string, `Wager Amount` double, `Winning Amount` double, `Deposit Amount` double, `Withdrawal Amount` double, `Review Status` string, Decision string, Comment string")
    count = lambda df: {r[0]: r[1] for r in review.validate_review(df, base).collect() if r[1]}
    assert count(base) == {}
    assert count(base.withColumn("Wager Amount", F.col("Wager Amount") + 1e-9)) == {}
    assert count(base.withColumn("Wager Amount", F.col("Wager Amount") + 1e-6)) == {"changed fields": 50}
    assert count(base.withColumn("Decision", F.lit(None).cast("string"))) == {"decision": 50}
    assert count(base.withColumn("Review Status", F.lit(" Review Completed "))) == {}
    assert count(base.select("position", *reversed(REVIEW))) == {"columns": 1}
    assert count(base.withColumn("position", 49 - F.col("position")))["changed fields"] == 50
    with pytest.raises(ValueError):
        review.require_valid(review.validate_review(base.limit(49), base))


def test_validate_player_day(src):
    df = activity.player_day(src)
    bad = {r[0]: r[1] for r in quality.validate_player_day(df.union(df.where("UserID = 3"))).collect() if r[1]}
    assert bad == {"invalid Age": 4, "invalid CountryCode": 2, "repeated player-day": 1}  # two without a birth date, one unknown twice
    assert {r[0]: r[1] for r in quality.validate_player_day(df.limit(0)).collect() if r[1]} == {"no rows": 1}
    assert quality.validate_player_day(df.drop("Age")).first()[0] == "missing column Age"


def test_money_is_kept(src):
    df = activity.player_day(src)
    assert df.agg(F.sum("CashGameWagers")).first()[0] == 22 and df.agg(F.sum("DepositAmount")).first()[0] == 59
