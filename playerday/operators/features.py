"""Player features from player-days: one exchange on the player serves windows, streaks and roll-up, none from a table laid out by player."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from playerday.functions.scalars import age_band, last_known, mean_of, safe_divide
from playerday.sources.schemas import MIN_LEGAL_AGE

RECENT_DAYS = 90


def net_gaming(player_day: DataFrame) -> DataFrame:
    """Adds WagerAmount, WinningAmount and NetGaming (positive when the operator wins)."""
    wager = F.col("CashGameWagers") + F.col("TournamentWagers")
    winning = F.col("CashGameWinnings") + F.col("TournamentWinnings")
    return player_day.withColumns({"WagerAmount": wager, "WinningAmount": winning, "NetGaming": wager - winning})


def with_sequence(days: DataFrame) -> DataFrame:
    """Adds the active day before, ChaseFlag, the run of consecutive days and DaysBeforeEnd to days that have NetGaming.

    Days of a run have one difference of date and row number: StreakID numbers
    these by player, StreakDay is a day's place in its run.
    """
    player = Window.partitionBy("UserID")
    by = player.orderBy("ActivityDate")
    days = days.withColumns({"__before": F.lag(F.struct("ActivityDate", "NetGaming")).over(by), "__run": F.date_sub("ActivityDate", F.row_number().over(by)), "DaysBeforeEnd": F.datediff(F.max("ActivityDate").over(player), "ActivityDate")})
    gap = F.datediff("ActivityDate", "__before.ActivityDate")
    chase = (F.col("__before.NetGaming") > 0) & (gap <= 1) & (F.col("DepositAmount") > 0)
    days = days.withColumns({"PrevNetGaming": F.col("__before.NetGaming"), "GapDays": gap, "ChaseFlag": F.coalesce(chase.cast("int"), F.lit(0))})
    runs = {"StreakID": F.dense_rank().over(player.orderBy("__run")), "StreakDay": F.row_number().over(Window.partitionBy("UserID", "__run").orderBy("ActivityDate"))}
    return days.withColumns(runs).drop("__before", "__run")


def _sequence_aggs() -> list:
    recent = F.col("DaysBeforeEnd") < RECENT_DAYS
    mean_if = lambda c: F.try_divide(F.sum(F.when(c, F.col("DepositAmount"))).cast("double"), F.count_if(c).cast("double"))
    return [F.sum("ChaseFlag").alias("LossChasingDays"), F.max("DepositAmount").alias("MaxDailyDeposit"), F.max("NetGaming").alias("MaxDailyLoss"), F.max("StreakDay").alias("MaxConsecutiveActiveDays"), mean_if(recent).alias("RecentAvgDeposit"), mean_if(~recent).alias("EarlierAvgDeposit")]


def _escalation(df: DataFrame) -> DataFrame:
    sudden = (F.coalesce("RecentAvgDeposit", F.lit(0.0)) > 0) & (F.coalesce("EarlierAvgDeposit", F.lit(0.0)) == 0)
    return df.withColumns({"DepositEscalationRatio": safe_divide("RecentAvgDeposit", "EarlierAvgDeposit"), "RecentDepositWithoutEarlierBaseline": sudden.cast("int")})


def sequence_features(player_day: DataFrame) -> DataFrame:
    """Per player: chasing days, daily maxima, longest streak, recent against earlier deposits."""
    days = with_sequence(net_gaming(player_day))
    return _escalation(days.groupBy("UserID").agg(*_sequence_aggs()))


SUMS = ("CashGames", "CashGameWagers", "CashGameWinnings", "Tournaments", "TournamentWagers", "TournamentWinnings", "WagerAmount", "WinningAmount", "NetGaming", "DepositAmount", "DepositSuccessCount", "DepositFailedCount", "WithdrawalAmount", "WithdrawalSuccessCount", "WithdrawalFailedCount")


def player_features(player_day: DataFrame) -> DataFrame:
    """One row per player: roll-up, sequence features, lifecycle, rates.

    Everything per player is one aggregation over the windowed days; the last
    day of the data joins as a single row.
    """
    days = with_sequence(net_gaming(player_day))
    df = days.groupBy("UserID").agg(
        F.min("ActivityDate").alias("FirstActivityDate"),
        F.max("ActivityDate").alias("LastActivityDate"),
        F.count("*").alias("ActivityDays"),
        *[last_known(c, "ActivityDate").alias(c) for c in ("Gender", "Age", "Country", "CountryCode")],
        *[F.sum(c).alias(c) for c in SUMS],
        mean_of("CashGameAvgOdds").alias("AvgCashOdds"),
        *_sequence_aggs(),
    )
    df = _escalation(df).join(F.broadcast(player_day.agg(F.max("ActivityDate").alias("__end"))), how="cross")
    attempts = F.col("DepositSuccessCount") + F.col("DepositFailedCount") + F.col("WithdrawalSuccessCount") + F.col("WithdrawalFailedCount")
    df = df.withColumns({
        "RecencyDays": F.datediff("__end", "LastActivityDate"),
        "TenureDays": F.datediff("LastActivityDate", "FirstActivityDate"),
        "Frequency": F.col("ActivityDays"),
        "AgeBand": age_band("Age"),
        "AgeEligibilityFlag": F.coalesce((F.col("Age") < MIN_LEGAL_AGE).cast("int"), F.lit(0)),
    }).drop("__end")
    return df.withColumns({
        "ActivityRate": safe_divide("Frequency", F.col("TenureDays") + 1, 1),
        "WithdrawalToDeposit": safe_divide("WithdrawalAmount", "DepositAmount", 0),
        "Playthrough": safe_divide("WagerAmount", "DepositAmount"),
        "DepositFailedRate": safe_divide("DepositFailedCount", F.col("DepositSuccessCount") + F.col("DepositFailedCount"), 0),
        "WithdrawalFailedRate": safe_divide("WithdrawalFailedCount", F.col("WithdrawalSuccessCount") + F.col("WithdrawalFailedCount"), 0),
        "FailedTxnRate": safe_divide(F.col("DepositFailedCount") + F.col("WithdrawalFailedCount"), attempts, 0),
        "CashGameShare": safe_divide("CashGameWagers", "WagerAmount", 0),
        "TournamentShare": safe_divide("TournamentWagers", "WagerAmount", 0),
        "WagerPerActiveDay": safe_divide("WagerAmount", "Frequency", 0),
        "NetLossPerActiveDay": safe_divide("NetGaming", "Frequency", 0),
    })
