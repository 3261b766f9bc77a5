"""Sources to the player-day table to months."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from playerday.functions.scalars import age_at
from playerday.sources.schemas import PLAYER_DAY

KEY = ["UserID", "ActivityDate"]
_PAYMENTS = (("deposits_successful", "Deposit_Success", "Deposit"), ("deposits_failed", "Deposit_Failed", "Deposit"), ("withdrawals_successful", "Withdrawal_Success", "Withdrawal"), ("withdrawals_failed", "Withdrawal_Failed", "Withdrawal"))


def player_dimension(src: dict[str, DataFrame]) -> DataFrame:
    """A row per player with the trimmed country name; adaptive execution broadcasts the country table while it is small."""
    country = src["country_reference"].select("CountryCode", F.trim("Country").alias("Country"))
    return src["demographics"].join(country, "CountryCode", "left").select("UserID", "DateOfBirth", F.trim("Gender").alias("Gender"), "CountryCode", "Country")


def _daily(play: DataFrame, count: str, prefix: str) -> DataFrame:
    return play.groupBy("UserID", F.col("Date").alias("ActivityDate")).agg(F.sum(count).alias(count), F.sum("Wagers").alias(f"{prefix}Wagers"), F.sum("Winnings").alias(f"{prefix}Winnings"), F.avg("Odds").alias(f"{prefix}AvgOdds"))


def game_daily(src: dict[str, DataFrame]) -> DataFrame:
    return _daily(src["games"], "CashGames", "CashGame")


def tournament_daily(src: dict[str, DataFrame]) -> DataFrame:
    return _daily(src["tournaments"], "Tournaments", "Tournament")


def transaction_detail(src: dict[str, DataFrame]) -> DataFrame:
    """All payment attempts with the table and the type that they come from."""
    parts = []
    for name, tag, kind in _PAYMENTS:
        parts.append(src[name].select("UserID", F.col("Date").alias("ActivityDate"), F.col(f"{kind}ID").alias("TransactionID"), "Time", "PayMeth", "PayMethCat", "Amount", "Status", F.lit(tag).alias("source_table"), F.lit(kind).alias("transaction_type")))
    return reduce(DataFrame.unionByName, parts)


def _payment_sums() -> list[Column]:
    out = []
    for kind in ("Deposit", "Withdrawal"):
        for status, name in (("S", ""), ("F", "Failed")):
            hit = (F.col("transaction_type") == kind) & (F.col("Status") == status)
            out.append(F.sum(F.when(hit, F.col("Amount")).otherwise(F.lit(0).cast("decimal(18,5)"))).alias(f"{kind}{name}Amount"))
            out.append(F.sum(F.when(hit, 1).otherwise(0)).alias(f"{kind}{name or 'Success'}Count"))
    return out


def transaction_daily(src: dict[str, DataFrame]) -> DataFrame:
    return transaction_detail(src).groupBy(*KEY).agg(F.count("*").alias("TransactionCount"), *_payment_sums())


def player_day_spine(src: dict[str, DataFrame]) -> DataFrame:
    """Distinct players and days of all six fact tables."""
    facts = [src[n].select("UserID", F.col("Date").alias("ActivityDate")) for n in ("games", "tournaments", *(p[0] for p in _PAYMENTS))]
    return reduce(DataFrame.union, facts).distinct()


def rejected_keys(src: dict[str, DataFrame]) -> DataFrame:
    """(table, rows): fact rows without a player or a day, which player_day leaves out."""
    facts = [src[n].where("UserID IS NULL OR Date IS NULL").select(F.lit(n).alias("table")) for n in ("games", "tournaments", *(p[0] for p in _PAYMENTS))]
    return reduce(DataFrame.union, facts).groupBy("table").agg(F.count("*").alias("rows"))


def player_day(src: dict[str, DataFrame]) -> DataFrame:
    """One row per player and active day, 22 columns.

    The six fact tables are stacked with their measures in place and grouped
    once, instead of a distinct spine and three joins on the same key: one
    shuffle, combined before it, so a player with very many rows costs no task
    more than its days. The days are then dealt by player once, which serves
    the join with the dimension and a table laid out by player (files.laid_out).
    A measure without a fact is 0, an average without odds null. Rows without a
    key are left out (see rejected_keys).
    """
    money = "decimal(18,5)"
    games = src["games"].selectExpr("UserID", "Date AS ActivityDate", "CashGames", "Wagers AS CashGameWagers", "Winnings AS CashGameWinnings", "Odds AS CashOdds")
    tours = src["tournaments"].selectExpr("UserID", "Date AS ActivityDate", "Tournaments", "Wagers AS TournamentWagers", "Winnings AS TournamentWinnings", "Odds AS TourOdds")
    pays = transaction_detail(src).select(*KEY, "Amount", "Status", "transaction_type")
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (games, tours, pays)).where("UserID IS NOT NULL AND ActivityDate IS NOT NULL")
    zero = lambda c, t: F.coalesce(F.sum(c), F.lit(0).cast(t)).alias(c)
    plays = [zero("CashGames", "bigint"), zero("CashGameWagers", money), zero("CashGameWinnings", money), F.avg("CashOdds").alias("CashGameAvgOdds"), zero("Tournaments", "bigint"), zero("TournamentWagers", money), zero("TournamentWinnings", money), F.avg("TourOdds").alias("TournamentAvgOdds")]
    days = rows.groupBy(*KEY).agg(*plays, *_payment_sums())
    joined = days.repartition("UserID").join(player_dimension(src), "UserID", "left")
    return joined.withColumn("Age", age_at("DateOfBirth", "ActivityDate")).select(*PLAYER_DAY)


def by_game_type(player_day: DataFrame) -> DataFrame:
    """Player-days unpivoted to (MonthDate, GameType, UserID, Count, Wagers, Winnings, Odds), active ones only."""
    part = lambda name, n, w, v, o: F.struct(F.lit(name).alias("GameType"), F.col(n).alias("Count"), F.col(w).alias("Wagers"), F.col(v).alias("Winnings"), F.col(o).alias("Odds"))
    both = F.array(part("Cash Games", "CashGames", "CashGameWagers", "CashGameWinnings", "CashGameAvgOdds"), part("Tournaments", "Tournaments", "TournamentWagers", "TournamentWinnings", "TournamentAvgOdds"))
    rows = player_day.select("UserID", F.trunc("ActivityDate", "month").alias("MonthDate"), F.inline(both))
    return rows.where("Count > 0 OR Wagers > 0 OR Winnings > 0 OR Odds IS NOT NULL")


def _active() -> Column:
    return (F.col("Count") > 0) | (F.col("Wagers") > 0) | (F.col("Winnings") > 0)


def _players() -> list[Column]:
    """A bitmap of the players, in buckets of 32,768 ids: exact, and merged by or."""
    return [F.bitmap_construct_agg(F.bitmap_bit_position(F.when(_active(), F.col("UserID")))).alias("Players")]


def monthly_by_game_type(player_day: DataFrame) -> DataFrame:
    """Players, wagers, winnings and average odds by month and game type.

    Players are counted from bitmaps by bucket of ids, so one aggregation serves
    the sums and the distinct count, and no row is multiplied for it.
    """
    odds = F.when(F.col("Odds") > 0, F.col("Odds"))
    part = by_game_type(player_day).groupBy("MonthDate", "GameType", F.bitmap_bucket_number("UserID").alias("Bucket"))
    part = part.agg(F.sum("Wagers").alias("Wagers"), F.sum("Winnings").alias("Winnings"), F.sum(odds).alias("Odds"), F.count(odds).alias("WithOdds"), *_players())
    return part.groupBy("MonthDate", "GameType").agg(F.sum(F.bitmap_count("Players")).alias("PlayerVolume"), F.sum("Wagers").alias("TotalWagers"), F.sum("Winnings").alias("TotalWinnings"), F.try_divide(F.sum("Odds"), F.sum("WithOdds").cast("double")).alias("AverageOdds"))


def player_sets(player_day: DataFrame) -> DataFrame:
    """(MonthDate, GameType, Bucket, Players): the players active in each game type and month, and all with a player-day as type Any.

    Players is a bitmap of one bucket of ids. Sets of new months are put beside
    the old ones (union); counts over any span come from the sets alone (see
    distinct_players), without the days.
    """
    active = by_game_type(player_day).where(_active()).select("MonthDate", "GameType", "UserID")
    present = player_day.select(F.trunc("ActivityDate", "month").alias("MonthDate"), F.lit("Any").alias("GameType"), "UserID")
    rows = active.union(present).groupBy("MonthDate", "GameType", F.bitmap_bucket_number("UserID").alias("Bucket"))
    return rows.agg(F.bitmap_construct_agg(F.bitmap_bit_position("UserID")).alias("Players"))


def distinct_players(sets: DataFrame, span: Column | None = None) -> DataFrame:
    """(Span, GameType, Players): distinct players by a span of months (an expression of MonthDate; null: all months together)."""
    rows = sets.withColumn("Span", F.lit(None).cast("date") if span is None else span)
    merged = rows.groupBy("Span", "GameType", "Bucket").agg(F.bitmap_or_agg("Players").alias("Players"))
    return merged.groupBy("Span", "GameType").agg(F.sum(F.bitmap_count("Players")).alias("Players"))
