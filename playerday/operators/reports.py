"""Segment profiles, the value by risk matrix, method comparison and dashboard measures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from playerday.functions.scalars import age_band, rank_of, safe_divide
from playerday.functions.stats import avg_ranks, category_mix, mix_text, quantiles, with_quantiles
from playerday.operators.activity import by_game_type, distinct_players, player_sets
from playerday.operators.features import net_gaming
from playerday.operators.value import RFM_LABEL
from playerday.sources.schemas import MIN_LEGAL_AGE, PLAYER_SEGMENTS, RISK_LABELS, VALUE_LABELS, RiskThresholds

# The action of each cell of the value by risk matrix.
ACTIONS = {
    ("Premium", "High Risk"): "Prioritise manual Compliance and Responsible Gambling review before any targeted promotion; determine action only after case review.",
    ("Premium", "Medium Risk"): "Continue service cautiously, monitor the triggered indicators, and review before personalised promotion.",
    ("Premium", "Low Risk"): "Consider high-touch retention and personalised service within standard responsible-gambling controls.",
    ("High Value", "High Risk"): "Prioritise manual review and pause targeted promotional decisions until the indicators are assessed.",
    ("High Value", "Medium Risk"): "Monitor the triggered indicators and use conservative, reviewable retention activity.",
    ("High Value", "Low Risk"): "Prioritise for retention and relevant cross-sell testing with normal controls.",
    ("Medium Value", "High Risk"): "Route for manual review; avoid automated promotional escalation while indicators remain unresolved.",
    ("Medium Value", "Medium Risk"): "Use low-cost lifecycle activity and monitor for movement in the review indicators.",
    ("Medium Value", "Low Risk"): "Use scalable reactivation and cross-sell tests, measuring incremental response.",
    ("Low Value", "High Risk"): "Route for proportionate manual review; do not infer misconduct from the segment label alone.",
    ("Low Value", "Medium Risk"): "Use automated servicing and monitor the specific review indicators.",
    ("Low Value", "Low Risk"): "Use low-cost automated reactivation and measure cost per reactivated player.",
}


def d(c: str) -> Column:
    return F.col(c).cast("double")


PROFILE_MEDIANS = ("TenureDays", "RecencyDays", "Frequency", "WagerAmount", "NetGaming", "DepositAmount", "WithdrawalAmount", "WithdrawalToDeposit", "AvgCashOdds", "CashGameShare")


def segment_profile(df: DataFrame, segment: str) -> DataFrame:
    """Medians, totals, means, shares and category mixes (as texts) of the players of each segment."""
    out = df.groupBy(F.col(segment).alias("Segment")).agg(
        F.count("*").alias("Players"), F.sum("AgeEligibilityFlag").alias("Under19Players"), F.sum("WagerAmount").cast("double").alias("TotalWagerAmount"), F.sum("NetGaming").cast("double").alias("TotalNetGaming"),
        F.avg("FailedTxnRate").alias("AvgFailedTxnRate"), F.avg(d("LossChasingDays")).alias("AvgLossChasingDays"),
    )
    wanted = {"MedianRecordedAge": ("Age", 0.5), "MedianAge19Plus": (F.when(F.col("Age") >= MIN_LEGAL_AGE, d("Age")), 0.5), "P90WagerAmount": ("WagerAmount", 0.9)}
    wanted |= {f"Median{c}": (c, 0.5) for c in PROFILE_MEDIANS}
    out = with_quantiles(out, df.withColumn("Segment", F.col(segment)), wanted, ["Segment"])
    whole = Window.partitionBy()  # a row per segment
    share = lambda c: F.try_divide(d(c), F.sum(d(c)).over(whole))
    for column, top in (("AgeBand", None), ("Gender", None), ("Country", 3)):
        texts = mix_text(category_mix(df, segment, column, top)).select(F.col("segment").alias("Segment"), F.col("text").alias(f"{column}Mix"))
        out = out.join(F.broadcast(texts), "Segment", "left")  # a row per segment
    return out.withColumns({"PlayerShare": share("Players"), "Under19Share": d("Under19Players") / d("Players"), "NetGamingShare": share("TotalNetGaming"), "WagerShare": share("TotalWagerAmount")})


def order_segments(df: DataFrame, value: str = "Value Segment") -> DataFrame:
    """Highest value first, then highest risk, then most net gaming."""
    return df.orderBy(rank_of(value, VALUE_LABELS).desc(), rank_of("Risk Segment", RISK_LABELS).desc(), F.desc("NetGaming"), "UserID")


def player_segments(df: DataFrame) -> DataFrame:
    """The delivered table: 60 columns in their order, sorted."""
    return order_segments(df).select(*PLAYER_SEGMENTS)


def value_risk_matrix(df: DataFrame, value: str = RFM_LABEL, t: RiskThresholds = RiskThresholds()) -> DataFrame:
    """All twelve cells, empty ones with zeros, highest value and risk first."""
    spark = df.sparkSession
    grid = spark.createDataFrame([(v, r, ACTIONS[v, r]) for v in VALUE_LABELS for r in RISK_LABELS], "`Value Segment` string, `Risk Segment` string, `Recommended Action` string")
    cells = df.groupBy(F.col(value).alias("Value Segment"), "Risk Segment").agg(
        F.count("*").alias("Players"), F.sum("NetGaming").cast("double").alias("TotalNetGaming"), F.sum("WithdrawalAmount").cast("double").alias("TotalWithdrawalAmount"),
        F.count_if(F.col("AMLRiskScore") > 0).alias("AMLIndicatorPlayers"), F.count_if(F.col("RGRiskScore") > 0).alias("RGIndicatorPlayers"),
        F.count_if(F.col("AMLRiskScore") >= t.high_aml).alias("AMLHighPriorityPlayers"), F.count_if(F.col("RGRiskScore") >= t.high_rg).alias("RGHighPriorityPlayers"),
    )
    cells = with_quantiles(cells, df.withColumn("Value Segment", F.col(value)), {"MedianNetGaming": ("NetGaming", 0.5)}, ["Value Segment", "Risk Segment"])
    filled = [c for c in cells.columns if c not in ("Value Segment", "Risk Segment", "MedianNetGaming")]
    out = F.broadcast(grid).join(cells, ["Value Segment", "Risk Segment"], "left").fillna(0, filled)
    whole = Window.partitionBy()
    out = out.withColumns({"PlayerShare": F.try_divide(d("Players"), F.sum(d("Players")).over(whole)), "NetGamingShare": F.try_divide("TotalNetGaming", F.sum("TotalNetGaming").over(whole))})
    return out.orderBy(rank_of("Value Segment", VALUE_LABELS).desc(), rank_of("Risk Segment", RISK_LABELS).desc())


def method_crosstab(df: DataFrame, rows: str = "Value Segment", columns: str = RFM_LABEL) -> DataFrame:
    """Players by tier of either method, all four by four cells."""
    spark = df.sparkSession
    labels = spark.createDataFrame([(v,) for v in VALUE_LABELS], f"`{rows}` string")
    counts = df.groupBy(rows).pivot(columns, VALUE_LABELS).count()
    return F.broadcast(labels).join(counts, rows, "left").fillna(0)


def rank_correlation(df: DataFrame) -> DataFrame:
    """Spearman correlation of net gaming and the sum of both risk scores."""
    scored = df.select("UserID", "NetGaming", (F.col("AMLRiskScore") + F.col("RGRiskScore")).alias("RiskScore"))
    ranked = avg_ranks(scored, {"NetGaming": "a", "RiskScore": "b"})
    return ranked.agg(F.corr(d("a"), d("b")).alias("RankCorrelation"))


def risk_summary(df: DataFrame, value: str = RFM_LABEL) -> DataFrame:
    """(Metric, Value) of one value label and the risk tiers: players, tiers of both, High Risk share, rank correlation."""
    aggs = {"Players segmented": F.count("*"), "High Risk share of players": F.avg((F.col("Risk Segment") == "High Risk").cast("double"))}
    aggs |= {f"{v} players": F.count_if(F.col(value) == v) for v in VALUE_LABELS} | {f"{r} players": F.count_if(F.col("Risk Segment") == r) for r in RISK_LABELS}
    one = df.agg(*[F.round(v.cast("double"), 4).alias(k) for k, v in aggs.items()])
    corr = rank_correlation(df).select(F.round("RankCorrelation", 4).alias("Value / Risk rank correlation"))
    one = one.join(corr, how="cross")  # a row each
    return one.unpivot([], one.columns, "Metric", "Value")


def method_summary(df: DataFrame, value: str = "Value Segment", other: str = RFM_LABEL) -> DataFrame:
    """(Metric, Value) of the measured comparison of two value labels, and the risk summary of the first."""
    gap = F.abs(rank_of(value, VALUE_LABELS) - rank_of(other, VALUE_LABELS))
    aggs = {"Methods agree exactly (players)": F.count_if(gap == 0), "Exact agreement rate": F.avg((gap == 0).cast("double")), "Agreement within one tier": F.avg((gap <= 1).cast("double")), "Disagreement of two tiers or more": F.count_if(gap >= 2)}
    one = df.agg(*[F.round(v.cast("double"), 4).alias(k) for k, v in aggs.items()])
    return risk_summary(df, value).union(one.unpivot([], one.columns, "Metric", "Value"))


def data_quality_notes(player_day: DataFrame, features: DataFrame) -> DataFrame:
    """(Topic, Value): the measured facts behind the data-quality notes, as text-free numbers (dates as days since 1970)."""
    days = lambda c: F.datediff(c, F.lit("1970-01-01").cast("date"))
    span = player_day.agg(F.min(days("ActivityDate")).alias("FirstDay"), F.max(days("ActivityDate")).alias("LastDay"))
    zero = lambda c: F.count_if(F.col(c) == 0)
    facts = features.agg(
        F.count("*").alias("Players"), F.min("Age").alias("MinAge"), F.max("Age").alias("MaxAge"), F.count_if(F.col("Age") < MIN_LEGAL_AGE).alias("Under19Players"),
        F.sum("WagerAmount").alias("TotalTurnover"), F.sum("NetGaming").alias("TotalNetGaming"), F.count_if(F.col("NetGaming") < 0).alias("NetAheadPlayers"), zero("WithdrawalAmount").alias("NeverWithdrew"), zero("DepositAmount").alias("NeverDeposited"), zero("WagerAmount").alias("ZeroWagerPlayers"),
    )
    medians = quantiles(features, {"MedianRecencyDays": ("RecencyDays", 0.5), "MedianAge": ("Age", 0.5)})
    one = span.join(facts, how="cross").join(medians, how="cross")  # a row each
    one = one.select(*[d(c).alias(c) for c in one.columns])
    return one.unpivot([], one.columns, "Topic", "Value")


def kpi_summary(player_day: DataFrame, sets: DataFrame | None = None) -> DataFrame:
    """Totals of the whole span; players are counted from stored player sets where they are given."""
    df = net_gaming(player_day)
    sums = [F.sum(c).cast("double").alias(n) for n, c in (("Wagers", "WagerAmount"), ("Winnings", "WinningAmount"), ("NetGaming", "NetGaming"), ("Deposits", "DepositAmount"), ("Withdrawals", "WithdrawalAmount"))]
    players = distinct_players(player_sets(player_day) if sets is None else sets).where("GameType = 'Any'")
    players = players.agg(F.coalesce(F.sum("Players"), F.lit(0)).alias("ActivePlayers"))
    out = players.join(df.agg(*sums), how="cross")  # a row each
    return out.withColumns({"AvgWagerPerPlayer": safe_divide("Wagers", "ActivePlayers"), "HoldRate": safe_divide("NetGaming", "Wagers"), "NetGamingPerPlayer": safe_divide("NetGaming", "ActivePlayers")})


def monthly_trend(player_day: DataFrame) -> DataFrame:
    """Wagers, winnings and net gaming by month, with the change from the month before."""
    df = net_gaming(player_day).groupBy(F.trunc("ActivityDate", "month").alias("MonthDate")).agg(*[F.sum(c).cast("double").alias(c) for c in ("WagerAmount", "WinningAmount", "NetGaming")])
    before = Window.orderBy("MonthDate")  # a row per month
    return df.withColumns({"WagerChange": F.col("WagerAmount") - F.lag("WagerAmount").over(before), "NetGamingChange": F.col("NetGaming") - F.lag("NetGaming").over(before)})


def game_mix_by_year(player_day: DataFrame) -> DataFrame:
    """Each game type's share of a year's wagers."""
    df = by_game_type(player_day).groupBy(F.year("MonthDate").alias("Year"), "GameType").agg(F.sum("Wagers").cast("double").alias("Wagers"))
    return df.withColumn("WagerShare", F.try_divide("Wagers", F.sum("Wagers").over(Window.partitionBy("Year"))))


#: Dimensions of contributions.
DIMENSIONS = ("Country", "Gender", "AgeBand")


def contributions(player_day: DataFrame) -> DataFrame:
    """Wagers and net gaming of each country, gender and age band and of all, with their shares of all; one pass, by grouping sets."""
    named = {c: F.coalesce(F.col(c), F.lit("Unknown")) for c in DIMENSIONS}
    df = net_gaming(player_day).withColumn("AgeBand", age_band("Age")).select(*[v.alias(k) for k, v in named.items()], "WagerAmount", "NetGaming")
    sums = [F.sum("WagerAmount").cast("double").alias("Wagers"), F.sum("NetGaming").cast("double").alias("NetGaming")]
    rows = df.groupingSets([*([c] for c in DIMENSIONS), []], *DIMENSIONS).agg(*sums, F.grouping_id().alias("__left"))
    every = (1 << len(DIMENSIONS)) - 1  # bits of the dimensions that a row leaves out
    dimension = F.lit("All")
    for i, c in enumerate(DIMENSIONS):
        dimension = F.when(F.col("__left") == every - (1 << (len(DIMENSIONS) - 1 - i)), c).otherwise(dimension)
    whole = Window.partitionBy()  # a row for each value of a dimension
    total = lambda c: F.max(F.when(F.col("__left") == every, F.col(c))).over(whole)
    return rows.select(dimension.alias("Dimension"), F.coalesce(*DIMENSIONS, F.lit("All")).alias("Value"), "Wagers", "NetGaming", F.try_divide("Wagers", total("Wagers")).alias("WagerShare"), F.try_divide("NetGaming", total("NetGaming")).alias("NetGamingShare"))


def contribution_by(player_day: DataFrame, dimension: str) -> DataFrame:
    """The contributions of one dimension (Country, Gender or AgeBand)."""
    return contributions(player_day).where(F.col("Dimension") == dimension)


def contribution(df: DataFrame, dimension: str) -> DataFrame:
    """The same for rows that have WagerAmount and NetGaming, such as players by segment."""
    df = df.groupBy(F.coalesce(dimension, F.lit("Unknown")).alias("Value")).agg(F.sum("WagerAmount").cast("double").alias("Wagers"), F.sum("NetGaming").cast("double").alias("NetGaming"))
    whole = Window.partitionBy()
    return df.select(F.lit(dimension).alias("Dimension"), "*", F.try_divide("Wagers", F.sum("Wagers").over(whole)).alias("WagerShare"), F.try_divide("NetGaming", F.sum("NetGaming").over(whole)).alias("NetGamingShare"))


def payment_success_by_year(player_day: DataFrame) -> DataFrame:
    df = player_day.groupBy(F.year("ActivityDate").alias("Year")).agg(*[F.sum(c).alias(c) for c in ("DepositSuccessCount", "DepositFailedCount", "WithdrawalSuccessCount", "WithdrawalFailedCount")], *[F.sum(c).cast("double").alias(c) for c in ("DepositFailedAmount", "WithdrawalFailedAmount")])
    rate = lambda k: safe_divide(f"{k}SuccessCount", F.col(f"{k}SuccessCount") + F.col(f"{k}FailedCount"))
    return df.select("Year", rate("Deposit").alias("DepositSuccessRate"), rate("Withdrawal").alias("WithdrawalSuccessRate"), "DepositFailedAmount", "WithdrawalFailedAmount")


def segment_kpis(df: DataFrame, segment: str = RFM_LABEL) -> DataFrame:
    out = df.groupBy(F.col(segment).alias("Segment")).agg(F.count("*").alias("Players"), F.avg(d("WagerAmount")).alias("AvgWager"), F.avg(d("DepositAmount")).alias("AvgDeposit"), F.avg(d("Frequency")).alias("AvgFrequency"), F.sum("NetGaming").cast("double").alias("NetGaming"))
    return out.withColumn("RevenueShare", F.try_divide("NetGaming", F.sum("NetGaming").over(Window.partitionBy())))


def high_risk_by_value(df: DataFrame, segment: str = RFM_LABEL) -> DataFrame:
    return df.groupBy(F.col(segment).alias("Segment")).agg(F.count_if(F.col("Risk Segment") == "High Risk").alias("HighRiskPlayers"))


def dim_date(player_day: DataFrame) -> DataFrame:
    """A row per calendar day of the activity span."""
    span = player_day.agg(F.min("ActivityDate").alias("a"), F.max("ActivityDate").alias("b")).where("a IS NOT NULL")
    days = span.select(F.explode(F.sequence("a", "b")).alias("Date"))
    return days.select("Date", F.year("Date").alias("Year"), F.quarter("Date").alias("Quarter"), F.month("Date").alias("Month"), F.dayofweek("Date").alias("DayOfWeek"), F.trunc("Date", "month").alias("MonthDate"))


def dim_player(dimension: DataFrame, segments: DataFrame, value: str = RFM_LABEL) -> DataFrame:
    """Every known player with value and risk segment; players without activity have neither."""
    return dimension.join(segments.select("UserID", F.col(value).alias("Value Segment"), "Risk Segment"), "UserID", "left")
