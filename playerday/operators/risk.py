"""Review rules per player: two independent scores and a tier."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from playerday.functions.stats import exact_quantiles
from playerday.sources.schemas import RiskThresholds

# Points of each rule.
AML_POINTS = {"AML_PassThrough": 3, "AML_WithdrawalNoDeposit": 3, "AML_WithdrawalExceedsDeposit": 2, "AML_CardTesting": 2}
RG_POINTS = {"RG_LossChasing": 2, "RG_DepositEscalation": 2, "RG_HighLossVelocity": 2, "RG_SustainedIntensity": 1, "RG_HighAbsoluteLoss": 1}
FLAGS = [*AML_POINTS, "AML_LargeWithdrawalVolume", *RG_POINTS]


def _flag(cond: Column) -> Column:
    return F.coalesce(cond, F.lit(False)).cast("int")


def risk_segments(features: DataFrame, t: RiskThresholds = RiskThresholds()) -> DataFrame:
    """features with ten flags, both scores, Risk Segment and Risk Driver.

    The three quantile cuts are exact, from cumulative counts that one pass
    gives for all three; all else is projection. features is read twice, so it
    should be a written table.
    """
    d = lambda c: F.col(c).cast("double")
    cut = exact_quantiles(features, {"w": ("WithdrawalAmount", t.withdrawal_quantile), "v": ("NetLossPerActiveDay", t.velocity_quantile), "n": ("NetGaming", t.loss_quantile)})
    at_least = lambda x, c: x >= F.lit(cut[c]).cast("double")
    df = features
    df = df.withColumns({
        "AML_PassThrough": _flag((d("DepositAmount") >= t.passthrough_deposit) & (F.col("Playthrough") < t.passthrough_playthrough) & (F.col("WithdrawalToDeposit") >= t.passthrough_ratio) & (F.col("WithdrawalAmount") > 0)),
        "AML_WithdrawalNoDeposit": _flag((F.col("DepositAmount") == 0) & (F.col("WithdrawalAmount") > 0)),
        "AML_WithdrawalExceedsDeposit": _flag((d("DepositAmount") >= t.ratio_deposit) & (F.col("WithdrawalToDeposit") >= t.ratio)),
        "AML_CardTesting": _flag((F.col("DepositFailedCount") >= t.card_fails) & (F.col("DepositFailedRate") >= t.card_rate)),
        "AML_LargeWithdrawalVolume": _flag(at_least(d("WithdrawalAmount"), "w")),
        "RG_LossChasing": _flag(F.col("LossChasingDays") >= t.chasing_days),
        "RG_DepositEscalation": _flag((F.coalesce(F.col("DepositEscalationRatio") >= t.escalation_ratio, F.lit(False)) | (F.col("RecentDepositWithoutEarlierBaseline") == 1)) & (F.col("TenureDays") >= t.escalation_tenure)),
        "RG_HighLossVelocity": _flag(at_least(F.col("NetLossPerActiveDay"), "v")),
        "RG_SustainedIntensity": _flag(F.col("MaxConsecutiveActiveDays") >= t.streak_days),
        "RG_HighAbsoluteLoss": _flag(at_least(d("NetGaming"), "n")),
    })
    pattern = sum(F.col(c) * p for c, p in AML_POINTS.items())
    df = df.withColumns({"AMLRiskScore": pattern + F.col("AML_LargeWithdrawalVolume") * (pattern > 0).cast("int"), "RGRiskScore": sum(F.col(c) * p for c, p in RG_POINTS.items())})
    aml, rg = F.col("AMLRiskScore"), F.col("RGRiskScore")
    tier = F.when((aml >= t.high_aml) | (rg >= t.high_rg), "High Risk").when((aml >= t.medium_aml) | (rg >= t.medium_rg), "Medium Risk").otherwise("Low Risk")
    driver = (
        F.when((aml >= t.high_aml) & (rg >= t.high_rg), "AML + Responsible Gambling")
        .when(aml >= t.high_aml, "AML")
        .when(rg >= t.high_rg, "Responsible Gambling")
        .when((aml > 0) & (rg > 0), "AML + Responsible Gambling (watch)")
        .when((aml > 0) & (aml >= rg), "AML (watch)")
        .when(rg > 0, "Responsible Gambling (watch)")
        .otherwise("Not flagged")
    )
    return df.withColumns({"Risk Segment": tier, "Risk Driver": driver})


def risk_flag_summary(risk: DataFrame) -> DataFrame:
    """(Flag, Category, PlayersTriggered, ShareOfPlayers, AvgNetGaming, AvgWithdrawalAmount), in one pass over the players."""
    flagged = F.explode(F.array(*[F.struct(F.lit(c).alias("Flag"), F.col(c).alias("on")) for c in FLAGS]))
    rows = risk.select("NetGaming", "WithdrawalAmount", flagged.alias("f")).select("NetGaming", "WithdrawalAmount", "f.*")
    on = F.col("on") == 1
    mean_if = lambda c: F.try_divide(F.sum(F.when(on, F.col(c))).cast("double"), F.sum("on").cast("double"))
    out = rows.groupBy("Flag").agg(F.sum("on").alias("PlayersTriggered"), F.avg(F.col("on").cast("double")).alias("ShareOfPlayers"), mean_if("NetGaming").alias("AvgNetGaming"), mean_if("WithdrawalAmount").alias("AvgWithdrawalAmount"))
    return out.withColumn("Category", F.when(F.col("Flag").startswith("AML"), "AML").otherwise("Responsible Gambling")).orderBy("Category", F.desc("PlayersTriggered"), "Flag")


def review_queue(risk: DataFrame) -> DataFrame:
    """Flagged players with tier and driver, highest scores first."""
    return risk.where("AMLRiskScore > 0 OR RGRiskScore > 0").select("UserID", "Risk Segment", "Risk Driver", "AMLRiskScore", "RGRiskScore").orderBy(F.desc("AMLRiskScore"), F.desc("RGRiskScore"), "UserID")
